"""Column functions: they take and return columns, so they also run on streams."""

from .sequences import accession, canonical_domain, is_valid, kmers, kmers_of_chunk, lineage_path, one_class_truth, seeded_hash, upper_ascii

__all__ = ["accession", "canonical_domain", "is_valid", "kmers", "kmers_of_chunk", "lineage_path", "one_class_truth", "seeded_hash", "upper_ascii"]
