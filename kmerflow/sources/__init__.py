"""Readers and writers: FASTA, FASTQ, class tables, vocabularies, profiles, dataset descriptors, listings."""

from .fasta import build_reference, host_classes, read_fasta, write_fasta
from .fastq import interleave_pairs, read_fastq
from .tables import list_files, load_dataset, load_profile, read_classes, read_lineages, read_vocab, save_dataset, save_profile, write_csv, write_vocab

__all__ = [
    "build_reference", "host_classes", "interleave_pairs", "list_files", "load_dataset", "load_profile", "read_classes", "read_fasta",
    "read_fastq", "read_lineages", "read_vocab", "save_dataset", "save_profile", "write_csv", "write_fasta", "write_vocab",
]
