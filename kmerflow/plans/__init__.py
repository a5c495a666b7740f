"""End-to-end flows made of the operators."""

from .flows import classify_metagenome, extract_profile, reduce_profile, top_features

__all__ = ["classify_metagenome", "extract_profile", "reduce_profile", "top_features"]
