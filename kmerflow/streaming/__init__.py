"""Stateless and counting operators on streams of sequences."""

from .counts import stream_classes, stream_kmer_counts

__all__ = ["stream_classes", "stream_kmer_counts"]
