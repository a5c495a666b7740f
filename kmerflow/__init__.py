"""Sequence profile analytics on Spark: k-mer counting, feature transforms, classification, abundance reports.

Every operator takes and returns DataFrames. Profiles are kept long, ``(id, kmer, value)`` with implicit zeros, because
the vocabulary can hold 4^k features; vectors appear only at the Spark ML edge.
"""
