"""k-mer counts and prediction thresholds over Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import is_valid
from ..operators.classify import with_threshold
from ..operators.counting import tokens


def stream_kmer_counts(seqs: DataFrame, k: int, alphabet: str = "ATCG", time_col: str | None = None, window: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts of k-mers of a stream ``id, sequence``: running, or per window of ``time_col`` with a watermark."""
    if time_col is None:
        return tokens(seqs, k).where(is_valid("kmer", alphabet)).groupBy("kmer").count()
    rows = seqs.withWatermark(time_col, late).withColumn("id", F.struct("id", F.col(time_col).alias("at")))
    found = tokens(rows, k).where(is_valid("kmer", alphabet))
    return found.groupBy(F.window("id.at", window), "kmer").count()


def stream_classes(best: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Threshold prediction on a stream of best classes."""
    return with_threshold(best, threshold)
