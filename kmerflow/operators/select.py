"""Feature selection: each returns ``kmer``, the features kept. If nothing would stay, all stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forest import importances
from .lineage import cut
from .profile import select_features
from .stats import chi_of, chi_square, document_frequency, moments, moments_of, quantile
from .transform import TfIdf


def _or_all(kept: DataFrame, every: DataFrame) -> DataFrame:
    return every.select("kmer") if kept.isEmpty() else kept.select("kmer")


def by_occurrence(long: DataFrame, n: int, percent: float = 0.95, low: float | None = None) -> DataFrame:
    """Features in fewer than floor((1 - percent) * n) samples (M6); ``low``: and in at least that share."""
    df = document_frequency(long)
    kept = df.where(F.col("df") < int((1 - percent) * n))
    if low is not None:
        kept = kept.where(F.col("df") >= low * n)
    return _or_all(kept, df)


def least_occurring(long: DataFrame, exclude: int) -> DataFrame:
    """All but the ``exclude`` most occurring features, ties by k-mer."""
    df = document_frequency(long)
    return _or_all(df.orderBy("df", "kmer").limit(max(0, df.count() - exclude)), df)


def by_variance(long: DataFrame, n: int, threshold: float = 0.05) -> DataFrame:
    """Features whose variance exceeds that quantile of all variances (M8)."""
    return above_quantile(moments(long, n), "variance", threshold)


def above_quantile(stats: DataFrame, column: str, threshold: float) -> DataFrame:
    """``kmer`` of the rows whose statistic exceeds that quantile of all; all features if none does."""
    stats = cut(stats)
    limit = quantile(stats, column, threshold)
    return _or_all(stats.where(F.col(column) > F.lit(limit)), stats)


def by_chi_square(long: DataFrame, classes: DataFrame, threshold: float = 0.75, batches: int | None = None) -> DataFrame:
    """Features whose chi-square exceeds that quantile."""
    return above_quantile(chi_square(long, classes, batches=batches), "chi", threshold)


def by_forest(long: DataFrame, classes: DataFrame, vocab: DataFrame, trees: int = 20, depth: int = 5, seed: int = 1) -> DataFrame:
    """Features that a random forest uses (M8c). ``classes``: id, idx; ``vocab``: kmer, of any width."""
    return _or_all(importances(long, classes, trees, depth, seed=seed), vocab)


def reduce_features(long: DataFrame, classes: DataFrame, n: int, percent: float = 0.5, variance: float = 0.05, chi: float = 0.75) -> DataFrame:
    """Occurrence, variance and chi-square selection on TF-IDF values, applied to the untouched profile.

    A selection leaves the values of other features as they are, so the sums of all three by feature and class are made in
    one pass over the weighted entries, which are never written; the selections work on those sums.
    """
    labelled, value = classes.where("label is not null").select("id", "label", F.lit(0).alias("part")), F.col("value")
    weighted = TfIdf.of_frequencies(document_frequency(long), n).transform(long)
    labels = labelled.groupBy("id").agg(F.sort_array(F.collect_list("label")).alias("labels"))  # the labels of one id
    sums = weighted.join(labels, "id", "left").groupBy("kmer", "labels").agg(F.count_if(value != 0).alias("df"), F.sum(value).alias("total"), F.sum(value * value).alias("squares"))
    sums = cut(sums)
    every = cut(sums.groupBy("kmer").agg(*[F.sum(c).alias(c) for c in ("df", "total", "squares")]))
    held = every.where("df > 0")
    kept = _or_all(held.where(F.col("df") < int((1 - percent) * n)), held)
    kept = above_quantile(moments_of(every.join(kept, "kmer", "left_semi").select("kmer", "total", "squares"), n), "variance", variance)
    observed = sums.join(kept, "kmer", "left_semi").select(F.lit(0).alias("part"), "kmer", F.explode("labels").alias("label"), "total")
    kept = above_quantile(chi_of(observed.groupBy("part", "kmer", "label").agg(F.sum("total").alias("o")), labelled), "chi", chi)
    return select_features(long, kept)
