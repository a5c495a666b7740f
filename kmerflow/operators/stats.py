"""Statistics of features and classes over long profiles. Absent entries are zeros and count as such.

``long``: id, feature, value (the feature column is named by ``feature``); ``n``: number of samples.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canonical_domain
from .lineage import with_position

BUFFERED = 1_000_000


def document_frequency(long: DataFrame, feature: str = "kmer", vocabulary: DataFrame | None = None) -> DataFrame:
    """``feature, df``: samples in which a feature is not zero (A4); features of the vocabulary without any have 0."""
    found = long.where("value <> 0").groupBy(feature).agg(F.count("*").alias("df"))
    return found if vocabulary is None else vocabulary.select(feature).distinct().join(found, feature, "left").withColumn("df", F.coalesce("df", F.lit(0)))


def moments(long: DataFrame, n: int, feature: str = "kmer") -> DataFrame:
    """``feature, total, mean, variance`` (population) in one pass (A5)."""
    sums = long.groupBy(feature).agg(F.sum("value").alias("total"), F.sum(F.col("value") * F.col("value")).alias("squares"))
    return moments_of(sums, n, feature)


def moments_of(sums: DataFrame, n: int, feature: str = "kmer") -> DataFrame:
    """``feature, total, mean, variance`` from ``feature, total, squares``; further columns of the sums stay in front."""
    mean = F.col("total") / F.lit(n)
    kept = [c for c in sums.columns if c not in (feature, "total", "squares")]
    return sums.select(feature, *kept, "total", mean.alias("mean"), F.greatest(F.lit(0.0), F.col("squares") / F.lit(n) - mean * mean).alias("variance"))


def extremes(long: DataFrame, n: int, feature: str = "kmer") -> DataFrame:
    """``feature, low, high, peak``: min, max and largest absolute value, zeros of absent entries included."""
    found = long.groupBy(feature).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max(F.abs("value")).alias("peak"), F.count("*").alias("held"))
    absent = F.col("held") < n
    return found.select(feature, F.when(absent, F.least("low", F.lit(0.0))).otherwise(F.col("low")).alias("low"), F.when(absent, F.greatest("high", F.lit(0.0))).otherwise(F.col("high")).alias("high"), "peak")


def chi_square(long: DataFrame, classes: DataFrame, feature: str = "kmer", batches: int | None = None) -> DataFrame:
    """``feature, chi``: observed class sums against shares of classes times feature totals.

    ``classes``: id, label; rows without a label are left out. ``batches`` averages the statistic over that many hash
    batches instead of one global table.
    """
    labelled = classes.where("label is not null").select("id", "label")
    part = F.pmod(F.xxhash64("id"), F.lit(batches)) if batches else F.lit(0)
    labelled = labelled.withColumn("part", part)
    return chi_of(long.join(labelled, "id").groupBy("part", feature, "label").agg(F.sum("value").alias("o")), labelled, feature)


def chi_of(observed: DataFrame, labelled: DataFrame, feature: str = "kmer") -> DataFrame:
    """``feature, chi`` from the sums ``part, feature, label, o`` and the rows ``part, label`` that have a label."""
    by_class = labelled.groupBy("part", "label").agg(F.count("*").alias("held"))
    all_held = by_class.groupBy("part").agg(F.sum("held").alias("n"))
    shares = by_class.join(F.broadcast(all_held), "part").select("part", "label", (F.col("held") / F.col("n")).alias("share"))  # a row for each batch
    # classes a feature does not occur in: o = 0 gives (0 - e)^2 / e = e, so they sum up to what the shares leave
    e = F.col("share") * F.col("total")
    totals = observed.groupBy("part", feature).agg(F.sum("o").alias("total"))
    terms = observed.join(shares, ["part", "label"]).join(totals, ["part", feature])
    chi = terms.groupBy("part", feature).agg(F.sum(F.try_divide((F.col("o") - e) * (F.col("o") - e), e)).alias("held"), F.sum("share").alias("seen"), F.first("total").alias("total"))
    whole = chi.select("part", feature, (F.col("held") + (1 - F.col("seen")) * F.col("total")).alias("chi")).where("total <> 0")
    return whole.groupBy(feature).agg(F.avg("chi").alias("chi"))


def quantile(stats: DataFrame, col: str, q: float) -> float | None:
    """Linear quantile of a statistic over all features, NaN and null ignored.

    Up to ``BUFFERED`` features are sorted in one aggregate; more are sorted by ranges and the two values about the
    quantile's position are picked, with the same result.
    """
    known = stats.where(F.col(col).isNotNull() & ~F.isnan(col)).select(F.col(col).cast("double").alias("x"))
    n = known.count()
    if n <= BUFFERED:
        return known.agg(F.percentile("x", q)).first()[0]
    at = q * (n - 1)
    low = math.floor(at)
    pair = [r["x"] for r in with_position(known, ["x"]).where(F.col("_pos").isin(low, low + 1)).orderBy("_pos").select("x").collect()]  # two rows
    return pair[0] + (pair[-1] - pair[0]) * (at - low)


def class_weights(classes: DataFrame, rank: str, hosts: DataFrame | None = None) -> DataFrame:
    """``label, weight`` = n / (classes * count), Unknown left out (A10); hosts are added on common columns."""
    rows = classes if hosts is None else classes.select(*[c for c in classes.columns if c in hosts.columns]).unionByName(hosts.select(*[c for c in classes.columns if c in hosts.columns]))
    label = canonical_domain(rank) if rank == "domain" else F.col(rank)
    counts = rows.select(label.alias("label")).where("label is not null and label <> 'Unknown'").groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"), F.count("*").alias("labels"))
    return counts.join(F.broadcast(total), F.lit(True)).select("label", (F.col("all") / (F.col("labels") * F.col("n"))).alias("weight"))  # one row


def label_index(classes: DataFrame, rank: str) -> DataFrame:
    """``label, idx``: distinct labels numbered from 0 in order (A11); there are as many rows as labels."""
    labels = classes.select(F.col(rank).alias("label")).where("label is not null").distinct()
    return labels.withColumn("idx", F.row_number().over(Window.orderBy("label")) - 1)


def parents(classes: DataFrame, rank: str, ranks: list[str]) -> tuple[str | None, int]:
    """The next broader rank and how many labels it has (A12); None and 0 at the broadest."""
    at = ranks.index(rank)
    if at + 1 >= len(ranks):
        return None, 0
    return ranks[at + 1], classes.agg(F.count_distinct(ranks[at + 1])).first()[0]
