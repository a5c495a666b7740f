"""Abundance reports from long predictions: ``id, rank, label``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import write_csv
from .profile import merge_classifications


def abundances(predictions: DataFrame) -> DataFrame:
    """``rank, label, n, total``: counts of each label and the rank's total, Unknown left out."""
    counts = predictions.where("label <> 'Unknown'").groupBy("rank", "label").agg(F.count("*").alias("n"))
    return counts.join(counts.groupBy("rank").agg(F.sum("n").alias("total")), "rank")


def read_counts(predictions: DataFrame, total: int | None = None, per_rank_sum: bool = False) -> DataFrame:
    """``item, n``: total, classified, bacteria, host and unknown reads.

    With a ``domain`` rank, reads classified are those of that rank. Without, distinct classified reads of any rank;
    ``per_rank_sum`` counts a read once for each rank instead.
    """
    domain = not predictions.where("rank = 'domain'").isEmpty()
    known = F.col("label") != "Unknown"
    if domain:
        own = predictions.where("rank = 'domain'")
        sums = own.agg(F.count_distinct("id").alias("total"), F.count_if(known).alias("classified"), F.count_if(F.lower("label").isin("bacteria", "bact")).alias("bacteria"), F.count_if(F.lower("label") == "host").alias("host"))
    else:
        classified = F.count_if(known) if per_rank_sum else F.count_distinct(F.when(known, F.col("id")))
        sums = predictions.agg(F.count_distinct("id").alias("total"), classified.alias("classified"), F.lit(0).cast("long").alias("bacteria"), F.lit(0).cast("long").alias("host"))
    if total is not None:
        sums = sums.withColumn("total", F.lit(total).cast("long"))
    sums = sums.withColumn("unknown", F.col("total") - F.col("classified"))
    return sums.unpivot([], ["total", "classified", "bacteria", "host", "unknown"], "item", "n")


def summary(predictions: DataFrame) -> DataFrame:
    """``item, n, share``: read counts and abundances, raw and in percent; the total has no share."""
    counts = read_counts(predictions)
    total = counts.where("item = 'total'").select(F.col("n").alias("all"))
    rows = counts.unionByName(abundances(predictions).select(F.concat_ws(" ", "rank", "label").alias("item"), "n"))
    share = F.when(F.col("item") == "total", F.lit(float("nan"))).otherwise(F.try_divide(100.0 * F.col("n"), F.col("all")))
    return rows.join(F.broadcast(total), F.lit(True)).select("item", "n", share.alias("share"))  # one row


def taxonomic_strings(lineages: DataFrame, ranks: list[str]) -> DataFrame:
    """``string, n, share``: ``d__X|p__Y|...`` broad to specific, counted for each string (A16, O3). ``lineages``: id, ranks."""
    levels = [F.when(F.col(r).isNotNull(), F.concat(F.lit(f"{r[0]}__"), F.col(r))) for r in ranks]
    counts = lineages.groupBy(F.concat_ws("|", *levels).alias("string")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("all"))
    return counts.join(F.broadcast(total), F.lit(True)).select("string", "n", (F.col("n") / F.col("all")).alias("share"))  # one row


def one_lineage(classes: DataFrame, rank: str, ranks: list[str]) -> DataFrame:
    """Each label of a rank with its broader ranks; of several lineages the first by these."""
    broader = ranks[ranks.index(rank) + 1 :]
    own = classes.select(rank, *broader)
    if not broader:
        return own.distinct()
    return own.groupBy(rank).agg(F.min(F.struct(*broader)).alias("_x")).select(rank, *[F.col(f"_x.{r}").alias(r) for r in broader])


def save_classification(old: DataFrame | None, new: DataFrame, path: str) -> DataFrame:
    """Earlier and new classifications merged on id and written as a tab-separated table."""
    merged = new if old is None else merge_classifications(old, new)
    write_csv(merged, path, sep="\t")
    return merged


def with_lineage(counts: DataFrame, classes: DataFrame, rank: str, ranks: list[str]) -> DataFrame:
    """Abundances of one rank with all broader ranks of their label (J8). ``ranks`` specific to broad."""
    known = one_lineage(classes, rank, ranks)
    return counts.where(F.col("rank") == rank).select(F.col("label").alias(rank), "n").join(known, rank, "left")


def chart_table(counts: DataFrame, classes: DataFrame, ranks: list[str]) -> DataFrame:
    """``n`` and the levels broad to specific for every rank at hand; write it tab-separated (O1)."""
    tables = [with_lineage(counts, classes, r, ranks) for r in ranks]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).select("n", *reversed(ranks))


def full_report(predictions: DataFrame, classes: DataFrame, ranks: list[str]) -> DataFrame:
    """Every classified id with the lineage of its most specific label (J9, O2). ``ranks`` specific to broad."""
    tables = []
    done = None
    for rank in ranks:
        own = predictions.where((F.col("rank") == rank) & (F.col("label") != "Unknown")).select("id", F.col("label").alias(rank))
        if done is not None:
            own = own.join(done, "id", "left_anti")
        done = own.select("id") if done is None else done.unionByName(own.select("id"))
        tables.append(own.join(one_lineage(classes, rank, ranks), rank, "left"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).select("id", *ranks)
