"""Random forests over long profiles (M8c): trees grow level by level from histograms of the entries that are there.

A level is one aggregate over (tree, node, feature, bin, class). The entries of a row are packed into one row once; a level
reads them, follows the splits found so far from the root, and shuffles sums alone. Absent entries are zeros: their counts
are what a node holds less what its entries hold. Each node looks at its own random share of the features, and each tree at its own
bootstrap of the rows; both come from hashes of names, so the forest does not depend on how the rows are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, dropped

#: Limits of the Poisson distribution of mean one: a row is in a bootstrap as often as limits lie below its number.
POISSON = tuple(float(x) for x in np.cumsum(np.exp(-1) / np.cumprod([1, 1, 2, 3, 4, 5, 6, 7])))


def unit(*cols):
    """A number from 0 to 1 by hash."""
    return (F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) + 0.5) / float(1 << 30)


def binned(long: DataFrame, bins: int) -> tuple[DataFrame, DataFrame]:
    """``id, kmers, bins``: the entries of each row, and ``kmer, zero, bins``: the bin of absent entries and how many there are.

    Limits are zero and quantiles of a feature's entries; a value's bin is how many limits lie below it.
    """
    limits = F.array_sort(F.array_distinct(F.array_append(F.percentile_approx("value", [k / bins for k in range(1, bins)], 10_000), F.lit(0.0))))
    points = cut(long.groupBy("kmer").agg(limits.alias("limits")))
    below = lambda x: F.size(F.filter("limits", lambda t: t < x))
    entries = long.join(points, "kmer").select("id", F.struct("kmer", below(F.col("value")).cast("short").alias("bin")).alias("e"))
    rows = entries.groupBy("id").agg(F.collect_list("e").alias("e")).select("id", F.col("e.kmer").alias("kmers"), F.col("e.bin").alias("bins"))  # the entries of one row
    return rows, cut(points.select("kmer", below(F.lit(0.0)).alias("zero"), (F.size("limits") + 1).alias("bins")))


def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best split of ``tree, node, kmer, cells, held, zero, bins``: the fall of the Gini sum, and the last bin on the left."""
    for batch in batches:
        best = []
        for cells, held, zero, bins in zip(*(batch.column(c).to_pylist() for c in ("cells", "held", "zero", "bins")), strict=True):
            place = {h["idx"]: k for k, h in enumerate(held)}
            total = np.array([h["w"] for h in held], float)
            m = np.zeros((bins, len(held)))
            for c in cells:
                m[c["bin"], place[c["idx"]]] += c["w"]
            m[zero] += total - m.sum(axis=0)
            left = m.cumsum(axis=0)[:-1]
            right, n = total - left, left.sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                fall = np.nan_to_num((left**2).sum(axis=1) / n) + np.nan_to_num((right**2).sum(axis=1) / (total.sum() - n)) - (total**2).sum() / total.sum()
            k = int(fall.argmax()) if len(fall) else 0
            best.append((float(fall[k]) if len(fall) else 0.0, k))
        cols = [pa.array([g for g, _ in best], pa.float64()), pa.array([k for _, k in best], pa.int32())]
        yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("node"), batch.column("kmer"), *cols], names=["tree", "node", "kmer", "gain", "split"])


def importances(long: DataFrame, classes: DataFrame, trees: int = 20, depth: int = 5, bins: int = 16, seed: int = 1, share: float | None = None, bootstrap: bool = True) -> DataFrame:
    """``kmer, importance``: the mean over trees of each feature's part in the fall of impurity, those above 0; they sum to 1.

    ``classes``: id, idx. ``share``: the part of the features that a node looks at, by default the square root of them.
    """
    rows, features = binned(long.select("id", "kmer", "value"), bins)
    wide = features.count()
    part = share if share is not None else (wide**0.5 / wide if wide else 1.0)
    often = lambda tree: (sum(F.when(unit("id", tree, F.lit(seed)) > limit, 1).otherwise(0) for limit in POISSON) if bootstrap else F.lit(1)).cast("double")
    every = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), often(t).alias("w")))
    drawn = classes.select("id", "idx", F.filter(every, lambda t: t["w"] > 0).alias("drawn"))
    packed = cut(drawn.join(rows, "id", "left"))  # rows without entries hold zeros
    weight = cut(packed.select(F.explode("drawn").alias("t")).groupBy("t.tree").agg(F.sum("t.w").alias("all")))
    at, found = packed.select("idx", "kmers", "bins", F.inline("drawn")).withColumn("node", F.lit(1)), []
    for _ in range(depth):
        held = at.groupBy("tree", "node", "idx").agg(F.sum("w").alias("w")).groupBy("tree", "node").agg(F.array_sort(F.collect_list(F.struct("idx", "w"))).alias("held"))  # an entry for each class
        seen = at.select("tree", "node", "idx", "w", "bins", F.posexplode("kmers").alias("pos", "kmer")).where(unit("tree", "node", "kmer", F.lit(seed + 1)) < part)
        sums = seen.groupBy("tree", "node", "kmer", F.get("bins", F.col("pos")).cast("int").alias("bin"), "idx").agg(F.sum("w").alias("w"))
        cells = sums.groupBy("tree", "node", "kmer").agg(F.collect_list(F.struct("bin", "idx", "w")).alias("cells"))  # bins times classes at most
        tried = cells.join(held, ["tree", "node"]).join(features, "kmer").select("tree", "node", "kmer", "cells", "held", "zero", "bins")
        tried = tried.mapInArrow(gains, "tree int, node int, kmer string, gain double, split int")
        best = tried.groupBy("tree", "node").agg(F.max_by(F.struct("kmer", "gain", "split"), F.struct("gain", "kmer")).alias("b")).select("tree", "node", "b.*")
        best = cut(best.where("gain > 1e-9").join(features.select("kmer", "zero"), "kmer"))
        if best.isEmpty():
            break
        found.append(best.select("tree", "kmer", "gain"))
        place = F.array_position("kmers", F.col("_kmer"))
        bin_ = F.when(place > 0, F.get("bins", place - 1)).otherwise(F.col("zero"))  # no entries at all: null, and so the bin of zeros
        moved = at.join(F.broadcast(best.select("tree", "node", F.col("kmer").alias("_kmer"), "split", "zero")), ["tree", "node"])  # a row for each node
        at = moved.select("idx", "kmers", "bins", "tree", "w", (F.col("node") * 2 + F.when(bin_ > F.col("split"), 1).otherwise(0)).alias("node"))
    dropped(packed)
    if not found:
        return features.select("kmer", F.lit(0.0).alias("importance")).where("false")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    own = every.join(weight, "tree").groupBy("tree", "kmer").agg(F.sum(F.col("gain") / F.col("all")).alias("v"))
    sums = own.groupBy("tree").agg(F.sum("v").alias("sum"))
    means = cut(own.join(sums, "tree").groupBy("kmer").agg(F.sum(F.col("v") / F.col("sum")).alias("v")))
    total = means.agg(F.sum("v")).first()[0]
    return means.select("kmer", (F.col("v") / F.lit(total)).alias("importance"))
