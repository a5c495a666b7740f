"""Mixing sources to target weights by balanced sampling with the cube method.

Sources share the words of the whole corpus by weight; a target stops at ``most`` times its source, and the excess is shared
again by weight until none is above. A source with ratio r = target / words gives each document floor(r) times, and once
more with the probability r - floor(r). The cube method decides the latter: probabilities move through the null space of
the constraints (their sum, and their sum times the sizes, stay what they are), in either direction with the odds that
keep each one's mean, until they reach 0 or 1.

Flight. Documents of a source are dealt in blocks by a hash. Within a block each of the longest moves against all shorter
ones, so that none is left over; then three at a time move along the one direction that keeps both totals. At most two a
block are left, which are dealt in fewer blocks, until a source has one. As each block keeps its own totals, those of the
source are kept, however many tasks fly. Landing: what one block leaves gives up the number of documents, then the last
document is drawn. A source's words thus differ from its target by less than one of its shorter documents, where no single
document decides.

Rows that agree in id, source and size are one class of m copies: moving any two against each other keeps both totals, so
all but one of them fly at once, and a class has one probability, the fraction of m times its own.

Defined results: null text has size 0; null is a source of its own, the last; sources without words have target 0; a null
id is kept; of repeated rows as many give the further copy as the class is drawn for; an empty table gives an empty table;
further columns are not looked at. The order of rows and how they are dealt change nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, dropped, hot_join, parallelism

WEIGHTS, MOST, SEED = (1, 2, 3), 3, 7
#: Documents a block, of which so many move against all others; a probability this near 0 or 1 is there.
BLOCK, LONGEST, NEAR = 2048, 64, 1e-9
#: Up to so many sources, a row each, go to all tasks; more are joined by a shuffle that deals hot ones.
SENT = 100_000


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size``: the number of words of every whole text."""
    words = F.size(F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.cast("long").alias("size"))


def numbered(keys: DataFrame, order: list) -> DataFrame:
    """Adds ``number`` from 0 in that order: ranges are counted, then numbered from their offsets."""
    parts = cut(keys.repartitionByRange(parallelism(keys.sparkSession), *order).withColumn("_part", F.spark_partition_id()))
    before = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    before = before.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    number = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.join(F.broadcast(before), "_part").withColumn("number", number).drop("_part", "_before")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds ``number`` and ``target`` to ``source, source_size, ...``, one row a source.

    Targets are the smaller of ``most`` times the size and a level times the weight. Each round takes the level at which
    those not stopped share what is left; it only rises, and ends when no further source is stopped.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("number"), F.lit(len(weights))).cast("int") + 1)
    own = cut(numbered(sources, [F.col("source").asc_nulls_last()]).withColumn("_weight", weight).withColumn("_most", F.col("source_size") * float(most)))
    every = own.agg(F.sum("source_size"), F.sum("_weight")).first()
    level, total = (float(every[0]) / every[1] if every[1] else 0.0), float(every[0] or 0)
    while True:
        above = F.col("_most") < F.lit(level) * F.col("_weight")
        held, free = own.agg(F.sum(F.when(above, F.col("_most")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("_weight")))).first()
        now = (total - held) / free if free else level
        if now <= level:
            break
        level = now
    return own.withColumn("target", F.least("_most", F.lit(level) * F.col("_weight"))).drop("_weight", "_most")


def moved(p: np.ndarray, u: np.ndarray, rng: np.random.Generator) -> None:
    """One step of ``p`` along ``u``, forth or back as far as the cube allows, with the odds that keep every mean."""
    with np.errstate(divide="ignore", invalid="ignore"):
        forth = np.min(np.where(u > 0, (1 - p) / u, np.where(u < 0, p / -u, np.inf)))
        back = np.min(np.where(u > 0, p / u, np.where(u < 0, (1 - p) / -u, np.inf)))
    p += u * (forth if rng.random() * (forth + back) < back else -back)
    np.clip(p, 0, 1, out=p)
    p[p < NEAR], p[p > 1 - NEAR] = 0, 1


def fly(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, longest: int = LONGEST) -> np.ndarray:
    """The probabilities of a block, sizes falling, after its flight: at most two are left between 0 and 1."""
    for k in range(min(longest, len(p) - 3)):
        while 0 < p[k] < 1:
            rest = k + 1 + np.flatnonzero((p[k + 1 :] > 0) & (p[k + 1 :] < 1))
            s = size[rest]
            if len(rest) < 2 or s[0] == s[-1]:
                break
            mean, spread = s.mean(), ((s - s.mean()) ** 2).sum()
            u = np.zeros_like(p)  # against the shorter ones: -1 in all, -size[k] in words, as evenly as can be
            u[k], u[rest] = 1, -1 / len(rest) - (size[k] - mean) * (s - mean) / spread
            moved(p, u, rng)
    active: list[int] = []
    for k in np.flatnonzero((p > 0) & (p < 1)).tolist():
        active.append(k)
        while len(active) == 3:
            a, b, c = (size[i] for i in active)
            u = np.array((b - c, c - a, a - b) if a != b or b != c else (1.0, -1.0, 0.0))
            own = p[active]
            moved(own, u / np.abs(u).max(), rng)
            p[active] = own
            active = [i for i, x in zip(active, own.tolist(), strict=True) if 0 < x < 1]
    return p


def land(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Draws what a flight left: two keep the words alone, the last one is drawn by its probability."""
    left = np.flatnonzero((p > 0) & (p < 1))
    while len(left):
        own = p[left]
        if len(left) > 1 and size[left[1]] > 0:
            u = np.zeros(len(left))
            u[0], u[1] = size[left[1]] / max(1.0, size[left[0]]), -1.0
        else:
            u = np.eye(len(left))[-1]
        moved(own, u, rng)
        p[left] = own
        left = np.flatnonzero((p > 0) & (p < 1))
    return p


def sampled(units: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """Decides ``p`` of ``number, doc_id, size, p`` (a unit once): rows of the same columns with ``p`` 0 or 1.

    One round flies every block of every source; sources that have a single block land. About ``block / 2`` times fewer
    units are left for the next.
    """

    def flown(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks().sort_by([("size", "descending"), ("doc_id", "ascending")])
        number, part, step, blocks = (rows[c][0].as_py() for c in ("number", "block", "round", "blocks"))
        rng = np.random.default_rng([seed, number, part, step])
        size = rows["size"].to_numpy().astype(float)
        p = fly(size, rows["p"].to_numpy().copy(), rng)
        return rows.select(["number", "doc_id", "size"]).append_column("p", pa.array(land(size, p, rng) if blocks == 1 else p))

    done, left, step = [], units, 0
    while True:
        many = left.groupBy("number").agg(F.count("*").alias("_n"))
        many = many.select("number", F.ceil(F.col("_n") / block).alias("blocks"), "_n")
        dealt = with_source(left, many).withColumn("block", F.pmod(F.xxhash64("doc_id", "size", F.lit(step)), F.col("blocks"))).withColumn("round", F.lit(step))
        now = cut(dealt.groupBy("number", "block").applyInArrow(flown, "number long, doc_id long, size long, p double"))
        if step:
            dropped(left)
        between = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(now.where(~between))
        left, step = now.where(between), step + 1
        if left.isEmpty():
            break
        left = cut(left)
    out = done[0]
    for rows in done[1:]:
        out = out.unionByName(rows)
    return out


def with_source(rows: DataFrame, sources: DataFrame, key: str = "number") -> DataFrame:
    """``rows`` with the columns of ``sources`` (``key``, ..., ``_n`` rows each): few sources are sent, more are joined."""
    sources = cut(sources)
    if sources.count() <= SENT:
        return rows.join(F.broadcast(sources.drop("_n")), key)
    return hot_join(rows, sources, key, "_n", "doc_id", limit=1_000_000)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """``doc_id, source, size, source_size, target, copies``: how often the mix takes each document."""
    one = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))  # null joins, too
    classes = cut(sizes(docs).groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")).withColumn("_source", one))
    sources = classes.groupBy("_source").agg(F.first("source").alias("source"), F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count("*").alias("_n"))
    aimed = targets(sources, weights, most).select("_source", "number", "source_size", "target", "_n")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    known = with_source(classes, aimed, "_source").drop("_source").withColumn("every", F.floor(ratio))
    wanted = F.col("m") * (ratio - F.col("every"))
    whole = F.floor(wanted + NEAR)
    known = cut(known.withColumn("more", whole).withColumn("p", F.greatest(wanted - whole, F.lit(0.0))))
    dropped(classes)
    flying = known.where(F.col("p") > NEAR)
    drawn = sampled(flying.select("number", "doc_id", "size", "p"), seed, block).where("p = 1")
    both = [F.col(f"k.{c}").eqNullSafe(F.col(f"d.{c}")) for c in ("number", "doc_id", "size")]
    rows = known.alias("k").join(drawn.alias("d"), both, "left").select("k.*", (F.col("more") + F.when(F.col("d.p") == 1, 1).otherwise(0)).alias("_more"))
    # of the m rows of a class, _more rows are taken once more; long runs of copies are made in parts
    parts = F.array(F.struct(F.col("_more").alias("n"), (F.col("every") + 1).alias("copies")), F.struct((F.col("m") - F.col("_more")).alias("n"), F.col("every").alias("copies")))
    rows = rows.select("doc_id", "source", "size", "source_size", "target", F.explode(parts).alias("part")).where("part.n > 0")
    runs = F.sequence(F.lit(0).cast("long"), F.floor((F.col("part.n") - 1) / 100_000))
    rows = rows.withColumn("run", F.explode(runs)).withColumn("times", F.least(F.lit(100_000).cast("long"), F.col("part.n") - F.col("run") * 100_000).cast("int"))
    return rows.withColumn("_", F.explode(F.array_repeat(F.lit(0), F.col("times")))).select("doc_id", "source", "size", "source_size", "target", F.col("part.copies").cast("long").alias("copies"))


def digest(mixed: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken``: words that the mix takes of each document, repeats counted."""
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
