"""Target-distribution importance resampling by overlapped regex scanning.

A text becomes bytes in which every run of separators is one space. For each n one pattern, run by ``regex`` with
``overlapped=True``, gives every run of n words: a space to the left is matched and left out of the span (``\\K``), a
lookahead asks for one to the right. The CRC of each span's bytes, modulo the number of buckets, is its bucket.

The texts are scanned once: each document's buckets go to a table (two bytes a feature), from which counts over all
documents and then the weight of each document come. What leaves the tasks is a row a bucket. Scores are put in order by
range partitions with pre-aggregated offsets, so no task ranks all documents.

Defined results: null, empty and wordless texts have no features and weight 0; a null id reads as an empty one in the hash
and comes after the others in ties; repeated rows are ranked one after the other; with an empty target every gain follows
from the source alone; an empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, dropped, parallelism, slices, texts_of

BUCKETS, WORDS, PERCENT, LEAST_WORDS, SEED = 10_000, 2, 25, 20, 7
#: Bytes that are part of words: digits, ASCII letters, all of other characters. Upper case letters come as lower case.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))


def spaced(text: str) -> bytes:
    """Lower-case words, each between single spaces."""
    return b" %b " % b" ".join(text.encode().translate(PLAIN).split())


class Grams:
    """Buckets of all runs of 1 to ``words`` words of a text."""

    def __init__(self, words: int = WORDS, buckets: int = BUCKETS) -> None:
        import regex

        self.buckets = np.uint32(buckets)
        self.patterns = [regex.compile(rb" \K[^ ]++" + rb" [^ ]++" * n + rb"(?= )") for n in range(words)]

    def __call__(self, text: str) -> tuple[int, np.ndarray]:
        """(number of words, bucket of every run)."""
        line, crc = spaced(text), zlib.crc32
        found = [np.fromiter((crc(m[0]) for m in p.finditer(line, overlapped=True)), np.uint32) for p in self.patterns]
        return len(found[0]), np.concatenate(found) % self.buckets


def features(df: DataFrame, words: int = WORDS, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, features``: the buckets of all runs as packed unsigned integers."""
    kind = np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(words, buckets)
        for batch in batches:
            for part in slices(batch, 128):
                found = [grams(text) for text in part.column(1).to_pylist()]
                cols = [part.column(0).cast(pa.int64()), pa.array([n for n, _ in found], pa.int64()), pa.array([len(x) for _, x in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([x.astype(kind).tobytes() for _, x in found], pa.binary())], names=["doc_id", "n_words", "n_features", "features"])

    return texts_of(df).mapInArrow(run, "doc_id long, n_words long, n_features long, features binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how many features of all documents fall in each bucket; counted in the tasks before anything moves."""
    kind = np.dtype("<u2") if buckets <= 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for own in batch.column(0):
                counts += np.bincount(np.frombuffer(own.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["bucket", "n"])

    return found.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain`` of every bucket: 1000 times the log ratio of its shares in target and source, one added to each count."""
    both = source.withColumnRenamed("n", "s").join(target.withColumnRenamed("n", "t"), "bucket", "full").fillna(0)
    every = both.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(both, "bucket", "left").fillna(0)
    sums = every.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = ((F.col("t") + 1.0) * (F.col("all_s") + float(buckets))) / ((F.col("s") + 1.0) * (F.col("all_t") + float(buckets)))
    return every.crossJoin(F.broadcast(sums)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))  # one row beside each


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the floored mean of the gains over a document's features."""
    kind = np.dtype("<u2") if len(gain) <= 1 << 16 else np.dtype("<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [gain[np.frombuffer(x.as_buffer(), kind)] for x in batch.column(3)]
            mean = [int(x.sum()) // len(x) if len(x) else 0 for x in own]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(mean, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return found.select("doc_id", "n_words", "n_features", "features").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, draw: int, order: list) -> DataFrame:
    """Adds ``rank`` (1, 2, ... in that order; null beyond ``draw``): ranges are counted, then numbered from their offsets."""
    n = parallelism(scored.sparkSession)
    parts = cut(scored.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    before = parts.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range
    before = before.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(F.broadcast(before), "_part").withColumn("rank", rank).drop("_part", "_before").withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")).cast("long"))


def resample(docs: DataFrame, target: DataFrame, words: int = WORDS, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank``: ``docs`` drawn without repeats towards the texts of ``target``.

    The score is the weight and a Gumbel variate of the hashed id, both in thousandths; the highest of the documents with
    ``least_words`` words or more are drawn.
    """
    found = cut(features(docs, words, buckets))
    gain = np.zeros(buckets, np.int64)
    aim = features(target.select(F.lit(None).alias("doc_id"), "text"), words, buckets)
    for row in gains(bucket_counts(found, buckets), bucket_counts(aim, buckets), buckets).collect():  # a row a bucket
        gain[row["bucket"]] = row["gain"]
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = cut(weights(found, gain).withColumn("score", F.col("weight") + noise))
    dropped(found)
    fit = F.col("n_words") >= least_words
    draw = scored.where(fit).count() * percent // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    rest = scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return ranked(scored.where(fit), draw, order).unionByName(rest)


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, all columns kept (rows without an id or a drawn one are left out)."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col("text"))
    ids = resample(own, target, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, docs[id_col].cast("long") == ids["_drawn"], "left_semi")
