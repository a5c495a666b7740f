"""Small helpers the operators share: table access, Arrow scans, checkpoints, connected components."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), under the names the scans use; other columns never get in the way.

    Texts are long rows: batches for Python keep to ``BATCH_ROWS``, so that workers stay small.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def scan(df: DataFrame, row: Callable[[int | None, str], tuple], schema: str, names: list[str], types: list[pa.DataType]) -> DataFrame:
    """One output row for each (doc_id, text): ``row`` gives the values in the order of ``names``. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = [row(i, t) for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=names)

    return texts_of(df).mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batch in parts of a few rows, so that what a part needs in memory stays small."""
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def utf8_buffer(column: pa.Array):
    """(bytes as uint8, offsets) of a string column without making Python strings."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    buffers, n, at = column.buffers(), len(column), column.offset
    offsets = np.frombuffer(buffers[1], np.int64, n + 1, at * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if n else data[:0], offsets - (offsets[0] if n else 0)


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the cluster's shared folder. In local mode, as in tests, a folder of its own does; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows are written as a table in the shared checkpoint folder and survive lost executors.

    Unlike a checkpoint, a table has its true size: estimates carried on from step to step multiply in each join of a loop,
    until planning takes longer than the work. The shuffle files that made the rows go at once, so that the disk holds one
    step's.
    """
    spark, clean = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with_checkpoint_dir(spark)
    path, before = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}", spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(clean, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._steps = [path]
    atexit.register(removed, spark, path)  # what a result still reads goes when the session ends
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of the checkpoint folder, wherever that is; a session that has ended deletes nothing more."""
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*steps: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote, once nothing reads them any more."""
    for df in steps:
        for path in getattr(df, "_steps", []):
            removed(df.sparkSession, path)
        df._steps = []


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


SHARE = 64


def hot_join(rows: DataFrame, per_key: DataFrame, key: str, weight: str, salt: str, how: str = "inner", limit: int | None = None) -> DataFrame:
    """``rows.join(per_key, key, how)`` where a key may hold much of ``rows``.

    ``per_key`` has one row for each key and in ``weight`` how many rows have it. Fewer than ``SHARE`` keys can hold more
    than that part of all rows: these are sent to all tasks, and rows of such a key are dealt over ``SHARE`` tasks by a
    hash of the column ``salt``. With ``limit``, keys of more rows than that are hot, and ``per_key`` is not checkpointed.
    """
    if limit is None:
        per_key = cut(per_key)
        limit = (per_key.agg(F.sum(weight)).first()[0] or 0) // SHARE
    hot = F.broadcast(per_key.where(F.col(weight) > F.lit(limit)).select(key, F.lit(True).alias("_hot")))
    one = F.when(F.col("_hot"), F.pmod(F.xxhash64(salt), F.lit(SHARE)).cast("int")).otherwise(F.lit(0))
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SHARE - 1))).otherwise(F.array(F.lit(0)))
    left = rows.join(hot, key, "left").withColumn("_salt", one).drop("_hot")
    right = per_key.drop(weight).join(hot, key, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [key, "_salt"], how).drop("_salt")


EDGES_PER_TASK = 250_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of undirected ``edges(a long, b long)``: ``(node, component)`` of all nodes but the smallest
    of each component, component = smallest node.

    While there are more than ``EDGES_PER_TASK`` edges, alternating large-star and small-star steps on DataFrames bring
    every node nearer to its smallest; each step pre-aggregates the smallest neighbour on the map side. What fits a task
    of that size is united there, with the same result. Lineage is cut every round. The number of rounds grows with the
    logarithm of the number of nodes; a run that does not end in ``rounds`` rounds raises.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        if now[0] <= EDGES_PER_TASK:
            return e.coalesce(1).mapInArrow(united, "node long, component long")
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("held")).withColumn("m", F.least("m", "u"))
        # large star: neighbours greater than u point to the smallest in u's neighbourhood
        large = hot_join(both.where("v > u"), low, "u", "held", "v", limit=max(1000, now[0] // SHARE)).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each node's smaller neighbours and itself point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of the edges of one task."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(u), top(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], names=["node", "component"])
