"""Cutting long lineages in iterative operators; global row numbers."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. In local mode a folder of its own does; a cluster must name one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read again. A table has its true size, where the estimates that a checkpoint
    hands on would multiply in every join of a loop."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._steps = [path]
    atexit.register(removed, spark, path)  # what a result still reads goes when the session ends
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of the shared folder, wherever that is; a session that has ended deletes nothing more."""
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(*steps: DataFrame) -> None:
    """Deletes tables that ``cut`` wrote, once nothing reads them any more."""
    for df in steps:
        for path in getattr(df, "_steps", []):
            removed(df.sparkSession, path)
        df._steps = []


def with_position(df: DataFrame, order: list[str], name: str = "_pos") -> DataFrame:
    """Global position by ``order``, from 0: ranges of the sort are numbered on their own and moved by what stands before."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row for each range
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_before")
