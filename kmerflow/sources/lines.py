"""Lines of text files with their numbers, counted in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str | list[str], per_file: bool = True) -> DataFrame:
    """``file, line, value``: lines that are not empty, numbered from 0 in each file, or through all files by name.

    Splits of a file are numbered on their own; a table of one row for each split tells how many lines stand before it.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    lines = lines.where(F.trim("value") != "")
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    order = Window.partitionBy("file").orderBy("block") if per_file else Window.orderBy("file", "block")
    before = counts.select("file", "block", (F.sum("n").over(order) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    return lines.withColumn("own", own).join(F.broadcast(before), ["file", "block"]).select("file", (F.col("before") + F.col("own")).alias("line"), "value")
