"""Class tables, vocabularies, profiles, dataset descriptors, text reports."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lineage_path
from .lines import numbered_lines


def read_classes(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """The class table and its ranks: all columns but ``id``, in file order, specific to broad."""
    df = spark.read.option("header", True).csv(path)
    return df, [c for c in df.columns if c != "id"]


def read_vocab(spark: SparkSession, path: str, k: int | None = None) -> tuple[DataFrame, int]:
    """``feature_idx, kmer`` in file order, and k, taken from the first line; another k given only warns."""
    rows = numbered_lines(spark, path, per_file=False).select(F.col("line").alias("feature_idx"), F.rtrim("value").alias("kmer"))
    first = rows.where("feature_idx = 0").first()
    found = len(first["kmer"]) if first else 0
    if k is not None and k != found:
        warnings.warn(f"k is {found} in the list, not {k}; the list's is taken", stacklevel=2)
    return rows, found


def write_vocab(vocab: DataFrame, path: str) -> None:
    """One k-mer a line, in the order of ``feature_idx`` (S9); files follow one another by name."""
    vocab.orderBy("feature_idx").select("kmer").write.mode("overwrite").text(path)


def load_profile(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A profile from one or many Parquet folders."""
    return spark.read.parquet(*([path] if isinstance(path, str) else path))


def save_profile(profile: DataFrame, path: str) -> None:
    """S11."""
    profile.write.mode("overwrite").parquet(path)


def save_dataset(spark: SparkSession, path: str, profile: DataFrame, vocab: DataFrame, meta: dict, reuse: bool = True) -> bool:
    """Profile, vocabulary and a one-row JSON descriptor in one folder; a dataset that is there is kept."""
    if reuse and _exists(spark, f"{path}/meta"):
        return False
    save_profile(profile, f"{path}/profile")
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return True


def load_dataset(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    return load_profile(spark, f"{path}/profile"), spark.read.parquet(f"{path}/vocab"), json.loads(spark.read.text(f"{path}/meta").first()["value"])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_csv(df: DataFrame, path: str, sep: str = ",", one_file: bool = False) -> None:
    """Summary, report, abundance and score tables (S14); ``one_file`` only for small ones."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, length`` of all files below a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")


def read_lineages(spark: SparkSession, path: str) -> DataFrame:
    """``magnitude, path`` from lines of a magnitude and tab-separated levels; comments are skipped."""
    levels = spark.read.text(path).select(lineage_path("value").alias("x")).where("x is not null and size(x) > 0")
    return levels.select(F.col("x")[0].cast("double").alias("magnitude"), F.slice("x", F.lit(2), F.size("x")).alias("path"))
