"""FASTA in and out. Records are split by Spark's text source, so plain files are read by many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import upper_ascii


def read_fasta(spark: SparkSession, path: str | list[str], recursive: bool = False, pattern: str | None = None, with_file: bool = False) -> DataFrame:
    """``id, sequence`` (upper case), one row per record; plain, gzip and bzip2 by extension.

    ``id`` is the first token of the header. A compressed file is one task; repartition before heavy work.
    """
    reader = spark.read.option("lineSep", "\n>").option("recursiveFileLookup", recursive)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    text = F.regexp_replace("value", "^>", "")
    rows = reader.text(path).withColumn("file", F.col("_metadata.file_path")).withColumn("record", text)
    header, body = F.substring_index("record", "\n", 1), F.regexp_replace("record", r"^[^\n]*\n?", "")
    rows = rows.select(F.regexp_extract(header, r"^(\S*)", 1).alias("id"), upper_ascii(F.regexp_replace(body, r"\s", "")).alias("sequence"), "file").where("id <> ''")
    return rows if with_file else rows.drop("file")


def write_fasta(df: DataFrame, path: str, id_col: str = "id", sequence_col: str = "sequence", gzip: bool = False) -> None:
    """One record per row (S13); rows without an id or a sequence are written with an empty one."""
    line = F.format_string(">%s\n%s", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(sequence_col), F.lit("")))
    df.select(line.alias("value")).write.mode("overwrite").option("compression", "gzip" if gzip else "none").text(path)


def accession_of_file(col):
    """First two ``_`` parts of the file's base name."""
    return F.substring_index(F.element_at(F.split(col, "/"), -1), "_", 2)


def build_reference(records: DataFrame, accession_classes: DataFrame) -> DataFrame:
    """Each record gets the classes of its file's accession; species becomes two words rejoined by ``_``.

    ``records``: id, file; ``accession_classes``: accession, species and broader ranks.
    """
    named = records.withColumn("accession", accession_of_file(F.col("file")))
    words = F.split(F.trim("species"), r"\s+")
    two = F.array_join(F.slice(words, 1, 2), "_")
    return named.join(accession_classes, "accession").withColumn("species", two).drop("file", "accession")


def host_classes(records: DataFrame, species: str) -> DataFrame:
    """``id, species, domain`` with one species and the domain ``host``."""
    return records.select("id", F.lit(species).alias("species"), F.lit("host").alias("domain"))
