"""Corpus pipeline over ``documents``: quality, near duplicates, secrets, packing.

Each stage takes all that the one before kept, is written as Parquet and read again by the next. All but the last return
the columns of documents. Defined results: null texts count as empty; a null id stays; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kmerflow.llm import stages

#: (name, function of (spark, docs, sf_dir)).
STAGES = [
    ("quality", stages.quality),
    ("near_duplicates", stages.near_duplicates),
    ("secrets", stages.secrets),
    ("packing", stages.packing),
]

#: SQL can express neither a trained score nor best-fit packing; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what each returns goes to the shared checkpoint folder before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stages.written(docs, name)
    return docs
