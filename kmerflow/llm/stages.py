"""The stages of the corpus pipeline. Each keeps the columns of ``documents``, further ones too, but for the last.

Defined results: null texts count as empty and stay null; rows without an id stay (they are no near duplicates of any);
of rows of equal id one goes on past the near duplicates; an empty table stays empty.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, with_checkpoint_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet in the shared checkpoint folder, and read again."""
    spark = df.sparkSession
    with_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones of ``docs``, accepts."""
    from .quality import fit, keep_good

    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    from .jaccard import keep_one

    return keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; ``n_chars`` follows the text."""
    from .secrets import redact

    names = docs.columns
    at, n = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    kind = docs.schema["n_chars"].dataType.typeName() if n is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(at).to_pylist()
                clean = [t if t is None else redact(t) for t in texts]
                cols = list(part.columns)
                if clean != texts:
                    cols[at] = pa.array(clean, cols[at].type)
                    if n is not None and kind in ("long", "integer"):
                        counts = [m if a == b else len(b) for m, a, b in zip(cols[n].to_pylist(), texts, clean, strict=True)]
                        cols[n] = pa.array(counts, cols[n].type)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences."""
    from .packing import pack
    from .queries import PATTERN, RANKS

    return pack(docs, RANKS, PATTERN)
