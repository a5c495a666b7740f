"""Spark side of byte-level BPE encoding and decoding. Both are scans: no shuffle, each row on its own.

Defined results: null or empty text has no ids and decodes to no bytes; an empty table gives an empty table; null ids
decode to no bytes; repeated rows give repeated results. A text of any length is handled whole; further
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Decoder, Encoder
from .common import slices, texts_of

_made: dict = {}


def made(kind, *args):
    """One encoder or decoder for each Python worker, kept from task to task."""
    key = (kind.__name__, *args)
    if key not in _made:
        _made[key] = kind(*args)
    return _made[key]


def _list_of(packed: list[bytes]) -> pa.Array:
    import numpy as np

    ends = np.cumsum([0, *(len(x) // 4 for x in packed)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def _decoded(decoder: Decoder, ids: list[int], part: int) -> bytes:
    return b"".join(decoder.stream(ids[k : k + part] for k in range(0, len(ids), part)))


def encode(df: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, ids array<int>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = made(Encoder, ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, 256):
                yield pa.RecordBatch.from_arrays([part.column(0), _list_of([encoder.packed(t) for t in part.column(1).to_pylist()])], names=["doc_id", "ids"])

    return texts_of(df).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, part: int = 4096) -> DataFrame:
    """``doc_id, ids, decoded binary``: streamed ``part`` ids at a time through the UTF-8 state machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = made(Decoder, ranks_path)
        for batch in batches:
            for rows in slices(batch, 256):
                out = [_decoded(decoder, ids, part) for ids in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    rows = encoded.select("doc_id", F.coalesce("ids", F.expr("cast(array() as array<int>)")).alias("ids"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def round_trip(df: DataFrame, ranks_path: str, pattern: str, part: int = 4096) -> DataFrame:
    """``encode``, then ``decode``, in one scan with one Python worker a task: ``doc_id, ids, decoded``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder, decoder = made(Encoder, ranks_path, pattern), made(Decoder, ranks_path)
        for batch in batches:
            for rows in slices(batch, 256):
                packed = [encoder.packed(t) for t in rows.column(1).to_pylist()]
                out = [_decoded(decoder, np.frombuffer(x, np.int32).tolist(), part) for x in packed]
                yield pa.RecordBatch.from_arrays([rows.column(0), _list_of(packed), pa.array(out, pa.binary())], names=["doc_id", "ids", "decoded"])

    return texts_of(df).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def codec_digest(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
