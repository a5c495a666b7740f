"""Best-fit packing of token sequences by bulk-synchronous rounds of successor sweeps.

Pieces of one length are a run ``(length, first rank, how many)``, sequences of one gap are runs ``(gap, first number, how
many)``. The runs are a DataFrame that each round replaces by a written one; the driver only asks whether runs are left. A
round takes the pieces longer than half of the longest left, sorts them and the gaps by size, largest pieces first, and

1. sends each piece to its successor, the smallest gap that holds it. What it leaves is smaller still, so equal pieces go on
   to the same sequence while they fit; the r-th of them takes the (r / q)-th sequence of a run whose gap holds q, so ranks
   decide between pieces that want the same gap and none is taken twice;
2. opens sequences for pieces that no gap holds, as many as these fill;
3. updates the gaps.

This is best fit decreasing, piece for piece, whatever the lengths (tested against a plain loop over pieces). Halving ends
after at most ``1 + log2(capacity)`` rounds. A length leaves at most one run partly filled and splits at most one in two, so
there are fewer than ``4 * capacity`` runs, however large the corpus; what a piece leaves of a gap is less than half of it,
so a run is filled at most ``log2(capacity)`` times. A sweep over so few rows is one task. Its placements are a small table,
(length, ranks) -> (sequences, offset). The work that grows with the corpus is spread: encoding, ranking pieces within
their length by salted windows with pre-aggregated offsets (a length that a third of all pieces share is spread over many
windows), and looking each piece up.

Defined results: null or empty text has only the end id; repeated rows are packed once each; no row is dropped; an empty
table gives an empty table; further columns of the input are not looked at.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import WordTable, check_pattern, load_ranks, words_of
from .bpe_codec import made
from .common import cut, dropped, parallelism, slices, texts_of

CAPACITY, END_ID = 1024, 2


class IdBytes:
    """Ids of a text as little-endian unsigned 32-bit bytes."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import numpy as np
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=check_pattern(pattern), mergeable_ranks=load_ranks(ranks_path), special_tokens={})
        self.words = WordTable(lambda word: np.array(encoding.encode_ordinary(word), "<u4").tobytes())

    def __call__(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, words_of(text)))


def pieces(df: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids`` if asked for), one row per piece."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = made(IdBytes, ranks_path, pattern)
        for batch in batches:
            for part in slices(batch, 256):
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = memoryview((ids_of(text) if text else b"") + end)
                    n = len(ids) // 4
                    first = n - capacity * (-(-n // capacity) - 1)
                    start, k = 0, 0
                    while start < n:
                        stop = first if k == 0 else start + capacity
                        own = ids[4 * start : 4 * stop]
                        rows.append((doc_id, k, start, stop - start, zlib.crc32(own), bytes(own) if with_ids else None))
                        start, k = stop, k + 1
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                arrays = [pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    made_rows = texts_of(df).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary")
    return made_rows if with_ids else made_rows.drop("ids")


PLACED = ["length", "rank", "together", "units", "first", "offset"]
#: Runs: gaps (size, first, n), pieces left (size = length, first = rank, n), the number of sequences opened (n).
GAP, LEFT, OPENED = 0, 1, 2
RUNS = "kind int, size long, first long, n long, placed struct<length:long,rank:long,together:long,units:long,first:long,offset:long>"


def one_round(gaps: list[tuple[int, int, int]], left: list[tuple[int, int, int]], opened: int, capacity: int):
    """The gaps, the runs left, the number of sequences opened and the placements (``PLACED``) after one round."""
    runs: dict[int, list[tuple[int, int]]] = {}
    for size, first, n in gaps:
        runs.setdefault(size, []).append((first, n))
    sizes, placed, half = sorted(runs), [], max((x[0] for x in left), default=0) // 2

    def put(size: int, first: int, n: int) -> None:
        if size and n:
            if size not in runs:
                insort(sizes, size)
            runs.setdefault(size, []).append((first, n))

    for length, rank, n in sorted((x for x in left if x[0] > half), reverse=True):
        while n:
            at = bisect_left(sizes, length)
            if at == len(sizes):
                more = -(-n // (capacity // length))
                put(capacity, opened, more)
                opened += more
                continue
            size = sizes[at]
            first, m = runs[size].pop()
            if not runs[size]:
                del runs[size], sizes[at]
            together = min(n, size // length)
            units = min(m, n // together)
            placed.append((length, rank, together, units, first, capacity - size))
            put(size - together * length, first, units)
            put(size, first + units, m - units)
            rank, n = rank + units * together, n - units * together
    return [(size, *run) for size, own in runs.items() for run in own], [x for x in left if x[0] <= half], opened, placed


def plan(runs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rounds over ``length long, n long``: placements ``PLACED``, (length, ranks) -> (sequences, offset).

    Units ``rank, rank + together, ...`` of ``together`` pieces go to sequences ``first, first + 1, ...``, side by side from
    ``offset`` on. The number of rows depends on lengths and capacity, not on how many pieces there are.
    """

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        own = {kind: sorted(r[1:4] for r in rows if r[0] == kind) for kind in (GAP, LEFT, OPENED)}
        before = [r[4] for r in rows if r[4] is not None]
        gaps, left, opened, placed = one_round(own[GAP], own[LEFT], own[OPENED][0][2] if own[OPENED] else 0, capacity)
        out = [(GAP, *g, None) for g in gaps] + [(LEFT, *x, None) for x in left] + [(OPENED, 0, 0, opened, None)]
        out += [(None, None, None, None, x) for x in [*before, *(dict(zip(PLACED, x, strict=True)) for x in placed)]]
        types = [pa.int32(), *[pa.int64()] * 3, pa.struct([(c, pa.int64()) for c in PLACED])]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["kind", "size", "first", "n", "placed"])

    none = F.lit(None).cast("struct<" + ",".join(f"{c}:long" for c in PLACED) + ">")
    state = cut(runs.select(F.lit(LEFT).alias("kind"), F.col("length").alias("size"), F.lit(0).cast("long").alias("first"), "n", none.alias("placed")).coalesce(1))
    while not state.where(F.col("kind") == LEFT).isEmpty():
        now = cut(state.coalesce(1).mapInArrow(swept, RUNS))
        dropped(state)
        state = now
    return state.where("placed is not null").select("placed.*")


def with_ranks(rows: DataFrame, key: str, keys: int, order: list[str], buckets: int) -> DataFrame:
    """Adds ``rank``, from 0 within each ``key``, without one task per key: windows by (key, bucket) plus offsets.

    There are at most ``keys`` keys, so at most ``keys * buckets`` offsets; they are broadcast only if these are few.
    """
    salted = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = salted.groupBy(key, "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy(key).orderBy("bucket")) - F.col("n")).drop("n")
    own = F.row_number().over(Window.partitionBy(key, "bucket").orderBy(*order)) - 1
    before = F.broadcast(before) if keys * buckets <= 1 << 18 else before
    return salted.withColumn("own", own).join(before, [key, "bucket"]).withColumn("rank", F.col("before") + F.col("own")).drop("bucket", "own", "before")


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces of at most ``capacity`` tokens."""
    placed = plan(rows.groupBy("length").agg(F.count("*").alias("n")), capacity)
    by_length = placed.groupBy("length").agg(F.sort_array(F.collect_list(F.struct(*PLACED[1:]))).alias("placed"))
    ranked = with_ranks(rows, "length", capacity, ["doc_id", "piece", "start", "ids_crc32"], parallelism(rows.sparkSession))
    found = ranked.join(F.broadcast(by_length), "length")  # a row for each length, its placements bounded by the rounds
    found = found.withColumn("own", F.element_at(F.expr("filter(placed, x -> x.rank <= rank)"), -1))
    ahead = F.col("rank") - F.col("own.rank")
    unit, within = F.floor(ahead / F.col("own.together")), F.pmod(ahead, F.col("own.together"))
    return found.select(*rows.columns, (F.col("own.first") + unit).alias("sequence_id"), (F.col("own.offset") + within * F.col("length")).alias("offset"))


def pack(df: DataFrame, ranks_path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every row."""
    return place(cut(pieces(df, ranks_path, pattern, capacity, end_id)), capacity)
