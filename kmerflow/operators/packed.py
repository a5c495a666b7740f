"""k-mers of the four letters as packed codes, two bits a letter: made and counted in the tasks that read the sequences.

Windows come from shifts over whole Arrow buffers: codes of width w from those of half of it, so k letters take log2(k) steps.
One word holds 32 letters, two hold 64. Codes sort as their k-mers do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LETTERS, OTHER, WORD, MOST = b"ACGT", 4, 32, 64
#: Bytes of sequences, and k-mers, that are worked on at once.
PART, OUT = 1 << 18, 1 << 17
#: Batches for Python hold at most so many rows and bytes; by the session's 10,000 rows, one of long chunks has 650 MB.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


@cache
def code_of() -> np.ndarray:
    """Code of each byte, either case; ``OTHER`` for what is no letter."""
    out = np.full(256, OTHER, np.uint8)
    for k, c in enumerate(LETTERS):
        out[c] = out[c + 32] = k
    return out


@cache
def eight_letters() -> np.ndarray:
    """The eight letters of each 16-bit code, as one number of eight bytes."""
    codes = np.arange(1 << 16)
    letters = np.frombuffer(LETTERS, np.uint8)
    return np.stack([letters[(codes >> shift) & 3] for shift in range(14, -1, -2)], axis=1).copy().view(np.uint64).ravel()


def _window(made: dict[int, np.ndarray], width: int) -> np.ndarray:
    """The packed window of ``width`` letters at each place, from those of half of it. Not a closure that calls itself: its
    cycle of references would keep all of ``made`` until the collector comes by, which few objects bring about."""
    if width not in made:
        right = width // 2
        left = _window(made, width - right)
        made[width] = (left[: len(made[1]) - width + 1] << np.uint64(2 * right)) | _window(made, right)[width - right :]
    return made[width]


def windows(codes: np.ndarray, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The packed window at each place, leading word first, and whether it holds letters alone."""
    n, made = len(codes) - k + 1, {1: (codes & 3).astype(np.uint64)}
    words = [_window(made, k)] if k <= WORD else [_window(made, k - WORD)[:n], _window(made, WORD)[k - WORD :]]
    other = np.concatenate([[0], np.cumsum(codes == OTHER)])
    return words, other[k:] == other[:-k]


def letters_of(words: list[np.ndarray], k: int) -> pa.Array:
    """The k-mers of packed codes as Arrow strings."""
    n = len(words[0])
    places = [(w, shift) for w in words for shift in (48, 32, 16, 0)][-(-(-k // 8)) :]
    parts = [eight_letters()[(w >> np.uint64(shift)) & np.uint64(0xFFFF)] for w, shift in places]
    bytes_ = np.stack(parts, axis=1).view(np.uint8).reshape(n, -1)[:, len(parts) * 8 - k :]
    return pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, (n + 1) * k, k, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(bytes_)))


def counted(words: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Different codes in order, and how often each occurs."""
    if len(words) == 1:
        own = np.sort(words[0])
        new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        words = [own]
    else:
        order = np.lexsort(words[::-1])
        words = [w[order] for w in words]
        new = np.flatnonzero(np.concatenate([[True], (words[0][1:] != words[0][:-1]) | (words[1][1:] != words[1][:-1])]))
    return [w[new] for w in words], np.diff(np.append(new, len(words[0])))


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``PART`` bytes of its second column."""
    at = np.frombuffer(batch.column(1).buffers()[1], np.int32, len(batch) + 1, batch.column(1).offset * 4) if len(batch) else np.zeros(1, np.int32)
    start = 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(at, at[start] + PART, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def runs(part: pa.RecordBatch, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Codes of all windows of ``id, s, short`` that count, and the number of them in each row. ``short``: windows left out at the end."""
    column = part.column(1)
    at = np.frombuffer(column.buffers()[1], np.int32, len(part) + 1, column.offset * 4)
    data = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]] if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = (at - at[0]).astype(np.int64)
    if len(data) < k:
        return [np.zeros(0, np.uint64)] * (1 + (k > WORD)), np.zeros(len(part), np.int64)
    words, plain = windows(code_of()[data], k)
    marks = np.zeros(len(data) + 2, np.int64)
    end = np.maximum(at[1:] - k + 1 - part.column(2).to_numpy(), at[:-1])
    np.add.at(marks, at[:-1], 1)
    np.add.at(marks, end, -1)
    keep = np.flatnonzero(plain & (np.cumsum(marks)[: len(plain)] > 0))
    return [w[keep] for w in words], np.diff(np.searchsorted(keep, at))


def bounded(rows: DataFrame) -> DataFrame:
    """``rows``, with the session's batches for Python lowered to ``BATCH_ROWS`` and ``BATCH_BYTES``."""
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows


def whole(seqs: DataFrame, include_last: bool, id_col: str = "id", sequence_col: str = "sequence") -> DataFrame:
    """``id, s, short`` of sequences as they are. No filter by length: pushed down, it would make derived sequences twice."""
    return bounded(seqs.select(F.col(id_col).alias("id"), F.col(sequence_col).alias("s"), F.lit(int(not include_last)).alias("short")))


def chunks(seqs: DataFrame, k: int, include_last: bool, chunk: int, id_col: str = "id", sequence_col: str = "sequence") -> DataFrame:
    """``id, s, short``: sequences cut so that no row is longer than about ``chunk``; parts overlap by k - 1."""
    rows = bounded(seqs.select(F.col(id_col).alias("id"), F.col(sequence_col).alias("s")))
    last = F.coalesce(F.expr(f"greatest(0, cast((length(s) - {k}) div {chunk} as int))"), F.lit(0))
    cut = rows.select("id", "s", F.explode_outer(F.sequence(F.lit(0), last)).alias("c"))
    ends = F.expr(f"c * {chunk} + {chunk + k} > length(s)")  # no window begins behind this part
    return cut.select("id", F.expr(f"substring(s, c * {chunk} + 1, {chunk + k - 1})").alias("s"), F.when(ends, int(not include_last)).otherwise(0).alias("short"))


def counted_rows(part: pa.RecordBatch, k: int) -> tuple[list[np.ndarray], np.ndarray, list[int]]:
    """Codes and counts of each row of ``id, s, short``, one row after the other, and how many each row has."""
    words, sizes = runs(part, k)
    found, at = [], 0
    for n in sizes.tolist():
        found.append(counted([w[at : at + n] for w in words]) if n else ([w[:0] for w in words], np.zeros(0, np.int64)))
        at += n
    return [np.concatenate(w) for w in zip(*(x[0] for x in found), strict=True)], np.concatenate([x[1] for x in found]), [len(x[1]) for x in found]


def row_counts(rows: DataFrame, k: int) -> DataFrame:
    """``id, kmer, value`` of each row of ``id, s, short``, counted where it is read."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch):
                codes, counts, lengths = counted_rows(part, k)
                owner = np.repeat(np.arange(len(part)), lengths)
                for k0 in range(0, len(counts), OUT):
                    own = slice(k0, k0 + OUT)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[own])), letters_of([w[own] for w in codes], k), pa.array(counts[own].astype(float))], names=["id", "kmer", "value"])

    return rows.select("id", "s", "short").mapInArrow(run, f"id {kind}, kmer string, value double")


def codes_of(kmers: list[str]) -> np.ndarray:
    """Packed codes of k-mers of one length, up to ``WORD`` letters."""
    k = len(kmers[0]) if kmers else 1
    return windows(code_of()[np.frombuffer("".join(kmers).encode(), np.uint8)], k)[0][0][::k] if kmers else np.zeros(0, np.uint64)


def row_weights(rows: DataFrame, k: int, codes: np.ndarray, factors: np.ndarray) -> DataFrame:
    """``id, kmer, value`` of rows of ``id, s, short`` that are whole samples: counts times the factor of the k-mer, each sample
    scaled to length one. ``codes``: all k-mers, in order, of up to ``WORD`` letters."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch):
                (found,), counts, lengths = counted_rows(part, k)
                if not len(found):
                    continue
                owner = np.repeat(np.arange(len(part)), lengths)
                values = counts * factors[np.searchsorted(codes, found)]
                norm = np.sqrt(np.bincount(owner, values * values, len(part)))
                values = values / np.where(norm > 0, norm, 1.0)[owner]
                for k0 in range(0, len(values), OUT):
                    own = slice(k0, k0 + OUT)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[own])), letters_of([found[own]], k), pa.array(values[own])], names=["id", "kmer", "value"])

    return rows.select("id", "s", "short").mapInArrow(run, f"id {kind}, kmer string, value double")


def row_sums(rows: DataFrame, k: int) -> DataFrame:
    """``kmer, df, total, squares`` of rows of ``id, s, short`` that are whole samples, summed within each part only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch):
                codes, counts, _ = counted_rows(part, k)
                if not len(counts):
                    continue
                order = np.lexsort(codes[::-1]) if len(codes) > 1 else np.argsort(codes[0])
                codes, counts = [w[order] for w in codes], counts[order].astype(float)
                start = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([w[1:] != w[:-1] for w in codes])]))
                held = np.diff(np.append(start, len(counts)))
                total, squares = np.add.reduceat(counts, start), np.add.reduceat(counts * counts, start)
                for k0 in range(0, len(start), OUT):
                    own = slice(k0, k0 + OUT)
                    yield pa.RecordBatch.from_arrays([letters_of([w[start[own]] for w in codes], k), *(pa.array(x[own]) for x in (held, total, squares))], names=["kmer", "df", "total", "squares"])

    return rows.select("id", "s", "short").mapInArrow(run, "kmer string, df long, total double, squares double")


def total_counts(rows: DataFrame, k: int) -> DataFrame:
    """``kmer, n`` over all rows: counted part by part, then by packed code, and spelled at the end."""
    names = ["hi", "lo"][-1 - (k > WORD) :]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch):
                words, _ = runs(part, k)
                if len(words[0]):
                    codes, counts = counted(words)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in codes), pa.array(counts, pa.int64())], names=[*names, "n"])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [batch.column(c).to_numpy().view(np.uint64) for c in range(len(names))]
            yield pa.RecordBatch.from_arrays([letters_of(words, k), batch.column(len(names))], names=["kmer", "n"])

    found = rows.select("id", "s", "short").mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", n long")
    return found.groupBy(*names).agg(F.sum("n").alias("n")).mapInArrow(spelled, "kmer string, n long")
