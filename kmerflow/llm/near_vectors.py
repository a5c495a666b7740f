"""Embedding near-dedup by sorted projection passes.

1. Vectors are brought to length one in double precision; equal vectors become one row with a count.
2. A pass orders all rows lexicographically by concatenated random hashes (the signs towards random hyperplanes, then
   projections) and compares neighbours. The first ``WARM`` passes compare each row with the ``WINDOW`` rows before it and
   hand the last rows of a range on to the next range. They bring most linked rows together cheaply; nothing below relies
   on them.
3. A fixed window loses partners where many rows share a hash, so the further passes compare all rows that share the first
   ``depth_for`` signs, however many: runs of up to ``DENSE`` rows in one task, longer ones in blocks (see 4), leaving out
   rows joined already. Two vectors at angle t share each sign with probability 1 - t / pi whatever else the table holds,
   so as many passes are made as bring the chance to miss a pair at the threshold below ``MISS``.
4. Exact rest: passes see only some links of a dense group. The rows of each part are packed in blocks of ``BLOCK``
   neighbours with a pivot and a radius. Where the triangle inequality of angles tells that two blocks are linked whole or
   not at all, they are not compared; the others are, and every link is counted, none emitted. Pairs of blocks are dealt
   in tiles, so that no task holds a group.

A pair of rows counts if its cosine is at least the threshold, computed in double precision.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and vectors of another
dimension than most, link with nothing; a null id keeps its row; rows of equal id are one node whose links add up;
an empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, hot_join, parallelism

THRESHOLD, WINDOW, MISS, BITS = 0.95, 24, 1e-6, 48
WARM, BUCKET, DENSE, AT_ONCE = 2, 1024, 4096, 6
BLOCK, TILE, CHUNK, MARGIN, FEW, ROWS_A_TASK = 256, 8, 64, 1e-6, 100_000, 4000


def depth_for(rows: int, bucket: int = BUCKET) -> int:
    """Signs of a bucket, so that evenly spread rows come to ``bucket`` or fewer in each; 0: all rows in one."""
    return min(BITS, math.ceil(math.log2(max(1.0, rows / bucket))))


def passes_for(rows: int, threshold: float = THRESHOLD, bucket: int = BUCKET, miss: float = MISS) -> int:
    found = (1 - math.acos(threshold) / math.pi) ** depth_for(rows, bucket)
    return 1 if found == 1 else max(1, math.ceil(math.log(miss) / math.log(1 - found)))


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v array<double>`` of the vectors that can link."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", finite) & F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array):
    """Rows of equal length as a matrix of unit rows in double precision."""
    import numpy as np

    values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    values = values / np.abs(values).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more partitions than its rows need, so that many small tasks do not wait on Python; no shuffle."""
    return df.coalesce(max(8, rows // ROWS_A_TASK))


def planes(number: int, dimension: int):
    import numpy as np

    return np.random.default_rng(1000 + number).normal(size=(dimension, BITS + 2))


def in_order(rows: DataFrame, number: int, dimension: int, group: list[str]) -> DataFrame:
    """``rows`` dealt by ranges and sorted by ``group``, then by the concatenated hashes of pass ``number``."""
    import numpy as np

    names, at = rows.columns, rows.columns.index("v")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = planes(number, dimension)
        for batch in batches:
            if batch.num_rows:
                made = matrix(batch.column(at)) @ p
                key = ((made[:, :BITS] > 0) @ (1 << np.arange(BITS, dtype=np.int64)[::-1])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key), pa.array(made[:, BITS]), pa.array(made[:, BITS + 1])], names=[*names, "key", "one", "two"])

    made = rows.mapInArrow(keyed, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", key long, one double, two double")
    order = [*group, "key", "one", "two", "node"]
    return made.repartitionByRange(parallelism(rows.sparkSession), *order).sortWithinPartitions(*order).drop("key", "one", "two")


class Forest:
    """Parts joined so far in one task."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart."""
        a, b = self.top(a), self.top(b)
        if a != b:
            self.parent[a] = b
        return a != b


def pairs_of(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])


def window_links(ids, rows, fresh: int, window: int, threshold: float, forest: Forest) -> list[tuple[int, int]]:
    """Links of the rows from ``fresh`` on with the ``window`` rows before each, but for those between joined parts."""
    import numpy as np

    out = []
    for step in range(1, min(window, len(ids) - 1) + 1):
        lo = max(0, fresh - step)
        cos = np.einsum("ij,ij->i", rows[lo : len(rows) - step], rows[lo + step :])
        for k in np.flatnonzero(cos >= threshold) + lo:
            if forest.join(int(ids[k]), int(ids[k + step])):
                out.append((int(ids[k]), int(ids[k + step])))
    return out


def one_pass(reps: DataFrame, number: int, dimension: int, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """One sorted pass: links ``a, b`` that the windows see, a spanning forest for each range of the sort; and the first and
    last ``window`` rows of each range (``a`` alone), for the windows across its bounds."""
    import numpy as np
    from pyspark import TaskContext

    names = ["a", "b", "pass", "range", "tail", "at", "v"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.float64())]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, ids, rows, head, here = Forest(), np.zeros(0, np.int64), np.zeros((0, dimension)), [], TaskContext.get().partitionId()

        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            own = matrix(batch.column(1))
            head += [(int(i), v.tolist()) for i, v in zip(batch.column(0).to_numpy()[: window - len(head)], own, strict=False)]
            fresh, ids, rows = len(ids), np.concatenate([ids, batch.column(0).to_numpy()]), np.concatenate([rows, own])
            found = window_links(ids, rows, fresh, window, threshold, forest)
            ids, rows = ids[-window:], rows[-window:]
            if len(forest.parent) > 1_000_000:
                forest.parent.clear()  # only repeats links already given
            if found:
                yield made([(x, y, number, here, None, None, None) for x, y in found])
        if head:
            yield made([(i, None, number, here, False, k, v) for k, (i, v) in enumerate(head)] + [(int(i), None, number, here, True, k, v.tolist()) for k, (i, v) in enumerate(zip(ids, rows, strict=True))])

    return in_order(reps.select("node", "v"), number, dimension, []).mapInArrow(compared, "a long, b long, pass int, range int, tail boolean, at int, v array<double>")


def window_passes(reps: DataFrame, rows: int, numbers: Iterable[int], dimension: int, threshold: float, window: int = WINDOW) -> DataFrame:
    """Links ``a, b`` of sorted passes, those across the bounds of ranges with them."""
    import numpy as np

    made = gathered(cut(reduce(DataFrame.unionByName, [one_pass(reps, k, dimension, threshold, window) for k in numbers])), rows)
    ends = made.where("b is null")
    place = ends.select("pass", "range").distinct().withColumn("place", F.row_number().over(Window.partitionBy("pass").orderBy("range")))  # a row for each range
    ends = ends.join(F.broadcast(place), ["pass", "range"]).withColumn("bound", F.col("place") - F.when(F.col("tail"), 0).otherwise(1))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 2):
            if rows[0][2] and not rows[-1][2]:
                found = window_links([r[4] for r in rows], np.array([r[5] for r in rows]), sum(r[2] for r in rows), window, threshold, Forest())
                if found:
                    yield pairs_of(found)

    ends = ends.repartition(parallelism(reps.sparkSession), "pass", "bound").sortWithinPartitions("pass", "bound", F.desc("tail"), "at")
    return made.where("b is not null").select("a", "b").unionByName(ends.select("pass", "bound", "tail", "at", "a", "v").mapInArrow(across, "a long, b long"))


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows of equal first columns, as lists, from sorted rows; meant for runs of bounded length."""
    held, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != held:
                if rows:
                    yield rows
                held, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield rows


def signed(placed: DataFrame, numbers: list[int], depth: int, dimension: int, vectors: bool = True) -> DataFrame:
    """``bucket, node, part`` and, if wanted, ``v``: each row once for each pass of ``numbers``."""
    import numpy as np

    names = ["bucket", "node", "part", "v"][: 4 if vectors else 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = [(k, planes(k, dimension)[:, :depth]) for k in numbers]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = matrix(batch.column(2))
            for k, p in drawn:
                key = ((rows @ p > 0) @ (1 << np.arange(depth, dtype=np.int64))).astype(np.int64) + (k << BITS)
                yield pa.RecordBatch.from_arrays([pa.array(key), *batch.columns[: len(names) - 1]], names=names)

    return placed.select("node", "part", "v").mapInArrow(run, "bucket long, node long, part long" + (", v array<double>" if vectors else ""))


def small_buckets(rows: DataFrame, dimension: int, threshold: float) -> DataFrame:
    """Links ``a, b`` between parts: all rows of a bucket of up to ``DENSE`` rows with each other, in one task."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, parts, rows = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, dimension))
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(keys)
            keys, parts = np.concatenate([keys, batch.column(0).to_numpy()]), np.concatenate([parts, batch.column(2).to_numpy()])
            rows = np.concatenate([rows, matrix(batch.column(3))])
            starts, out = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), []
            for lo, hi in zip(starts, [*starts[1:], len(keys)], strict=True):
                for new in range(max(lo, old), hi if hi - lo > 1 else lo, BLOCK):
                    end = min(hi, new + BLOCK)
                    x, y = np.nonzero(rows[lo:end] @ rows[new:end].T >= threshold)
                    x, y = parts[lo + x], parts[new + y]
                    if (apart := x != y).any():
                        out.append(np.stack([x[apart], y[apart]], 1))
            start = np.searchsorted(keys, keys[-1])  # keys are sorted: only the last bucket goes on
            keys, parts, rows = keys[start:], parts[start:], rows[start:]
            if out:
                links = np.unique(np.concatenate(out), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    n = parallelism(rows.sparkSession)
    return rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long")


PACKED = "grp long, tile long, block long, n int, weight long, part long, pivot array<double>, radius double, node binary, weights binary, parts binary, v binary"
BOUNDS = ["block", "n", "weight", "part", "pivot", "radius"]


def packed(rows: DataFrame, total: int, number: int, dimension: int, first: list[str]) -> DataFrame:
    """``rows`` (grp, node, n, part, v) in blocks of up to ``BLOCK`` neighbours of one group, one row each (``PACKED``).

    ``TILE`` blocks that follow one another are a tile. ``part`` is the part of a block whose rows are of one part, else null.
    """
    import numpy as np
    from pyspark import TaskContext

    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.float64(), *[pa.binary()] * 4]
    names = [x.split()[0] for x in PACKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tile, in_tile, last = TaskContext.get().partitionId() << 32, 0, 0, None

        def block(grp, node, n, part, v) -> tuple:
            nonlocal at, tile, in_tile, last
            at += 1
            if grp != last or in_tile == TILE:
                tile, in_tile, last = at, 0, grp
            in_tile += 1
            mean = v.mean(axis=0)
            size = np.sqrt((mean * mean).sum())
            mean = mean / size if size > 1e-6 else v[0]
            radius = float(np.arccos(np.clip(v @ mean, -1, 1)).max())
            one = int(part[0]) if (part == part[0]).all() else None
            return grp, tile, at, len(v), int(n.sum()), one, mean.tolist(), radius, node.tobytes(), n.tobytes(), part.tobytes(), v.tobytes()

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy() for k in range(4)] + [matrix(batch.column(4))]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
            out, lo = [], 0
            ends = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1  # where a further group begins
            for end in [*ends, len(held[0])]:
                while end - lo >= BLOCK or lo < end < len(held[0]):
                    hi = min(end, lo + BLOCK)
                    out.append(block(int(held[0][lo]), *(x[lo:hi] for x in held[1:])))
                    lo = hi
            held = [x[lo:] for x in held]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
        if held is not None and len(held[0]):
            row = block(int(held[0][0]), *held[1:])
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types, strict=True)], names=names)

    return gathered(cut(in_order(rows.select("grp", "node", "n", "part", "v"), number, dimension, first).mapInArrow(run, PACKED)), total)


def opened(row: dict, dimension: int) -> tuple:
    """Nodes, weights, parts, vectors of a block."""
    import numpy as np

    return (*(np.frombuffer(row[c], np.int64) for c in ("node", "weights", "parts")), np.frombuffer(row["v"], np.float64).reshape(-1, dimension))


def decided(blocks: DataFrame, threshold: float, links: bool) -> DataFrame:
    """Pairs of blocks of a group: ``s, t, a, b`` of those to be compared (tiles, blocks), ``a, more`` of those linked whole.

    Tiles go to cells of a grid for each pair of chunks of about ``CHUNK`` tiles; bounds alone decide there. With ``links``
    only links between parts matter: blocks of one and the same part are left out, and no pair is taken as linked whole.
    """
    import numpy as np

    tiles = blocks.groupBy("grp", "tile").agg(F.collect_list(F.struct(*BOUNDS)).alias("own"))  # at most TILE blocks
    counts = blocks.groupBy("grp").agg(F.count_distinct("tile").alias("tiles"), F.count("*").alias("blocks")).where("blocks > 1")
    counts = counts.select("grp", "tiles", F.ceil(F.col("tiles") / F.lit(CHUNK)).cast("int").alias("chunks"))
    dealt = hot_join(tiles, counts, "grp", "tiles", "tile").withColumn("chunk", F.pmod(F.xxhash64("tile"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("grp", F.least("chunk", "other").alias("c"), F.greatest("chunk", "other").alias("d"), "chunk", "tile", "own")
    limit, names = math.acos(threshold), ["s", "t", "a", "b", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 3):
            flat = sorted((r[3], r[4], *(x[c] for c in BOUNDS)) for r in rows for x in r[5])
            chunk, tile, block, n, weight = (np.array([x[k] for x in flat], np.int64) for k in range(5))
            part = [x[5] for x in flat]
            pivot, radius = np.array([x[6] for x in flat]), np.array([x[7] for x in flat])
            code = np.array([-1 - k if p is None else 0 for k, p in enumerate(part)], np.int64)  # mixed blocks: each its own
            known = {p: k + 1 for k, p in enumerate({p for p in part if p is not None})}
            code = np.array([c if p is None else known[p] for c, p in zip(code, part, strict=True)])
            wanted = chunk != chunk[:, None] if rows[0][1] != rows[0][2] else np.ones((len(flat), len(flat)), bool)
            for k in range(len(flat)):
                own = np.flatnonzero(wanted[k, k + 1 :]) + k + 1
                if links:
                    own = own[code[own] != code[k]]
                if not len(own):
                    continue
                angle, reach = np.arccos(np.clip(pivot[own] @ pivot[k], -1, 1)), radius[own] + radius[k]
                near = own[angle - reach <= limit + MARGIN]
                sure = np.zeros(0, np.int64)
                if not links:
                    all_linked = angle + reach <= limit - MARGIN
                    sure, near = own[all_linked], own[(angle - reach <= limit + MARGIN) & ~all_linked]
                out = [(int(tile[k]), int(tile[j]), int(block[k]), int(block[j]), None) for j in near]
                if len(sure):
                    out.append((None, None, int(block[k]), None, int(weight[sure].sum())))
                    out += [(None, None, int(block[j]), None, int(weight[k])) for j in sure]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)], names=names)

    n = parallelism(blocks.sparkSession)
    return cut(dealt.repartition(n, "grp", "c", "d").sortWithinPartitions("grp", "c", "d", "tile").mapInArrow(run, "s long, t long, a long, b long, more long"))


def compared(blocks: DataFrame, pairs: DataFrame, dimension: int, schema: str, pair) -> DataFrame:
    """``pair(one, two)`` for each pair of blocks to be compared; blocks are sent once for each pair of tiles that needs them."""
    open_pairs = pairs.where("b is not null")
    wants = open_pairs.groupBy("s", "t", F.col("a").alias("block")).agg(F.collect_list("b").alias("others"))  # at most TILE blocks
    wants = wants.unionByName(open_pairs.select("s", "t", F.col("b").alias("block"), F.array().cast("array<long>").alias("others")))
    wants = wants.groupBy("s", "t", "block").agg(F.flatten(F.collect_list("others")).alias("others"))
    sent = wants.join(blocks.select("block", "node", "weights", "parts", "v"), "block").select("s", "t", "block", "others", "node", "weights", "parts", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, 2):
            own = {r[2]: opened({"node": r[4], "weights": r[5], "parts": r[6], "v": r[7]}, dimension) for r in rows}
            for r in rows:
                for other in r[3]:
                    yield from pair(own[r[2]], own[other])

    n = parallelism(blocks.sparkSession)
    return sent.repartition(n, "s", "t").sortWithinPartitions("s", "t", "block").mapInArrow(run, schema)


def dense_buckets(rows: DataFrame, total: int, number: int, dimension: int, threshold: float) -> DataFrame:
    """Links ``a, b`` between parts: all rows of larger buckets (``bucket, node, part, v``) with each other, in pairs of blocks."""
    import numpy as np

    def pair(one: tuple, two: tuple) -> Iterator[pa.RecordBatch]:
        x, y = np.nonzero(one[3] @ two[3].T >= threshold)
        x, y = one[2][x], two[2][y]
        if (apart := x != y).any():
            links = np.unique(np.stack([x[apart], y[apart]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] is None:
                    own = opened(row, dimension)
                    yield from pair(own, own)

    blocks = packed(rows.select(F.col("bucket").alias("grp"), "node", F.lit(1).cast("long").alias("n"), "part", "v"), total, number, dimension, ["grp", "part"])
    inside = blocks.select("part", "node", "weights", "parts", "v").mapInArrow(within, "a long, b long")
    return inside.unionByName(compared(blocks, decided(blocks, threshold, links=True), dimension, "a long, b long", pair))


def bucket_passes(placed: DataFrame, total: int, numbers: list[int], depth: int, dimension: int, threshold: float) -> DataFrame:
    """Links ``a, b`` between parts of all pairs of rows that share a bucket in one of the passes; ``placed``: node, part, v."""
    cells = signed(placed, numbers, depth, dimension, vectors=False).groupBy("bucket", "part").agg(F.count("*").alias("m"))
    sizes = cells.groupBy("bucket").agg(F.sum("m").alias("n"), F.count("*").alias("parts"))
    dense = cut(sizes.where(F.col("n") > DENSE).select("bucket", "n", (F.col("parts") > 1).alias("mixed")))
    many = dense.count()  # at most rows / DENSE for each pass

    def marked(own: list[int]) -> DataFrame:
        rows = signed(placed, own, depth, dimension)
        return rows.join(F.broadcast(dense.drop("n")), "bucket", "left") if many <= FEW else hot_join(rows, dense, "bucket", "n", "node", "left")

    columns, out = ["bucket", "node", "part", "v"], []
    for k in range(0, len(numbers), AT_ONCE):
        own = numbers[k : k + AT_ONCE]
        rows = marked(own).where("mixed is null") if many else signed(placed, own, depth, dimension)
        out.append(gathered(cut(small_buckets(rows.select(*columns), dimension, threshold).distinct()), total))
    if many and not dense.where("mixed").isEmpty():
        out.append(cut(dense_buckets(marked(numbers).where("mixed").select(*columns), len(numbers) * total, numbers[0], dimension, threshold).distinct()))
    return reduce(DataFrame.unionByName, out)


def count_links(members: DataFrame, total: int, dimension: int, threshold: float = THRESHOLD) -> DataFrame:
    """``node, links``: for each row of a part (``part, node, n, v``) how many rows, by count, of the same part are linked with it."""
    import numpy as np

    blocks = packed(members.select(F.col("part").alias("grp"), "node", "n", "part", "v"), total, 0, dimension, ["grp"])

    def counts(*found) -> Iterator[pa.RecordBatch]:
        for node, links in found:
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(links.astype(np.int64))], names=["node", "links"])

    def pair(one: tuple, two: tuple) -> Iterator[pa.RecordBatch]:
        linked = one[3] @ two[3].T >= threshold
        yield from counts((one[0], linked @ two[1]), (two[0], one[1] @ linked))

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                node, n, _, v = opened(row, dimension)
                linked = v @ v.T >= threshold
                np.fill_diagonal(linked, False)
                yield from counts((node, linked @ n))

    def whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(node, np.int64)
                yield from counts((own, np.full(len(own), more)))

    pairs = decided(blocks, threshold, links=False)
    sure = pairs.where("b is null").groupBy(F.col("a").alias("block")).agg(F.sum("more").alias("more"))
    out = blocks.select("node", "weights", "parts", "v").mapInArrow(within, "node long, links long")
    out = out.unionByName(blocks.select("block", "node").join(sure, "block").select("node", "more").mapInArrow(whole_blocks, "node long, links long"))
    out = out.unionByName(compared(blocks, pairs, dimension, "node long, links long", pair))
    return out.groupBy("node").agg(F.sum("links").alias("links"))


def whole(parts: DataFrame) -> DataFrame:
    """The components with the smallest node of each as well."""
    return parts.unionByName(parts.select(F.col("component").alias("node"), "component").distinct())


def near_vectors(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row."""
    rows = usable(df, id_col, vector_col)
    dimension = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    every = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"))
    if dimension is None:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    # vectors that are equal when brought to a largest component of one are the same row
    scaled = F.transform("v", lambda x: x / F.array_max(F.transform("v", lambda y: F.abs(y))) + F.lit(0.0))
    rows = rows.where(F.size("v") == dimension["d"]).withColumn("v", scaled)
    named = rows.withColumn("node", F.xxhash64("v"))
    reps = cut(named.groupBy("node").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"), F.first("v").alias("v")))
    total, d = reps.count(), dimension["d"]
    reps = gathered(reps, total)
    links = gathered(cut(window_passes(reps, total, range(WARM), d, threshold)), total)
    placed = reps.select("node", "v").join(whole(cut(components(links))), "node", "left").select("node", F.coalesce("component", "node").alias("part"), "v")
    placed, depth = gathered(cut(placed), total), depth_for(total)
    links = links.unionByName(bucket_passes(placed, total, list(range(WARM, WARM + passes_for(total, threshold))), depth, d, threshold))
    # a link between parts joins their names, which are nodes
    parts = whole(cut(components(links)))
    members = gathered(cut(reps.join(parts, "node").select("node", "n", "v", F.col("component").alias("part"))), total)
    counted = count_links(members, total, d, threshold)
    labels = cut(reps.join(parts, "node", "left").select("node", "n", "first", F.coalesce("component", "node").alias("part")))
    least = labels.groupBy("part").agg(F.min("first").alias("component_id"), F.count("*").alias("held"))
    made = hot_join(labels, least, "part", "held", "node").join(counted, "node", "left").select("node", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    own = hot_join(named.select("vec_id", "node"), made, "node", "n", "vec_id").groupBy("vec_id").agg(F.sum("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    return every.join(own, "vec_id", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
