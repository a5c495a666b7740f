"""Document fingerprints from closed syncmers.

A k-mer of code points is taken if its smallest inner s-mer (by hash) lies at its first or last place. Whether it is
taken depends on the k-mer alone, so an edit changes only anchors that overlap it. The fingerprint is every anchor of the
text in order, about one for each ``(K - S + 1) / 2`` characters: 32 bits of its hash and its position as 32 bits, in
base64.

Likeness of two fingerprints: anchors are matched by hash, the r-th of a hash with the r-th; what stands in the same order
in both (the longest increasing run of positions) over all anchors of either, matched ones once. Equal fingerprints have
likeness 1.

Rows of one id stay in one task. Defined results: a text shorter than ``K`` has one anchor, its own hash; null or empty text has an empty fingerprint,
like only to another empty one; equal texts have equal fingerprints; rows of equal id are ordered by text; an empty table
gives an empty table; further columns of the input are not looked at.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parallelism, texts_of

K, S = 21, 6
CHUNK, FINE = 1 << 18, 4
_MULT, _MIX = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(29))


def anchors(points, k: int = K, s: int = S):
    """(hashes, positions) of the closed syncmers of an array of code points."""
    import numpy as np

    n = len(points) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code, mult = points.astype(np.uint64), np.uint64(_MULT)
    own = code[: len(code) - s + 1].copy()
    for j in range(1, s):
        own *= mult
        own += code[j : len(code) - s + 1 + j]
    inner = _mixed(own)
    width = k - s + 1
    least, span = inner, 1  # smallest of a window, by doubling
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[: len(least) - (width - span)], least[width - span :])
    at = np.flatnonzero((inner[:n] == least) | (inner[k - s :] == least))
    whole = np.zeros(len(at), np.uint64)
    for j in range(0, k - s + 1, s):
        whole = whole * np.uint64(_MIX) + inner[at + j]
    whole = whole * np.uint64(_MIX) + inner[at + k - s]
    return _mixed(whole), at


def sketch(text: str):
    """(hashes, positions) of all anchors, by position. Long texts go in overlapping chunks."""
    import numpy as np

    if not text:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    found = [(base, *anchors(points[base : base + CHUNK + K - 1])) for base in range(0, max(1, len(points) - K + 1), CHUNK)]
    hashes = np.concatenate([(h >> np.uint64(32)).astype(np.uint32) for _, h, _ in found])
    at = np.concatenate([(base + p).astype(np.uint32) for base, _, p in found])
    if not len(hashes):  # a closed syncmer needs K characters, and a long text always has one
        hashes, at = np.frombuffer(hashlib.sha256(text.encode()).digest()[:4], np.uint32), np.zeros(1, np.uint32)
    return hashes, at


def written(own) -> str:
    import numpy as np

    return base64.b64encode(np.stack(own, 1).astype("<u4").tobytes()).decode()


def parsed(fingerprint: str):
    import numpy as np

    both = np.frombuffer(base64.b64decode(fingerprint), "<u4").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def numbered(hashes):
    """Each hash with how many equal ones stand before it, as one integer."""
    import numpy as np

    order = np.argsort(hashes, kind="stable")
    own = hashes[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
    nth = np.empty(len(own), np.uint64)
    nth[order] = (np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))).astype(np.uint64)
    return (hashes.astype(np.uint64) << np.uint64(32)) | nth


def longest_run(values) -> int:
    """Length of the longest increasing subsequence."""
    import numpy as np

    if len(values) < 2 or (np.diff(values) > 0).all():
        return len(values)
    run: list[int] = []  # of the increasing runs of each length, the smallest last value
    for v in values.tolist():
        if not run or v > run[-1]:
            run.append(v)
        else:
            run[bisect.bisect_left(run, v)] = v
    return len(run)


def likeness(a, b) -> float:
    import numpy as np

    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    if len(a[0]) == len(b[0]) and (a[0] == b[0]).all() and (a[1] == b[1]).all():
        return 1.0
    _, one, two = np.intersect1d(numbered(a[0]), numbered(b[0]), assume_unique=True, return_indices=True)
    return longest_run(two[np.argsort(one)]) / (len(a[0]) + len(b[0]) - len(one))


def edited(text: str, other: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def fingerprints(df: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([written(sketch(t)) for t in texts])], names=NAMES[:2] + ["fingerprint"])

    return texts_of(df).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def with_next(df: DataFrame) -> DataFrame:
    """Rows dealt so that each row and the next by descending id (after the last: the first) come one after the other.

    Columns ``doc_id, text, part, extra``: parts are ranges of ids, at bounds taken from approximate quantiles; the first
    row of each part is also the extra last row of the part before it. The text is shuffled once; only ids are read
    besides, and only a bound and a head for each part reach the driver.
    """
    rows = texts_of(df).withColumn("place", F.coalesce(F.col("doc_id"), F.lit(-(2**63))))
    n = parallelism(df.sparkSession)
    bounds = even_bounds(rows, n)

    def tree(lo: int, hi: int):
        """How many bounds lie below ``place``: a search tree of comparisons."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("place") > bounds[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    rows = rows.withColumn("part", (F.lit(len(bounds)) - tree(0, len(bounds))).cast("int"))
    heads = {r["part"]: r["head"] for r in rows.groupBy("part").agg(F.max("place").alias("head")).collect()}  # a row for each part
    order = sorted(heads)
    before = {heads[p]: order[k - 1] for k, p in enumerate(order)}  # the first part's head follows the last part
    extra = F.create_map(*[x for h, p in before.items() for x in (F.lit(h).cast("long"), F.lit(p))])[F.col("place")] if before else F.lit(None).cast("int")
    dealt = rows.withColumn("to", F.array_compact(F.array(F.struct(F.col("part"), F.lit(False).alias("extra")), F.when(extra.isNotNull(), F.struct(extra.cast("int").alias("part"), F.lit(True).alias("extra"))))))
    dealt = dealt.select("doc_id", "text", "place", F.explode("to").alias("to")).select("doc_id", "text", "place", "to.part", "to.extra")
    return dealt.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "extra", F.desc("place"), "text").select("doc_id", "text", "part", "extra")


def even_bounds(rows: DataFrame, n: int) -> list[int]:
    """At most ``n - 1`` places that part the rows into ranges of about as many characters each.

    Approximate quantiles of ``place`` give ``FINE`` times as many ranges of about as many rows; their sizes, a row for
    each range, tell which bounds to keep. Rows of one place stay together.
    """
    if n < 2:
        return []
    fine = sorted({int(q) for q in rows.select("place").stat.approxQuantile("place", [k / (FINE * n) for k in range(1, FINE * n)], 0.2 / (FINE * n))})
    if not fine:
        return []

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col("place") > fine[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    sizes = {r["at"]: r["size"] for r in rows.groupBy(tree(0, len(fine)).alias("at")).agg(F.sum(F.length("text") + 200).alias("size")).collect()}
    share, held, out = sum(sizes.values()) / n, 0, []
    for k, bound in enumerate(fine):
        held += sizes.get(k, 0)
        if held >= share * (len(out) + 1) and len(out) < n - 1:
            out.append(bound)
    return out


def compare_with_next(df: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how like they are; see ``NAMES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, size = None, [], 0  # held: the row whose next row comes now

        def made() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[]] * len(NAMES)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, TYPES, strict=True)], names=NAMES)

        for batch in batches:
            for doc_id, text, part, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and held[2] != part:
                    held = None
                if extra and held is None:
                    continue  # further rows of the next part's first id
                own = sketch(text)
                if held is not None:
                    other = edited(held[1], text)
                    print_ = held[3] if other == held[1] else sketch(other)
                    size += len(held[1])
                    out.append((held[0], len(held[1]), hashlib.sha256(other.encode()).hexdigest(), written(held[3]), written(print_), likeness(held[3], print_), likeness(held[3], own)))
                held = None if extra else (doc_id, text, part, own)
                if len(out) >= 512 or size > CHUNK:
                    yield made()
                    out.clear()
                    size = 0
        yield made()

    return with_next(df).mapInArrow(run, SCHEMA)
