"""Quality classifier: a factorisation machine over hashed words, structure statistics and text metadata.

Features: shares of hashed words (``BUCKETS``), and structure statistics of the whole text - letters, upper case,
digits, punctuation marks one by one, white space, word lengths, repeated words and lines, marks at word ends, length
in characters and lines - each as one of ``STEPS`` levels. The score is

    sigmoid(w0 + w.x + 1/2 sum_f ((V_f . x)^2 - V_f^2 . x^2))

which is linear in the number of features. It is fitted by Adam on a bounded sample: the ``SAMPLE`` labelled rows of
each class with the smallest hash of doc_id, from rows whose crc32(doc_id) mod 4 is not 2; of rows of equal id the smallest
text counts. Scoring covers all rows.
Labels, lang, source and doc_id are never inputs of a score.

Defined results: null or empty text gets a score from the empty text's features; without labelled rows of both classes
every score is 0.5; repeated rows give repeated results; an empty table gives an empty table; further columns are not looked
at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import WordTable
from .common import slices, texts_of

BUCKETS, STEPS, FACTORS, SAMPLE, EPOCHS, ACCEPT = 2048, 12, 6, 3000, 40, 0.7
#: Marks that count one by one.
MARKS = "!?.,;:|%$#*&@=+-_/<>()[]{}\"'"
STATS = 14 + len(MARKS)
WIDTH = BUCKETS + STATS * STEPS

_words = WordTable(lambda w: zlib.crc32(w.lower().encode()) % BUCKETS)


def statistics(text: str, words: list[str]) -> list[float]:
    """Shares and ratios in 0..1, in a fixed order."""
    import numpy as np

    raw = np.frombuffer(text.encode(), np.uint8)
    byte = np.bincount(raw, minlength=256)
    n, m = max(1, len(raw)), max(1, len(words))
    upper, lower = int(byte[65:91].sum()), int(byte[97:123].sum())
    lines = text.split("\n")
    distinct = len(set(words))
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
    ends = sum(not (w[-1].isalnum() or w[-1] in ".,") for w in words)
    doubles = sum(len(w) > 1 and w[-1] == w[-2] and not w[-1].isalnum() for w in words)
    return [
        upper / n,
        upper / max(1, upper + lower),
        lower / n,
        int(byte[48:58].sum()) / n,
        int(byte[128:].sum()) / n,
        int(byte[32]) / n,
        min(1.0, len(text) / m / 32),
        distinct / m,
        repeated / m,
        ends / m,
        doubles / m,
        sum(w.isupper() and len(w) > 1 for w in words) / m,
        1 - len(set(lines)) / len(lines),
        min(1.0, np.log1p(len(text)) / 16),
        *(int(byte[ord(c)]) / n for c in MARKS),
    ]


def features(text: str):
    """(indexes, values): hashed word shares scaled to length one, and one level for each statistic."""
    import numpy as np

    words = text.split()
    at, n = np.unique(np.fromiter(map(_words.__getitem__, words), np.int32, len(words)), return_counts=True)
    share = n / np.sqrt(float((n * n).sum())) if len(n) else n.astype(float)
    stats = np.array(statistics(text, words))
    # levels are close near 0, where shares of rare marks lie
    level = np.minimum(STEPS - 1, np.ceil((STEPS - 1) * np.sqrt(np.clip(stats, 0, 1)))).astype(np.int32)
    return np.concatenate([at, BUCKETS + np.arange(STATS, dtype=np.int32) * STEPS + level]), np.concatenate([share, np.ones(STATS)]).astype(np.float32)


class FactorisationMachine:
    def __init__(self, w0: float, w, v) -> None:
        self.w0, self.w, self.v = w0, w, v

    def raw(self, index, value) -> float:
        own = self.v[index] * value[:, None]
        return float(self.w0 + self.w[index] @ value + 0.5 * ((own.sum(0) ** 2).sum() - (own * own).sum()))

    def score(self, index, value) -> float:
        import numpy as np

        return float(1 / (1 + np.exp(-np.clip(self.raw(index, value), -30, 30))))

    @classmethod
    def fit(cls, rows: list[tuple], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> FactorisationMachine:
        """Adam on logistic loss in mini-batches; l2 on all weights."""
        import numpy as np

        rng = np.random.default_rng(seed)
        w0, w, v = np.zeros(1, np.float32), np.zeros(WIDTH, np.float32), rng.normal(0, 0.02, (WIDTH, FACTORS)).astype(np.float32)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w0, w, v)]
        y, step = np.array(labels, np.float32), 0
        for _ in range(epochs if len(set(labels)) == 2 else 0):
            order = rng.permutation(len(rows))
            for k in range(0, len(rows), 128):
                own = order[k : k + 128]
                x = np.zeros((len(own), WIDTH), np.float32)
                for i, j in enumerate(own):
                    x[i, rows[j][0]] = rows[j][1]
                xv, xx = x @ v, x * x
                z = w0 + x @ w + 0.5 * ((xv**2).sum(1) - (xx @ (v * v)).sum(1))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / len(own)
                grads = [np.array([g.sum()], np.float32), x.T @ g + 1e-5 * w, x.T @ (g[:, None] * xv) - v * (xx.T @ g)[:, None] + 1e-4 * v]
                step += 1
                for p, d, (m1, m2) in zip((w0, w, v), grads, state, strict=True):
                    m1 += 0.1 * (d - m1)
                    m2 += 0.001 * (d * d - m2)
                    p -= 0.01 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
        return cls(float(w0[0]), w, v)


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2


def sample(df: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> DataFrame:
    """At most ``per_class`` labelled, not held-out rows of each class: those with the smallest hash of the id."""
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("quality").alias("low")).where("quality = low").drop("low")
    known = known.where(~F.coalesce(held_out(), F.lit(True)))
    picked = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for q in (0, 1)]
    rows = texts_of(df).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")  # at most 2 * per_class ids
    return rows.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # of rows of equal id the first text


def fit(df: DataFrame, labels: DataFrame, per_class: int = SAMPLE) -> FactorisationMachine:
    """Features of the sample, at most ``2 * per_class`` rows, are made on the executors; the fit itself is small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t) for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), batch.column(2), pa.array([x[0] for x in made], pa.list_(pa.int32())), pa.array([x[1] for x in made], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "quality", "at", "value"])

    picked = sample(df, labels, per_class).select("doc_id", "text", "quality")
    rows = picked.mapInArrow(run, "doc_id long, quality int, at array<int>, value array<float>").toArrow().to_pandas()
    rows = rows.sort_values("doc_id")  # the order of rows must not matter
    return FactorisationMachine.fit(list(zip(rows["at"], rows["value"], strict=True)), rows["quality"].tolist())


def score(df: DataFrame, model: FactorisationMachine) -> DataFrame:
    """``doc_id, score`` for every row; the model's weights (fixed width) go along with the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                scores = [model.score(*features(t)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return texts_of(df).mapInArrow(run, "doc_id long, score double")


def keep_good(df: DataFrame, model: FactorisationMachine, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``df``, all columns, whose score is at least ``accept``: one scan, no join by id."""
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keep = [model.score(*features(t or "")) >= accept for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def predictions(df: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    scored = score(df, fit(df, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
