"""Matrix decompositions of long profiles: components as ``component, kmer, weight`` for ``project``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut, dropped
from .linear import packed_rows, spread_out

#: The products of up to so many pairs of features (512 features) are summed as one matrix.
SQUARE = 1 << 18


def _products(rows: DataFrame, key: str, left: list[str], right: list[str]) -> np.ndarray:
    """Sum over rows of the products of the columns ``left`` and ``right``: a matrix of their numbers, added up in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(left), len(right)))
        for batch in batches:
            both = [np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols]) for cols in (left, right)]
            out += both[0] @ both[1].T
        i, j = np.indices(out.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(out.ravel())], names=["i", "j", "v"])

    out = np.zeros((len(left), len(right)))
    for r in rows.select(*dict.fromkeys(left + right)).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # a cell for each pair of columns
        out[r["i"], r["j"]] = r["v"]
    return out


def _turned(m: DataFrame, key: str, columns: list[str], matrix: np.ndarray, names: list[str]) -> DataFrame:
    """The thin matrix ``columns`` times a small ``matrix``."""
    kind = m.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], axis=1) @ matrix
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(x[:, k]) for k in range(x.shape[1]))], names=[key, *names])

    return m.select(key, *columns).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{c} double" for c in names))


def _gram(long: DataFrame, names: list[str]) -> np.ndarray:
    """The sums over rows of the products of all pairs of the features ``names``: rows are packed once and added up in the tasks."""
    width, most = len(names), max(1, (1 << 20) // max(1, len(names)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((width, width))
        for batch in batches:
            for k in range(0, len(batch), most):
                at, value = batch.slice(k, most).columns
                x = spread_out(at, value.flatten().to_numpy(), width)
                out += x.T @ x
        i, j = np.nonzero(np.triu(out))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(out[i, j])], names=["i", "j", "v"])

    rows = packed_rows(long.select("id", "kmer", F.col("value").cast("double").alias("value")), names, ["id"]).select("at", "value")
    sums = rows.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()  # at most ``SQUARE`` cells
    out = np.zeros((width, width))
    out[sums.column("i").to_numpy(), sums.column("j").to_numpy()] = sums.column("v").to_numpy()
    return out + np.triu(out, 1).T


def svd(long: DataFrame, vocab: DataFrame, n: int, more: int = 16, rounds: int = 60, tol: float = 1e-10, seed: int = 1) -> tuple[list[float], DataFrame]:
    """The ``n`` largest singular values, and ``component, kmer, weight`` of their right vectors (M9).

    Subspace iteration with ``2 n + more`` columns: a table (kmer, weights) is multiplied by the profile and by its
    transpose, each a join and a sum, and made orthonormal by the small matrix of its products. The driver sees matrices of
    columns by columns, never a vocabulary. Ends when no value changes by more than ``tol``; raises after ``rounds``.

    Where all pairs of features are at most ``SQUARE``, their products are summed in one pass, and that matrix has the vectors.
    """
    width = vocab.count()
    if width and width * width <= SQUARE:
        names = sorted(r["kmer"] for r in vocab.select("kmer").collect())  # at most as many as ``SQUARE`` has pairs of
        values, vectors = np.linalg.eigh(_gram(long, names))
        columns = [f"w{k}" for k in range(min(n, width))]
        parts = pa.table([pa.array(names), *(pa.array(vectors[:, -1 - k]) for k in range(len(columns)))], names=["kmer", *columns])
        return np.sqrt(np.maximum(values[::-1][:n], 0)).tolist(), _signed(long.sparkSession.createDataFrame(parts), columns)
    size = min(width, 2 * n + more)
    w, z = [f"w{k}" for k in range(size)], [f"z{k}" for k in range(size)]
    unit = lambda k: (F.pmod(F.xxhash64("kmer", F.lit(k), F.lit(seed)), F.lit(1 << 20)) + 0.5) / (1 << 19) - 1.0
    long = long.select("id", "kmer", "value")
    basis, before, value = cut(vocab.select("kmer", *[unit(k).alias(c) for k, c in enumerate(w)])), None, F.col("value")
    rotate = np.linalg.pinv(np.linalg.cholesky(_products(basis, "kmer", w, w) + 1e-12 * np.eye(size))).T if width else None
    for _ in range(rounds):
        here = _turned(basis, "kmer", w, rotate, w)
        by_id = long.join(here, "kmer").groupBy("id").agg(*[F.sum(value * F.col(c)).alias(c) for c in w])
        far = long.join(by_id, "id").groupBy("kmer").agg(*[F.sum(value * F.col(c)).alias(d) for c, d in zip(w, z, strict=True)])
        both = cut(here.join(far, "kmer", "left").na.fill(0.0))
        cells = _products(both, "kmer", [*w, *z], z)
        inner, gram = (cells[:size] + cells[:size].T) / 2, cells[size:]
        values, vectors = np.linalg.eigh(inner)
        values, vectors = values[::-1], vectors[:, ::-1]
        found = np.sqrt(np.maximum(values[:n], 0))
        if before is not None and np.all(np.abs(found - before) <= tol * max(found[0], 1e-300)) or size == width:
            parts = _turned(both, "kmer", w, vectors[:, :n], w[:n])
            dropped(basis)
            return found.tolist(), _signed(cut(parts), w[: min(n, size)])
        before = found
        own = vectors.T @ gram @ vectors  # in the directions found, columns differ in length rather than direction
        scale = np.sqrt(np.maximum(np.diag(own), 1e-300))
        spread, axes = np.linalg.eigh(own / np.outer(scale, scale))
        rotate = (vectors / scale) @ (axes / np.sqrt(np.maximum(spread, 1e-14)))
        dropped(basis)
        basis = cut(both.select("kmer", *[F.col(d).alias(c) for c, d in zip(w, z, strict=True)]))
        dropped(both)
    raise RuntimeError(f"singular values still change after {rounds} rounds")


def _signed(parts: DataFrame, columns: list[str]) -> DataFrame:
    """Components in long form, each with its largest weight positive."""
    peaks = parts.agg(*[F.max_by(F.col(c), F.struct(F.abs(c), "kmer")).alias(c) for c in columns]).first()  # a number for each component
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("component"), (F.col(c) * (-1.0 if (peaks[c] or 0) < 0 else 1.0)).alias("weight")) for k, c in enumerate(columns)]))
    return parts.select("kmer", rows.alias("r")).select("r.component", "kmer", "r.weight")


def truncated_svd(long: DataFrame, vocab: DataFrame, n: int) -> DataFrame:
    """The ``n`` leading right singular vectors (M9), each with its largest weight positive. ``vocab``: feature_idx, kmer.

    Not needed if there are at most ``n`` features: then each is its own component.
    """
    if vocab.count() <= n:
        return vocab.select(F.col("feature_idx").alias("component"), "kmer", F.lit(1.0).alias("weight"))
    return svd(long, vocab, n)[1]


def _seeded(vocab: DataFrame, n: int, seed: int) -> DataFrame:
    """Positive starting weights that depend on the k-mer alone."""
    rows = vocab.select("kmer", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("component"))
    return rows.withColumn("weight", 0.1 + F.pmod(F.xxhash64("kmer", "component", F.lit(seed)), F.lit(1000)) / 1000.0)


def nmf(long: DataFrame, vocab: DataFrame, n: int, rounds: int = 10, seed: int = 1) -> DataFrame:
    """Non-negative factorisation by multiplicative updates as joins and sums (M10); returns the components H.

    X is sparse (id, kmer, value); W and H are long tables. Each half-round is two joins on keys and small n by n
    products; lineage is cut after every round.
    """
    h = _seeded(vocab, n, seed)
    ids = long.select("id").distinct()
    w = ids.select("id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("component")).withColumn("weight", 0.1 + F.pmod(F.xxhash64("id", "component", F.lit(seed + 1)), F.lit(1000)) / 1000.0)

    def gram(m: DataFrame, key: str) -> DataFrame:
        other = m.select(key, F.col("component").alias("c2"), F.col("weight").alias("w2"))
        return m.join(other, key).groupBy("component", "c2").agg(F.sum(F.col("weight") * F.col("w2")).alias("g"))  # n * n rows

    def updated(m: DataFrame, key: str, other: DataFrame, other_key: str) -> DataFrame:
        top = long.join(other, other_key).groupBy(key, "component").agg(F.sum(F.col("value") * F.col("weight")).alias("top"))
        low = m.select(key, F.col("component").alias("c2"), F.col("weight").alias("w2")).join(F.broadcast(gram(other, other_key)), "c2")
        low = low.groupBy(key, "component").agg(F.sum(F.col("w2") * F.col("g")).alias("low"))
        joined = m.join(top, [key, "component"], "left").join(low, [key, "component"])
        return cut(joined.select(key, "component", (F.col("weight") * F.coalesce("top", F.lit(0.0)) / (F.col("low") + 1e-9)).alias("weight")))

    for _ in range(rounds):
        w = updated(w, "id", h, "kmer")
        h = updated(h, "kmer", w, "id")
    return h.select("component", "kmer", "weight")


def _codes(target: np.ndarray, gram: np.ndarray, alpha: float, sweeps: int = 20) -> np.ndarray:
    """Non-negative sparse codes of rows by coordinate descent on their products with the atoms."""
    c = np.zeros_like(target)
    for _ in range(sweeps):
        for j in range(len(gram)):
            c[:, j] = np.maximum(0, c[:, j] + (target[:, j] - c @ gram[:, j] - alpha) / max(gram[j, j], 1e-12))
    return c


def _moved(d: np.ndarray, b: np.ndarray, a: np.ndarray, scales: list[float]) -> np.ndarray:
    """The first atoms, as many as there are ``scales`` and the next, moved one after the other and divided by their scales.
    A column is an atom, a row a feature: features move on their own."""
    d = d.copy()
    for j in range(min(len(scales) + 1, d.shape[1])):
        if a[j, j] > 1e-12:
            d[:, j] = np.maximum(0, d[:, j] + (b[:, j] - d @ a[j]) / a[j, j])
        if j < len(scales):
            d[:, j] /= scales[j]
    return d


def dictionary(long: DataFrame, vocab: DataFrame, n: int, rounds: int = 5, alpha: float = 0.1, seed: int = 1) -> DataFrame:
    """Non-negative dictionary learning (M11): sparse codes of rows and atoms of at most length one, in turns.

    Atoms are a table (kmer, n weights), spread over tasks by feature; products with the rows are joins and sums. Codes come
    from coordinate descent on those and the n by n products of the atoms. An atom moves by what the codes left of it, atom
    after atom: each needs the length of the one before, a sum over the table that gives one number. The driver sees n by n
    matrices.
    """
    d, t, b = ([f"{x}{k}" for k in range(n)] for x in "dtb")
    long = long.select("id", "kmer", "value")
    start = lambda k: 0.1 + 0.9 * (F.pmod(F.xxhash64("kmer", F.lit(k), F.lit(seed)), F.lit(1 << 20)) + 0.5) / (1 << 20)
    atoms = cut(vocab.select("kmer", *[start(k).alias(c) for k, c in enumerate(d)]))
    lengths = np.sqrt(np.maximum(np.diag(_products(atoms, "kmer", d, d)), 1e-300)) if n else np.zeros(0)
    atoms = cut(_turned(atoms, "kmer", d, np.diag(1 / lengths), d))
    for _ in range(rounds):
        gram = _products(atoms, "kmer", d, d)
        target = long.join(atoms, "kmer").groupBy("id").agg(*[F.sum(F.col("value") * F.col(c)).alias(x) for c, x in zip(d, t, strict=True)])

        def coded(batches: Iterator[pa.RecordBatch], gram: np.ndarray = gram) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                c = _codes(np.stack([batch.column(x).to_numpy(zero_copy_only=False) for x in t], axis=1), gram, alpha)
                yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c[:, k]) for k in range(n))], names=["id", *t])

        kind = long.schema["id"].dataType.simpleString()
        codes = cut(target.mapInArrow(coded, f"id {kind}, " + ", ".join(f"{x} double" for x in t)))
        a = _products(codes, "id", t, t)
        held = long.join(codes, "id").groupBy("kmer").agg(*[F.sum(F.col("value") * F.col(x)).alias(y) for x, y in zip(t, b, strict=True)])
        both = cut(atoms.join(held, "kmer", "left").na.fill(0.0))
        dropped(codes, atoms)
        scales: list[float] = []
        for j in range(n):

            def squares(batches: Iterator[pa.RecordBatch], known: tuple = tuple(scales), j: int = j) -> Iterator[pa.RecordBatch]:
                total = 0.0
                for batch in batches:
                    x, y = (np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols], axis=1) for cols in (d, b))
                    total += float((_moved(x, y, a, list(known))[:, j] ** 2).sum())
                yield pa.RecordBatch.from_arrays([pa.array([total])], names=["v"])

            scales.append(max(1.0, both.mapInArrow(squares, "v double").agg(F.sum("v")).first()[0] ** 0.5))

        def stepped(batches: Iterator[pa.RecordBatch], scales: tuple = tuple(scales)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in cols], axis=1) for cols in (d, b))
                out = _moved(x, y, a, list(scales))
                yield pa.RecordBatch.from_arrays([batch.column("kmer"), *(pa.array(out[:, k]) for k in range(n))], names=["kmer", *d])

        atoms = cut(both.mapInArrow(stepped, "kmer string, " + ", ".join(f"{c} double" for c in d)))
        dropped(both)
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("component"), F.col(c).alias("weight")) for k, c in enumerate(d)]))
    return atoms.select("kmer", rows.alias("r")).select("r.component", "kmer", "r.weight")
