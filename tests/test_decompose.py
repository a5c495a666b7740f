"""Decompositions against dense linear algebra."""

import numpy as np
import pytest

from kmerflow.operators import decompose

from .test_forest import shuffled


def long_of(spark, x):
    rows = [(int(i), f"k{j:04d}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)]
    long = spark.createDataFrame(rows, "id long, kmer string, value double")
    return long, spark.createDataFrame([(j, f"k{j:04d}") for j in range(x.shape[1])], "feature_idx long, kmer string")


@pytest.mark.parametrize("shape,n", [((40, 12), 3), ((200, 90), 4)])
def test_svd_equals_numpy(spark, shape, n):
    rng = np.random.default_rng(shape[0])
    x = rng.poisson(0.4, shape) * rng.gamma(2.0, 1.0, shape) @ np.diag(np.linspace(3, 0.2, shape[1]))
    x[:, 4] = 0  # a feature of the vocabulary that does not occur
    long, vocab = long_of(spark, x)
    values, parts = decompose.svd(long, vocab, n)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, s[:n], rtol=1e-6)
    got = np.zeros((n, shape[1]))
    for r in parts.collect():
        got[r["component"], int(r["kmer"][1:])] = r["weight"]
    want = vt[:n] * np.sign(vt[np.arange(n), np.abs(vt[:n]).argmax(axis=1)])[:, None]
    assert np.allclose(got, want, atol=1e-3) and np.allclose(got @ got.T, np.eye(n), atol=1e-6)


def test_few_features_are_their_own_components(spark):
    long, vocab = long_of(spark, np.eye(3))
    assert decompose.truncated_svd(long, vocab, 3).count() == 3


def test_dictionary_equals_the_dense_one(spark):
    """Atoms after each round against dense matrices; what the codes leave falls from round to round."""
    rng, n, alpha = np.random.default_rng(7), 3, 0.05
    x = rng.gamma(1.0, 1.0, (50, 3)) @ (rng.random((3, 20)) * (rng.random((3, 20)) < 0.4))
    long, vocab = long_of(spark, x)
    before, d = None, None
    for rounds in range(4):
        got = np.zeros((n, 20))
        for r in decompose.dictionary(long, vocab, n, rounds, alpha).collect():
            got[r["component"], int(r["kmer"][1:])] = r["weight"]
        if d is not None:
            c = decompose._codes(x @ d.T, d @ d.T, alpha)
            a, b = c.T @ c, c.T @ x
            for j in range(n):
                if a[j, j] > 1e-12:
                    d[j] = np.maximum(0, d[j] + (b[j] - a[j] @ d) / a[j, j])
                d[j] /= max(1.0, np.linalg.norm(d[j]))
            assert np.allclose(got, d, atol=1e-8)
        d = got.copy()
        assert (got >= 0).all() and (np.linalg.norm(got, axis=1) <= 1 + 1e-9).all()
        c = decompose._codes(x @ d.T, d @ d.T, alpha)
        left = 0.5 * ((x - c @ d) ** 2).sum() + alpha * c.sum()
        assert before is None or left <= before + 1e-9
        before = left


def test_svd_of_few_features_packs_rows_once(spark):
    """The products of few features come from one pass over the rows, and the vectors are those of dense algebra to the last digits."""
    rng = np.random.default_rng(11)
    x = rng.poisson(2.0, (2000, 9)) * 1.0 @ np.diag(np.linspace(3, 0.5, 9))
    long, vocab = long_of(spark, x)
    long = long.coalesce(2).cache()
    entries = long.count()
    (values, parts), rows = shuffled(spark, lambda: decompose.svd(long, vocab, 3))
    assert rows < 2 * entries
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    got = np.zeros((3, 9))
    for r in parts.collect():
        got[r["component"], int(r["kmer"][1:])] = r["weight"]
    want = vt[:3] * np.sign(vt[np.arange(3), np.abs(vt[:3]).argmax(axis=1)])[:, None]
    assert np.allclose(values, s[:3], rtol=1e-11) and np.allclose(got, want, atol=1e-9)


def test_svd_of_more_features_equals_numpy(spark, monkeypatch):
    """Subspace iteration, which wide vocabularies take."""
    monkeypatch.setattr(decompose, "SQUARE", 0)
    test_svd_equals_numpy(spark, (40, 12), 3)
