"""Forests from histograms against a dense implementation of the same trees."""

import numpy as np
import pytest

from kmerflow.operators import forest


def dense_tree(x, y, depth):
    """Importance of each column in one tree on all rows: best Gini fall, zeros and every value as limits."""
    out = np.zeros(x.shape[1])

    def fall(y, left):
        sums = lambda z: (np.bincount(z, minlength=3) ** 2).sum() / len(z) if len(z) else 0.0
        return sums(y[left]) + sums(y[~left]) - sums(y)

    def grow(rows, level):
        if level == depth:
            return
        best = (1e-9, None, None)
        for j in range(x.shape[1]):
            for limit in np.unique(np.append(x[:, j], 0.0)):
                left = x[rows, j] <= limit
                g = fall(y[rows], left)
                if g > best[0] + 1e-12 or (best[1] is not None and abs(g - best[0]) <= 1e-12 and j > best[1]):
                    best = (g, j, limit)
        if best[1] is None:
            return
        out[best[1]] += best[0] / len(y)
        left = x[rows, best[1]] <= best[2]
        grow(rows[left], level + 1)
        grow(rows[~left], level + 1)

    grow(np.arange(len(y)), 0)
    return out / out.sum()


def made(rng, n):
    y = np.arange(n) % 3
    x = rng.poisson(0.6, (n, 7)).astype(float)
    x[:, 2] += 3 * (y == 1)
    x[:, 5] -= 2 * (y == 2)
    return x, y


def frames(spark, x, y):
    long = spark.createDataFrame([(int(i), f"k{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)], "id long, kmer string, value double")
    return long, spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "id long, idx int")


def test_one_tree_equals_the_dense_one(spark):
    x, y = made(np.random.default_rng(3), 60)
    long, classes = frames(spark, x, y)
    got = {r["kmer"]: r["importance"] for r in forest.importances(long, classes, 1, 3, bins=200, share=1.0, bootstrap=False).collect()}
    want = dense_tree(x, y, 3)
    assert {k: pytest.approx(v, abs=1e-9) for k, v in got.items()} == {f"k{j}": v for j, v in enumerate(want) if v > 0}


def test_forest_finds_the_features(spark):
    x, y = made(np.random.default_rng(4), 90)
    long, classes = frames(spark, x, y)
    first = {r["kmer"]: r["importance"] for r in forest.importances(long, classes, 6, 2, share=0.6).collect()}
    assert sum(first.values()) == pytest.approx(1) and first["k2"] + first["k5"] > 0.7
    again = {r["kmer"]: r["importance"] for r in forest.importances(long.repartition(5), classes.repartition(3), 6, 2, share=0.6).collect()}
    assert again == {k: pytest.approx(v) for k, v in first.items()}


def test_nothing_to_split(spark):
    long, classes = frames(spark, np.ones((5, 2)), np.zeros(5))
    assert forest.importances(long, classes, 2, 2).count() == 0


def shuffled(spark, run, sent="-1"):
    """What ``run`` returns, and how many rows its stages wrote for shuffles; tables of up to ``sent`` bytes are sent, of no size by default."""
    sc, size = spark.sparkContext, "spark.sql.autoBroadcastJoinThreshold"
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    total = lambda seq: sum(seq.apply(k).shuffleWriteRecords() for k in range(seq.size()))
    before, held = total(stages()), spark.conf.get(size)
    spark.conf.set(size, sent)
    try:
        out = run()
    finally:
        spark.conf.set(size, held)
    return out, total(stages()) - before


def test_levels_shuffle_no_entries(spark):
    """Entries are packed by row once; levels follow the splits where the rows are and shuffle sums."""
    rng = np.random.default_rng(5)
    y, x = np.arange(3000) % 3, rng.poisson(3.0, (3000, 7)).astype(float)
    x[:, 2] += 3 * (y == 1)
    long, classes = frames(spark, x, y)
    long, classes = long.coalesce(2).cache(), classes.coalesce(1).cache()
    entries = long.count()
    found, rows = shuffled(spark, lambda: forest.importances(long, classes, 4, 3, bins=4, share=0.6).count())
    assert found and rows < 2 * entries
