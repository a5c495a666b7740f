"""Search over folds against one model after the other."""

import numpy as np
import pytest

from kmerflow.operators import classify, linear, tune

LABELS = {0: "a", 1: "b", 2: "c"}


def made(spark, n=90, width=6):
    rng = np.random.default_rng(2)
    x = rng.poisson(1 + 3 * (np.arange(n) % 3 == np.arange(width)[:, None] % 3).T)
    long = spark.createDataFrame([(i, f"k{j}", float(x[i, j])) for i in range(n) for j in range(width) if x[i, j]], "id long, kmer string, value double")
    return long, spark.createDataFrame([(i, LABELS[i % 3]) for i in range(n)], "id long, label string")


def test_draws_and_grid():
    space = {"a": ("uniform", 1, 2), "b": ("log", 1e-4, 1e-1), "c": [3, 4]}
    got = tune.draws(space, 200, 7)
    assert got == tune.draws(space, 200, 7) != tune.draws(space, 200, 8)
    assert all(1 <= s["a"] <= 2 and 1e-4 <= s["b"] <= 1e-1 and s["c"] in (3, 4) for s in got)
    assert 40 < sum(s["b"] < 1e-3 for s in got) < 95  # a third of the log range
    assert tune.grid({"x": [1, 2], "y": [3]}) == [{"x": 1, "y": 3}, {"x": 2, "y": 3}]


def test_naive_bayes_side_by_side_equals_a_loop(spark):
    long, classes = made(spark)
    settings = [{"alpha": 0.01}, {"alpha": 50.0}]
    got = {(r["alpha"], r["fold"]): (r["precision"], r["recall"], r["f"]) for r in tune.naive_bayes_search(long, classes, 6, settings, folds=2, seed=4).collect()}
    assert len(got) == 4
    for s in settings:

        def run(train, labels, held, alpha=s["alpha"]):
            return classify.argmax(classify.NaiveBayes.fit(train, labels, 6, alpha).predict(held).select("id", "label", "p"))

        for r in tune.cross_validated(long, classes, run, folds=2, seed=4).collect():
            assert got[s["alpha"], r["fold"]] == pytest.approx((r["precision"], r["recall"], r["f"]))


def test_linear_side_by_side_equals_a_loop(spark):
    long, classes = made(spark)
    signs = classes.selectExpr("id", "case when label = 'a' then 1 else -1 end as y")
    settings = [{"rate": 0.05, "penalty": 1e-3}, {"rate": 0.2, "penalty": 0.1}]
    scores = tune.linear_search(long, signs, settings, folds=2, seed=4, rounds=3)
    got = {(r["trial"], r["fold"]): (r["precision"], r["recall"], r["f"]) for r in scores.collect()}
    assert len(got) == 4 and set(tune.best_of(scores)) == {"rate", "penalty"}
    table = spark.createDataFrame([("m", 0.2, 0.1)], "model string, rate double, penalty double")

    def run(train, labels, held):
        n = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}
        weight = {k: sum(n.values()) / (2 * v) for k, v in n.items()}
        rows = labels.selectExpr("'m' as model", "id", "label as y", f"case when label = 1 then {weight[1]!r}d else {weight[-1]!r}d end as weight")
        weights = linear.train(linear.with_bias(train), rows, table, rounds=3)
        return linear.margins(linear.with_bias(held), weights).selectExpr("id", "case when margin >= 0 then 1 else -1 end as label")

    named = signs.withColumnRenamed("y", "label")
    for r in tune.cross_validated(long, named, lambda a, b, c: run(a, b, c).selectExpr("id", "cast(label as string) as label"), folds=2, seed=4).collect():
        assert got[1, r["fold"]] == pytest.approx((r["precision"], r["recall"], r["f"]))
