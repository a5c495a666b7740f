"""Balanced sampling: targets against a plain loop, totals and means of the flight, whole results on odd tables."""

import numpy as np
import pytest

from kmerflow.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in stopped]
        left = total - sum(most * sizes[s] for s in stopped)
        out = {s: most * sizes[s] if s in stopped else left * weight[s] / sum(weight[f] for f in free) for s in order}
        above = {s for s in free if out[s] > most * sizes[s]}
        if not above:
            return out
        stopped |= above


def test_targets_equal_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 7, 40):
        own = {(f"s{k}" if k else None): int(rng.integers(0, 10 ** int(rng.integers(1, 6)))) for k in range(n)}
        df = spark.createDataFrame([(s, v, 1) for s, v in own.items()], "source string, source_size long, _n long")
        got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
        want = plain_targets(own)
        assert got.keys() == want.keys()
        assert all(got[s] == pytest.approx(want[s], abs=1e-6) for s in own)


@pytest.mark.parametrize("n", [1, 2, 3, 50, 700])
def test_flight_keeps_both_totals(n):
    rng = np.random.default_rng(n)
    size = np.sort(rng.lognormal(5, 1.5, n).astype(int))[::-1].astype(float)
    p = rng.random(n)
    out = mixing.fly(size, p.copy(), rng)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum(), abs=1e-6) and out @ size == pytest.approx(p @ size, rel=1e-6)
    landed = mixing.land(size, out.copy(), rng)
    assert set(landed) <= {0.0, 1.0}
    assert abs(landed @ size - p @ size) <= size[(out > 0) & (out < 1)].sum() + 1e-6


def test_means_are_kept():
    size = np.array([900.0, 500, 300, 300, 200, 100, 50, 50, 10, 0])
    p = np.array([0.1, 0.9, 0.5, 0.3, 0.3, 0.3, 0.7, 0.2, 0.6, 0.4])
    rng, runs = np.random.default_rng(1), 6000
    mean = sum(mixing.land(size, mixing.fly(size, p.copy(), rng, 4), rng) for _ in range(runs)) / runs
    assert np.abs(mean - p).max() < 0.03


def made(rng, n=3000):
    rows = []
    for k in range(n):
        source = ["a", "b", "c", None, "d"][min(4, int(rng.exponential(1.0)))]
        rows.append((k, " ".join(["w"] * int(rng.lognormal(3, 1.2))), source))
    return rows


def totals(rows):
    out = {}
    for r in rows:
        own = out.setdefault(r["source"], [0, r["target"], r["source_size"], 0])
        own[0], own[3] = own[0] + r["size"] * r["copies"], own[3] + r["size"]
    return out


@pytest.mark.parametrize("block", [2048, 32])
def test_sources_come_near_their_targets(spark, block):
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame(made(rng), SCHEMA)
    rows = mixing.mix(docs, block=block).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(3000))
    assert all(0 <= r["copies"] <= 3 for r in rows)
    own = totals(rows)
    want = plain_targets({s: v[2] for s, v in own.items()})
    for s, (taken, target, size, summed) in own.items():
        assert size == summed and target == pytest.approx(want[s])
        assert abs(taken - target) <= 0.02 * target + 60


def test_reruns_and_other_partitions_agree(spark):
    docs = spark.createDataFrame(made(np.random.default_rng(6), 800), SCHEMA)
    first = sorted(map(tuple, mixing.mix(docs, block=64).collect()), key=str)
    assert sorted(map(tuple, mixing.mix(docs.repartition(7), block=64).collect()), key=str) == first


def test_odd_tables(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, None, None), (1, "", "a"), (1, "", "a"), (2, "x " * 5, "a"), *[(2**60 + 1, "y z", "b")] * 9, (5, None, "c"), (None, "q", None)]
    docs = spark.createDataFrame([(*r, 7, 8) for r in rows], SCHEMA + ", size long, copies long")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    assert sorted(r["size"] for r in out) == sorted([0, 0, 0, 5, *[2] * 9, 0, 1])
    assert {r["doc_id"] for r in out} == {None, 1, 2, 5, 2**60 + 1}
    own = totals(out)
    want = plain_targets({s: v[2] for s, v in own.items()})
    assert all(own[s][1] == pytest.approx(want[s]) for s in own)
    assert own["c"][0] == 0


def test_a_class_of_copies_is_drawn_as_a_whole(spark):
    docs = spark.createDataFrame([(1, "w w", "a")] * 1000 + [(2, "w", "b")] * 300, SCHEMA)
    own = totals(mixing.mix(docs).collect())
    assert all(abs(taken - target) <= 2 for taken, target, _, _ in own.values())
