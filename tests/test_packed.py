"""Packed k-mers against windows of strings: every width, chunks, repeated ids, odd texts."""

import gc
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from kmerflow.operators import counting, packed, transform

SCHEMA = "id long, sequence string"


def plain(rows, k, include_last=False):
    out = Counter()
    for i, s in rows:
        s = "".join(c.upper() if "a" <= c <= "z" else c for c in s or "")
        for p in range(len(s) - k + include_last):
            w = s[p : p + k]
            if set(w) <= set("ACGT"):
                out[i, w] += 1
    return out


def made(seed, n):
    rng = random.Random(seed)
    rows = [(i, "".join(rng.choice("ACGTacgt" if rng.random() < 0.98 else "N-é🙂 ") for _ in range(rng.choice([0, 1, 5, 40, 200])))) for i in range(n)]
    return rows + [(None, "ACGT" * 20), (None, "GGGT" * 20), (3, None), (5, "acgtacgta" * 9), (n, ""), (n + 1, "é" * 70), (n + 2, "A" * 300)]


@pytest.mark.parametrize("k", [1, 2, 3, 8, 21, 31, 32, 33, 35, 63, 64])
def test_windows_and_letters(k):
    rng = np.random.default_rng(k)
    text = rng.choice(list(b"ACGTN"), 500, p=[0.2475] * 4 + [0.01]).astype(np.uint8)
    words, plain_ = packed.windows(packed.code_of()[text], k)
    got = packed.letters_of([w[plain_] for w in words], k).to_pylist()
    want = [text[p : p + k].tobytes().decode() for p in range(500 - k + 1)]
    assert got == [w for w in want if "N" not in w]
    codes, counts = packed.counted([w[plain_] for w in words])
    found = dict(zip(packed.letters_of(codes, k).to_pylist(), counts.tolist(), strict=True))
    assert found == Counter(got) and list(found) == sorted(found)


@pytest.mark.parametrize("k,last", [(1, False), (3, True), (21, False), (35, True), (64, False), (65, True)])
def test_profile_and_vocabulary(spark, monkeypatch, k, last):
    monkeypatch.setattr(counting, "CHUNK", 50)
    monkeypatch.setattr(packed, "PART", 300)
    rows = made(k, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = plain(rows, k, last)
    got = counting.count_profile(df, k, include_last=last).collect()
    assert len(got) == len(want) and {(r["id"], r["kmer"]): r["value"] for r in got} == want
    total = Counter()
    for (_, w), n in want.items():
        total[w] += n
    assert {r["kmer"]: r["n"] for r in counting.discover_vocabulary(df, k, include_last=last).collect()} == total
    sums = {}
    for (_, w), n in want.items():
        df_, total_, squares = sums.get(w, (0, 0, 0))
        sums[w] = (df_ + 1, total_ + n, squares + n * n)
    found = counting.count_sums(df, k, include_last=last).collect()
    assert len(found) == len(sums) and {r["kmer"]: (r["df"], r["total"], r["squares"]) for r in found} == sums


def test_sums_without_long_or_repeated_samples(spark):
    df = spark.createDataFrame([(1, "ACGTACGTA"), (2, None), (3, "AC"), (None, "ACGTNACGT")], SCHEMA)
    assert sorted(map(tuple, counting.count_sums(df, 3, include_last=True).collect())) == [("ACG", 2, 4.0, 8.0), ("CGT", 2, 4.0, 8.0), ("GTA", 1, 2.0, 4.0), ("TAC", 1, 1.0, 1.0)]
    assert sorted(map(tuple, counting.count_sums(df, 3, alphabet="ACGTN").where("kmer like '%N%'").collect())) == [("GTN", 1, 1.0, 1.0), ("NAC", 1, 1.0, 1.0), ("TNA", 1, 1.0, 1.0)]


def test_vocabularies_beyond_the_letters(spark):
    df = spark.createDataFrame([(1, "ACGNACGTT"), (2, "NNNN")], SCHEMA)
    vocab = lambda *w: spark.createDataFrame([(x,) for x in w], "kmer string")
    assert sorted(map(tuple, counting.count_profile(df, 3, vocabulary=vocab("ACG", "TTT", "ACG")).collect())) == [(1, "ACG", 2.0)]
    assert sorted(map(tuple, counting.count_profile(df, 3, vocabulary=vocab("ACG", "NNN")).collect())) == [(1, "ACG", 2.0), (2, "NNN", 1.0)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert counting.count_profile(df, 21).count() == 0 and counting.discover_vocabulary(df, 21).count() == 0
    assert counting.count_sums(df, 21).count() == 0


@pytest.mark.parametrize("k", [3, 8, 21, 35])
def test_windows_leave_nothing_to_the_collector(k):
    """A worker that counts part after part holds one part's arrays, however rarely cycles are collected."""
    codes = np.random.default_rng(k).integers(0, 4, packed.PART).astype(np.uint8)
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        packed.windows(codes, k)
        once = tracemalloc.get_traced_memory()[0]
        for _ in range(5):
            packed.windows(codes, k)
        assert tracemalloc.get_traced_memory()[0] - once < packed.PART
        assert once < packed.PART
    finally:
        tracemalloc.stop()
        gc.enable()


@pytest.mark.parametrize("factors", [1 << 18, 0])
def test_tf_idf_of_sequences_equals_that_of_their_profile(spark, monkeypatch, factors):
    monkeypatch.setattr(counting, "FACTORS", factors)
    seqs = spark.createDataFrame(made(7, 60), SCHEMA)
    long = counting.count_profile(seqs, 5)
    want = {(r["id"], r["kmer"]): r["value"] for r in transform.TfIdf.fit(long, 64).transform(long).collect()}
    got = {(r["id"], r["kmer"]): r["value"] for r in counting.tf_idf(seqs, 5, 64).collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 1e-12 for x in want)


def test_tf_idf_shuffles_no_profile(spark):
    seqs = spark.createDataFrame([(i, "ACGTTGCA" * 9 + "ACGT"[i % 4] * 9) for i in range(20)], SCHEMA)
    plan = counting.tf_idf(seqs, 5, 20)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert "Window" not in plan
