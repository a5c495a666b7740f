"""Fingerprints, Jaccard join, embedding links: against brute force."""

import math
import os
import random
import re

import numpy as np
import pytest

from kmerflow.llm import common, jaccard, near_vectors, syncmers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_anchors(text):
    k, s, out = syncmers.K, syncmers.S, []
    inner = {}
    for i in range(len(text) - s + 1):
        w = text[i : i + s]
        if w not in inner:
            inner[w] = int(syncmers._mixed(np.array([_poly(w)], np.uint64))[0])
    for i in range(len(text) - k + 1):
        own = [inner[text[j : j + s]] for j in range(i, i + k - s + 1)]
        if min(own) in (own[0], own[-1]):
            out.append(i)
    return out


def _poly(w):
    h = 0
    for c in w:
        h = (h * syncmers._MULT + ord(c)) % 2**64
    return h


def test_anchors_equal_definition():
    rng = random.Random(1)
    for n in (0, 5, 21, 22, 400):
        t = "".join(rng.choice("abcdé漢 ") for _ in range(n))
        _, at = syncmers.anchors(np.frombuffer(t.encode("utf-32-le"), np.uint32))
        assert at.tolist() == plain_anchors(t)


def test_anchors_are_context_free():
    rng = random.Random(2)
    t = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    points = lambda x: np.frombuffer(x.encode("utf-32-le"), np.uint32)
    one, two = set(syncmers.anchors(points(t))[0].tolist()), set(syncmers.anchors(points("zzz" + t[:1500] + "#" + t[1500:]))[0].tolist())
    assert len(one - two) <= 2 * syncmers.K


def test_chunks_do_not_change_a_sketch(monkeypatch):
    t = "".join(random.Random(3).choices("abcdefgh ", k=5000))
    whole = syncmers.written(syncmers.sketch(t))
    monkeypatch.setattr(syncmers, "CHUNK", 333)
    assert syncmers.written(syncmers.sketch(t)) == whole


def test_likeness():
    t = "".join(random.Random(4).choices("abcdefgh ", k=4000))
    a = syncmers.sketch(t)
    empty = syncmers.sketch("")
    assert syncmers.likeness(a, a) == 1.0 and syncmers.likeness(empty, empty) == 1.0 and syncmers.likeness(a, empty) == 0.0
    assert syncmers.likeness(a, syncmers.sketch(t[:2000])) > 0.3
    assert syncmers.likeness(a, syncmers.sketch(t[::-1])) < 0.1
    assert all((x == y).all() for x, y in zip(syncmers.parsed(syncmers.written(a)), a, strict=True))


def test_likeness_equals_brute_force():
    rng = random.Random(14)
    for _ in range(300):
        one, two = ([rng.randint(0, 9) for _ in range(rng.randint(1, 12))] for _ in range(2))
        nth = lambda own: [(h, own[:k].count(h)) for k, h in enumerate(own)]
        a, b = nth(one), nth(two)
        places = [b.index(x) for x in a if x in b]
        best = [1] * len(places)
        for k in range(len(places)):
            best[k] = 1 + max((best[j] for j in range(k) if places[j] < places[k]), default=0)
        want = 1.0 if one == two else max(best, default=0) / (len(a) + len(b) - len(places))
        arrays = [(np.array(x, np.uint32), np.arange(len(x), dtype=np.uint32)) for x in (one, two)]
        assert abs(syncmers.likeness(*arrays) - want) < 1e-12


def test_parts_hold_about_as_many_characters(spark):
    rows = [(k, "x" * (2000 if k < 100 else 20)) for k in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    dealt = syncmers.with_next(df)
    assert dealt.rdd.getNumPartitions() == 4
    sizes = [sum(len(r["text"]) + 200 for r in p) for p in dealt.rdd.glom().collect()]
    assert max(sizes) < 1.5 * sum(sizes) / len(sizes)


def test_next_row_and_edit(spark):
    rows = [(7, "seven " * 20), (3, None), (5, "five"), (5, "fife"), (None, "none"), (9, ""), (1, "one " * 9)]
    out = syncmers.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    order = sorted(((i if i is not None else -(2**63), i, t or "") for i, t in rows), key=lambda x: (-x[0], x[2]))
    import hashlib

    want = sorted(str((i, hashlib.sha256(syncmers.edited(t, order[(k + 1) % len(order)][2]).encode()).hexdigest())) for k, (_, i, t) in enumerate(order))
    assert sorted(str((r["doc_id"], r["edited_sha256"])) for r in out) == want


def test_every_document_has_its_next(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), reverse=True)
    import hashlib

    want = {i: hashlib.sha256(syncmers.edited(t, texts[(k + 1) % len(texts)][1]).encode()).hexdigest() for k, (i, t) in enumerate(texts)}
    assert {r["doc_id"]: r["edited_sha256"] for r in syncmers.compare_with_next(docs).collect()} == want
    assert syncmers.compare_with_next(docs.limit(0)).count() == 0


def brute_groups(rows):
    sets, parent = {}, {}
    for i, t in rows:
        w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
        parent[i] = i

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    flat = [(i, s) for i, own in sets.items() for s in own if s and i is not None]
    for k, (a, s) in enumerate(flat):
        for b, u in flat[:k]:
            if 100 * len(s & u) >= 75 * len(s | u):
                x, y = top(a), top(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), top(i)) for i, own in sets.items() for s in own), key=str)


def near_rows(seed, n=40):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, passage = [], [rng.choice(words) for _ in range(60)]
    family = [rng.choice(words) for _ in range(90)]
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(0, 90))]
        rows.append((i, " ".join([*own, *passage] if i % 3 == 0 else own)))
    for i in range(n, 3 * n):
        own = list(family)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, "\t".join(own).upper() if i % 2 else " ".join(own)))
    rows += [(1000 + k, t) for k, t in enumerate(["", "one", "One", "a b c d", "A B\nc d", "a b c d e", "x" * 90_000, "x" * 90_000])]
    return [*rows, (2000, None), (None, "a b c d e"), rows[-1], (3, rows[50][1])]


@pytest.mark.parametrize("block", [4, 64])
def test_groups_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(common, "EDGES_PER_TASK", 0 if block == 4 else 250_000)
    rows = near_rows(block)
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, node int, component string").repartition(5)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.join_groups(df).collect()), key=str)
    assert got == brute_groups(rows)
    if block == 4:
        return
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted({c for i, _, c in got if i is not None})


@pytest.mark.parametrize("most", [0, 1000])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(common, "EDGES_PER_TASK", most)
    edges = [(5, 3), (3, 5), (3, 9), (9, 1), (20, 21), (22, 21), (30, 30), *((100 + k, 101 + k) for k in range(40))]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {5: 1, 3: 1, 9: 1, 21: 20, 22: 20} | {101 + k: 100 for k in range(40)}


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join_groups(df).count() == 0 and jaccard.keep_one(df).count() == 0


@pytest.mark.parametrize("bits", [10, 29])
def test_groups_of_full_maps_and_small_cells(spark, monkeypatch, bits):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "CELL", 300)
    if bits == 10:  # the maps fill up
        monkeypatch.setattr(jaccard, "LEAST_BITS", bits)
        monkeypatch.setattr(jaccard, "MOST_BITS", bits)
        monkeypatch.setattr(jaccard, "OFTEN_BITS", bits)
    rows = near_rows(bits)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in jaccard.join_groups(df).collect()), key=str) == brute_groups(rows)


def test_sets_of_copies_are_not_stored(spark, monkeypatch):
    """Only sets with a near copy are written, however many documents have equal sets or share some shingles."""
    rng, stored, cut = random.Random(11), [], jaccard.cut
    words = [f"w{k}" for k in range(5000)]
    passages = [" ".join(rng.choices(words, k=30)) for _ in range(10)]
    texts = [" ".join([*rng.choices(words, k=100), passages[i % 10]]) for i in range(60)]
    near = texts[0].split() + ["other"]
    rows = [(i, t) for i, t in enumerate([*texts, *texts, *texts, " ".join(near)])]

    def seen(df):
        out = cut(df)
        stored.append((out.count() if "tokens" in out.columns else 0, out.count() if "token" in out.columns else 0))
        return out

    monkeypatch.setattr(jaccard, "cut", seen)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i % 60 for i in range(180)} | {180: 0}
    assert max(n for n, _ in stored) == 2  # before: all 181
    assert max(n for _, n in stored) < 100  # prefix shingles of the two alone


def test_near_duplicates_leave_no_sets_behind(spark, monkeypatch):
    """The second stage of the pipeline: what later steps do not read is deleted, sets and shingles first of all."""
    from kmerflow.llm import stages

    written, cut = [], jaccard.cut

    def seen(df):
        out = cut(df)
        written.append((set(out.columns), out._steps[0].removeprefix("file:")))
        return out

    monkeypatch.setattr(jaccard, "cut", seen)
    rows = near_rows(5, 20)
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    kept = stages.near_duplicates(spark, df, "")
    large = [p for c, p in written if c & {"tokens", "token", "low", "n_shingles"}]
    assert len(large) >= 4 and not any(os.path.exists(p) for p in large)
    want = {c for i, _, c in brute_groups(rows) if i is not None}
    assert {r["doc_id"] for r in kept.collect()} - {None} == want


def test_trie_equals_all_pairs():
    rng = random.Random(6)
    for _ in range(60):
        sets = [np.array(sorted(rng.sample(range(30), rng.randint(1, 20))), np.uint64) for _ in range(rng.randint(1, 25))]
        values = np.unique(np.concatenate(sets))
        small = [np.searchsorted(values, s) for s in sets]
        trie, mask = jaccard.Trie(small), np.zeros(len(values), bool)
        for k, own in enumerate(small):
            mask[:] = False
            mask[own] = True
            want = [j for j, o in enumerate(small) if 7 * len(np.intersect1d(own, o)) >= 3 * (len(own) + len(o))]
            assert sorted(trie.search(own, mask)) == want


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    rows, k = [], 0
    for size in (1, 2, 30, 90):
        base = rng.normal(size=16)
        for _ in range(size):
            rows.append((k, (base + rng.normal(size=16) * 0.12 * np.linalg.norm(base) / 4).astype(np.float32).tolist()))
            k += 1
    rows += [(k + j, rng.normal(size=16).astype(np.float32).tolist()) for j in range(100)]
    rows += [(500, rows[5][1]), (501, rows[5][1]), (502, [2 * x for x in rows[5][1]]), (503, None), (504, [0.0] * 16), (505, [math.nan, *[1.0] * 15]), (506, [None, *[1.0] * 15]), (507, [math.inf, *[1.0] * 15]), (508, [1.0, 2.0]), (509, []), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, node int").repartition(4)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors.near_vectors(df).collect()}
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)]
    v = np.array([x / np.linalg.norm(x) for _, x in good])
    linked = v @ v.T >= 0.95
    np.fill_diagonal(linked, False)
    parent = list(range(len(good)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(*np.nonzero(linked), strict=True):
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    assert len(got) == len(rows)
    for k, (i, _) in enumerate(good):
        assert got[i] == (int(linked[k].sum()), good[top(k)][0], good[top(k)][0] == i), i
    for i in (503, 504, 505, 506, 507, 508, 509):
        assert got[i] == (0, i, True)
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def brute_links(rows, threshold=0.95):
    v = np.array([x for _, x in rows], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    linked = v @ v.T >= threshold
    np.fill_diagonal(linked, False)
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in zip(*np.nonzero(linked), strict=True):
        x, y = top(a), top(b)
        parent[max(x, y)] = min(x, y)
    return {i: (int(linked[k].sum()), rows[top(k)][0]) for k, (i, _) in enumerate(rows)}


def pairs_in_a_cone(rng, pairs, others, near, d=64, spread=1 / 3):
    """Rows at a cosine of about 0.9 with each other, some with a partner at about 0.953."""
    axis = rng.normal(size=d)
    axis /= np.linalg.norm(axis)
    residue = lambda n: rng.normal(size=(n, d)) / math.sqrt(d) * spread
    own = residue(pairs + others)
    also = own[:pairs] * near + residue(pairs) * math.sqrt(1 - near * near)
    return [(k, x.astype(np.float32).tolist()) for k, x in enumerate(rng.permutation(np.concatenate([own, also]) + axis))]


def answer(df):
    return {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_vectors(df).collect()}


def test_pairs_in_a_dense_cone(spark):
    rows = pairs_in_a_cone(np.random.default_rng(5), 150, 1700, 0.54)
    want = brute_links(rows)
    assert sum(n > 0 for n, _ in want.values()) > 150
    assert answer(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)) == want


def test_vectors_of_more_partitions_than_windows(spark):
    rng = np.random.default_rng(9)
    own = rng.normal(size=(60, 32))
    also = own * 0.954 + rng.normal(size=(60, 32)) * math.sqrt(1 - 0.954**2)
    rows = [(k, x.astype(np.float32).tolist()) for k, x in enumerate(rng.permutation(np.concatenate([own, also])))]
    want = brute_links(rows)
    assert sum(n > 0 for n, _ in want.values()) > 40
    df, before = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        assert answer(df) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("cosine", [0.5, 0.79, 0.88])
def test_clustered_vectors_equal_brute_force(spark, monkeypatch, cosine):
    """Vectors about one direction, pairs at a cosine of about 0.955, one tight group of copies, dense buckets in blocks."""
    for name, value in (("DENSE", 96), ("BUCKET", 64), ("BLOCK", 16), ("TILE", 2), ("CHUNK", 2), ("AT_ONCE", 40)):
        monkeypatch.setattr(near_vectors, name, value)
    rng, d = np.random.default_rng(7), 32
    spread = math.sqrt(1 / cosine - 1)
    near = 1 - (1 / 0.955 - 1) / (1 / cosine - 1)
    axis = rng.normal(size=d)
    axis /= np.linalg.norm(axis)
    residue = lambda n: rng.normal(size=(n, d)) / math.sqrt(d) * spread
    own = residue(500)
    also = own * near + residue(500) * math.sqrt(1 - near * near)
    tight = own[:1] + rng.normal(size=(150, d)) * 0.02
    made = rng.permutation(np.concatenate([own, also, tight]) + axis)
    rows = [(k, x.astype(np.float32).tolist()) for k, x in enumerate(made)]
    want = brute_links(rows)
    assert sum(n > 0 for n, _ in want.values()) > 400
    assert answer(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)) == want


def test_windows_reach_across_ranges(spark):
    rng = np.random.default_rng(11)
    rows = [(k, (rng.normal(size=8) * 0.01 + 1).tolist()) for k in range(64)]
    reps = spark.createDataFrame(rows, "node long, v array<double>").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        links = near_vectors.window_passes(reps, 64, [0], 8, 0.95)
        assert len({r["component"] for r in common.components(links).collect()}) == 1  # all rows are one chain
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_join_equals_join(spark, how):
    rows = spark.createDataFrame([(7 if k % 3 else k, k) for k in range(900)], "key long, x long")
    small = rows.groupBy("key").count().where("key <> 9").selectExpr("key", "count as held", "key * 2 as y")
    got = sorted(map(str, common.hot_join(rows, small, "key", "held", "x", how).select("key", "x", "y").collect()))
    assert got == sorted(map(str, rows.join(small, "key", how).select("key", "x", "y").collect()))
