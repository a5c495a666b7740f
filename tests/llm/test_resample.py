"""Importance resampling: the scanner and the whole result against a plain loop."""

import hashlib
import math
import random
import re
import zlib

from kmerflow.llm import resample as rs

SCHEMA = "doc_id long, text string"


def plain_features(text, n=2):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain_resample(docs, target, buckets=10_000, percent=25, least=20, seed=7, n=2):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for texts, counts in ((docs, s), (target, t)):
        for _, text in texts:
            for g in plain_features(text, n)[1]:
                counts[bucket(g)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for doc, text in docs:
        words, own = plain_features(text, n)
        weight = sum(gain[bucket(g)] for g in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for rank, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, rows), key=str)


def texts(rng, n):
    letters = ["a", "B", "cd", "é", "ÀZ", "9", "漢字", " ", "x_y", "don't", "\x7f", "🙂", "Q"]
    return ["".join(rng.choice(letters) + rng.choice([" ", "  ", "\n", ", ", ""]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_scanner_equals_a_plain_loop():
    rng = random.Random(1)
    for n in (1, 2, 3):
        grams = rs.Grams(n, 997)
        for text in ["", " ", "a", "A-b", "--", "é" * 3000, "w " * 5000, *texts(rng, 300)]:
            words, found = grams(text)
            plain = plain_features(text, n)
            assert words == len(plain[0]) and found.tolist() == [zlib.crc32(g.encode()) % 997 for g in plain[1]]


def check(spark, docs, target, **options):
    df, aim = spark.createDataFrame([(*d, 5, "z") for d in docs], SCHEMA + ", weight int, rank string"), spark.createDataFrame(target, "item_id long, text string")
    got = rs.resample(df, aim, **options).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    plain = {"words": "n", "least_words": "least"}
    assert sorted(map(tuple, got), key=str) == plain_resample(docs, target, **{plain.get(k, k): v for k, v in options.items()})


def test_result_equals_a_plain_loop(spark):
    rng = random.Random(2)
    docs = list(enumerate(texts(rng, 400))) + [(None, None), (None, "a " * 30), (None, "a " * 30), (3, "b a " * 30), (3, "b a " * 30), (900, None), (901, "")]
    target = list(enumerate(texts(rng, 40))) + [(None, None)]
    check(spark, docs, target)
    check(spark, docs, target, buckets=70_001, words=3, percent=60, least_words=3, seed=11)


def test_empty_tables(spark):
    docs = [(1, "a b c " * 10), (2, "d " * 25), (3, "x")]
    check(spark, docs, [], percent=50)
    check(spark, [], [(1, "a b")])


def test_drawn_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(k, f"w{k % 7} " * 25, "s") for k in range(100)], SCHEMA + ", source string")
    out = rs.drawn(docs, spark.createDataFrame([(1, "w3 " * 400)], "item_id long, text string"))
    assert out.columns == docs.columns and out.count() == 25
    assert sum(r["doc_id"] % 7 == 3 for r in out.collect()) >= 10
