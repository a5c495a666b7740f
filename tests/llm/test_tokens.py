"""BPE transducer, decoder, token trees, packing: exact against the public libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from kmerflow.llm import bpe, bpe_codec, packing, queries, token_tree

RANKS, PATTERN = queries.RANKS, queries.PATTERN
LETTERS = "abcdefgh  \n\t'sté0123 !?ÄЖ漢🙂​\xa0\x1c ABC__--=="


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, PATTERN)


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def texts(spark, sf):
    rng = random.Random(1)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 50))) for _ in range(2000)]
    return ["", " ", "a" * 5000, "=" * 300, " " * 500 + "x", *made, *(r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect())]


def test_transducer_equals_library(encoder, plain, texts):
    for t in texts:
        assert encoder.encode(t) == plain.encode_ordinary(t)


def test_transducer_with_few_states(plain, texts):
    small = bpe.Transducer(bpe.load_ranks(RANKS), max_states=50)
    for t in texts[5:300]:
        for piece in bpe.re.findall(r"\S+", t):
            assert small.encode(piece.encode()) == plain.encode_single_piece(piece) if hasattr(plain, "encode_single_piece") else True


def test_stream_gives_whole_characters(encoder, texts):
    decoder = bpe.Decoder(RANKS)
    for t in texts[:400]:
        ids = encoder.encode(t)
        parts = list(decoder.stream([i] for i in ids))
        assert b"".join(parts) == t.encode()
        for p in parts:
            p.decode()


def test_stream_passes_broken_bytes():
    decoder = bpe.Decoder(RANKS)
    one = {t: i for i, t in decoder.token.items()}
    ids = [one[b"\xe6"], one[b"a"], one[b"\xff"]]
    assert b"".join(decoder.stream([i] for i in ids)) == b"\xe6a\xff"


def test_codec_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "né\n漢 " * 50)], "doc_id long, text string")
    rows = bpe_codec.round_trip(docs, RANKS, PATTERN).collect()
    again = bpe_codec.decode(bpe_codec.encode(docs, RANKS, PATTERN), RANKS).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again)) and len(rows) == 4
    assert [bytes(r["decoded"]).decode() for r in rows if r["doc_id"] == 3] == ["né\n漢 " * 50]
    assert bpe_codec.round_trip(docs.limit(0), RANKS, PATTERN).count() == 0


def test_tree_equals_whole_count(plain, texts):
    rng, count = random.Random(2), token_tree.Counter(RANKS, PATTERN)
    for t in rng.sample(texts, 200):
        tree, now = token_tree.TokenTree(t, count), t
        assert tree.n_tokens == len(plain.encode_ordinary(t))
        for _ in range(6):
            a = rng.randint(0, len(now) + 2)
            b, new = rng.randint(a, a + 9), "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 8)))
            tree.edit(a, b, new)
            a, b = min(a, len(now)), min(b, len(now))
            now = now[:a] + new + now[b:]
            assert tree.n_tokens == len(plain.encode_ordinary(now)) and tree.n_chars == len(now)


def test_tree_reencodes_little(plain):
    tree = token_tree.TokenTree("word and more " * 5000, token_tree.Counter(RANKS, PATTERN))
    before = tree.encoded
    tree.edit(30_000, 30_004, "x")
    assert tree.encoded - before <= 6


def check_packing(rows, capacity=1024):
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def test_packing_equals_tokenizers_and_is_tight(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op9_best_fit_packing(spark, sf).collect()
    sequences = check_packing(rows)
    total = sum(r["length"] for r in rows)
    assert sequences <= -(-total // 1024) + max(2, 0.02 * total / 1024)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for d in docs.collect():
        ids = np.array([*t.encode(d["text"], add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by[d["doc_id"]], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
            assert r["length"] == 1024 or r["piece"] == 0


def test_packing_edges(spark):
    docs = spark.createDataFrame([(None, "a"), (1, None), (1, None), (2, ""), (3, "b c " * 3000)], "doc_id long, text string")
    rows = packing.pack(docs, RANKS, PATTERN).collect()
    assert len(rows) == 4 + len([r for r in rows if r["doc_id"] == 3])
    check_packing(rows)
    assert packing.pack(docs.limit(0), RANKS, PATTERN).count() == 0


def places_of(placed, runs, capacity):
    """Every piece is placed once, sequences have no gaps and do not run over; how many sequences there are."""
    seen, used = {}, {}
    for length, rank, together, units, first, offset in placed:
        for u in range(units):
            for k in range(together):
                seen.setdefault(length, []).append(rank + u * together + k)
                used.setdefault(first + u, []).append((offset + k * length, length))
    assert {k: sorted(v) for k, v in seen.items()} == {k: list(range(n)) for k, n in runs.items()}
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(used)


def plain_best_fit(runs, capacity):
    """Best fit decreasing, one piece after the other: how many sequences it opens."""
    gaps, count = [], 0
    for length in sorted((k for k, n in runs.items() for _ in range(n)), reverse=True):
        fit = min((g for g in gaps if g >= length), default=None)
        if fit is None:
            count, fit = count + 1, capacity
        else:
            gaps.remove(fit)
        gaps.append(fit - length)
    return count


def in_rounds(runs, capacity):
    gaps, left, opened, out, rounds, most = [], [(k, 0, n) for k, n in sorted(runs.items())], 0, [], 0, 0
    while left:
        gaps, left, opened, placed = packing.one_round(gaps, left, opened, capacity)
        out, rounds, most = out + placed, rounds + 1, max(most, len(gaps))
    assert rounds <= 1 + capacity.bit_length() and most <= 4 * capacity
    return out, opened


@pytest.mark.parametrize("capacity", [64, 1024])
def test_rounds_equal_best_fit_decreasing(capacity):
    rng = random.Random(capacity)
    for k in range(60):
        runs = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(1, 30))}
        if k % 2:  # lengths in clumps
            middle = [rng.randint(1, capacity) for _ in range(3)]
            runs = {max(1, min(capacity, m + rng.randint(-2, 2))): rng.choice([1, 10, 300]) for m in middle for _ in range(3)}
        out, opened = in_rounds(runs, capacity)
        assert places_of(out, runs, capacity) == opened == plain_best_fit(runs, capacity)


@pytest.mark.parametrize("runs,best", [({600: 10, 300: 10}, 10), ({600: 1000, 300: 1000, 100: 1000, 7: 1000}, 1000), ({513: 1000, 255: 3000, 1: 1000}, 1250), ({700: 500, 320: 500}, 500)])
def test_clumped_lengths(spark, runs, best):
    placed = packing.plan(spark.createDataFrame(list(runs.items()), "length long, n long")).collect()
    assert places_of(placed, runs, 1024) == plain_best_fit(runs, 1024) == best


def test_few_rounds_for_very_many_pieces():
    for most, n in ((400, 10**5), (200, 10**9), (64, 10**6), (1024, 10**12)):
        out, opened = in_rounds({k: n for k in range(1, most + 1)}, 1024)
        tokens = n * most * (most + 1) // 2
        assert len(out) <= 40_000 and opened * 1024 <= 1.001 * tokens + 1024 * 1024


def test_plan_is_small_and_tight(spark):
    """Many pieces make no more placements than few; best fit one after the other opens as many sequences, about."""
    rng, few = random.Random(5), {}
    for _ in range(3000):
        n = min(1024, int(rng.lognormvariate(5, 1)) + 1)
        few[n] = few.get(n, 0) + 1
    many = {k: 40 * n for k, n in few.items()}
    rows = {}
    for name, runs in (("few", few), ("many", many)):
        rows[name] = packing.plan(spark.createDataFrame(list(runs.items()), "length long, n long")).collect()
        opened = places_of(rows[name], runs, 1024)
        if name == "few":
            assert opened == plain_best_fit(runs, 1024)
    assert len(rows["many"]) <= 2 * len(rows["few"]) + 100


def test_edges_of_scans(spark):
    """Null, empty, very long and repeated rows, an empty table and columns whose names clash."""
    texts = [(1, None), (2, ""), (3, "a b " * 30_000), (3, "a b " * 30_000), (None, "x y")]
    docs = spark.createDataFrame([(i, t, "n", 7, 1.5) for i, t in texts], "doc_id long, text string, ids string, piece int, score double")
    counts = sorted(map(str, token_tree.count_edits(docs, RANKS, PATTERN).collect()))
    assert len(counts) == 5 and len(set(counts)) == 4
    by = {r["doc_id"]: r for r in token_tree.count_edits(docs, RANKS, PATTERN).collect()}
    assert by[1]["n_tokens"] == by[2]["n_tokens"] == 0 and by[1]["n_words"] == 0 and by[3]["n_reencoded"] < 30
    assert bpe_codec.codec_digest(bpe_codec.round_trip(docs, RANKS, PATTERN)).count() == 5
    assert {r["doc_id"] for r in packing.pack(docs, RANKS, PATTERN).collect()} == {1, 2, 3, None}
    for f in (lambda d: token_tree.count_edits(d, RANKS, PATTERN), lambda d: bpe_codec.round_trip(d, RANKS, PATTERN), lambda d: packing.pack(d, RANKS, PATTERN)):
        assert f(docs.limit(0)).count() == 0
