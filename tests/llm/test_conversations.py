"""Conversation repair: the automaton against all edits tried out, whole digests against a plain loop, hot conversations in segments."""

import hashlib
import itertools
import random
import zlib

import pytest

from kmerflow.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        act = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if act == 1:
            text = ""
        elif act == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        elif act == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(act, 1)
    return out


def plain_best(symbols):
    """(cost, audit) by trying out: best of the rest from each state, audits compared as whole strings."""
    legal = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    never = (10**9, "")
    best = {(len(symbols), s, k): (0, "") if s in (0, 3) else never for s in range(4) for k in range(3)}
    for i in range(len(symbols), -1, -1):
        for k in range(3):  # inserts in a row so far, from many to few
            for s in range(4):
                ways = [best[i, s, k]] if i == len(symbols) else []
                if i < len(symbols):
                    must, role, extra = symbols[i]
                    ways.append((4 + best[i + 1, s, 2][0], "D" + best[i + 1, s, 2][1]))
                    if not must:
                        if role in legal[s]:
                            c, e = best[i + 1, legal[s][role], 2]
                            ways.append((c + extra, "K" + e))
                        c, e = best[i + 1, after[s], 2]
                        ways.append((c + 3 + extra, "R" + e))
                if k:
                    c, e = best[i, after[s], k - 1]
                    ways.append((c + 3, "I" + e))
                best[i, s, k] = min(ways)
    return best[0, 0, 2]


def plain_digest(rows, damage=True):
    ids = {r[0] for r in rows}
    rows = plain_damage(rows) if damage else [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    out = {}
    for conv in ids:
        own = [r for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        seen, faults = set(), []
        for _, _, role, text in own:
            left = text.rstrip(BLANKS)
            faults.append("blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else "")
            seen.add((role, text))
        cost, audit = plain_best([(f in ("blank", "duplicate"), r[2][:1], 3 * (f == "truncated")) for f, r in zip(faults, own, strict=True)])
        lines, state, at = [], 0, iter(own)
        for e in audit:
            if e == "I":
                lines.append(("assistant" if state == 2 else "user") + ":")
                state = 3 if state == 2 else 2
                continue
            _, _, role, text = next(at)
            if e == "D":
                continue
            if e == "R":
                role = "assistant" if state == 2 else "user"
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            lines.append(f"{role}:{text}")
        turns = [r[1] for r in own if r[1] is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def made(seed, n, convs, turns=9):
    rng, out = random.Random(seed), []
    texts = ["Yes.", "No!", "What?", "cut short", "  ", "", "a.\n\t ", "é…", "x.y", None]
    for _ in range(n):
        conv = rng.choice([None, *range(convs)])
        out.append((conv, rng.choice([None, *range(turns)]), rng.choice(["user", "assistant", "system", "tool", "", None, "User", "u2"]), rng.choice(texts)))
    return out


def got(df):
    return {r[0]: tuple(r)[1:] for r in df.select("conv_id", *cv.DIGEST[:5], "cost", "audit", "repaired_sha256").collect()}


def test_walk_equals_trying_out():
    walk = cv.Walk()
    every = ["".join(s) for n in range(6) for s in itertools.product("sUxaD", repeat=n)]
    for signature in sorted(every, key=lambda s: s[::-1]):
        walk.to(cv.FINAL, signature[::-1])
        want = plain_best([(c == "D", c.lower(), 3 * c.isupper()) for c in signature])
        assert walk.audit(0)[:2] == want
    # each common ending is one node: as many nodes as different endings
    assert walk.made == len({s[k:] for s in every for k in range(len(s))})


@pytest.mark.parametrize("length", [1 << 16, 3])
def test_digest_equals_a_plain_loop(spark, length):
    rows = made(length, 900, 90) + [(1000, t, "user", "Hm.") for t in range(70)] + [(1001, None, "assistant", "Same.")] * 50
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", copies int, part string").repartition(5)
    assert got(cv.digest(cv.damaged(df), df, length)) == plain_digest(rows)


def test_long_conversation_in_segments(spark):
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), f"{rng.randint(0, 400)}" + rng.choice([".", "", "!"])) for t in range(1500)]
    rows += [(8, 0, "user", "A."), (8, 1, "assistant", "B.")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(cv.digest(df, df, 40)) == plain_digest(rows, damage=False)


def test_repaired_rows_follow_the_grammar(spark):
    rows = made(11, 600, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    out = {}
    for r in cv.repair(df, 5).orderBy("conv_id", "at").collect():
        if r["edit"] != "D":
            out.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    want = plain_digest(rows, damage=False)
    import re

    for conv, digest in want.items():
        own = out.get(conv, [])
        assert re.fullmatch("(s?(ua)+)?", "".join(role[0] for role, _ in own))
        assert hashlib.sha256("\n".join(f"{role}:{text}" for role, text in own).encode()).hexdigest() == digest[-1]


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert cv.digest(cv.damaged(df), df).collect() == [] and cv.repair(df).collect() == []
    assert cv.digest(cv.damaged(df), df).columns[:1] == ["conv_id"]
