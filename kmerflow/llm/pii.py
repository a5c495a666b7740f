"""Personal data with offset-preserving deobfuscation.

Base kinds are found in the text as it stands. Then three transducers rewrite the whole text, each the output of the one
before, and keep for every stretch they write the stretch it came from:

1. letters: homoglyphs, full-width forms and digits of other scripts to ASCII; characters without width go;
2. digits: spelled digits of four languages to digits, also next to numerals, and spelled dots between numbers;
3. addresses: ``(at)``, ``[dot]``, `` at `` ... `` dot `` and the like to ``@`` and ``.``.

The detectors run once on what comes out, and each find is mapped back through the three to source offsets. Finds inside a
base span of their kind are dropped. No length is bounded; everything is linear in the text, and a text without any
disguise costs a few searches.

Defined results: null or empty text has no spans; repeated rows give repeated results; offsets are code points; an empty
table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scan

KINDS = ["email", "ip", "card", "phone"]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: No match can start inside a run of digits whose start failed, so the runs are taken whole.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of local@domain, leftmost and non-overlapping: a match holds one @, so each @ is tried once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        else:
            end = at + 1
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


#: Look-alikes of ASCII letters in Greek and Cyrillic.
HOMOGLYPHS = dict(zip("АВСЕНІЈКМОРЅТХаеорсухіјѕΑΒΕΖΗΙΚΜΝΟΡΤΥΧο", "ABCEHIJKMOPSTXaeopcyxijsABEZHIKMNOPTYXo", strict=True))
#: Full-width forms of ! to ~ lie at a fixed distance from ASCII; digits of some scripts follow one another.
HOMOGLYPHS |= {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
HOMOGLYPHS |= {chr(zero + k): str(k) for zero in (0x660, 0x6F0, 0x966) for k in range(10)}
#: Characters without width, dropped inside identifiers.
INVISIBLE = "​‌‍⁠﻿­"
#: Spelled digits in English, German, French and Spanish.
DIGITS = {
    w: str(k)
    for words in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for k, w in enumerate(words.split())
} | {"oh": "0"}
#: Spelled marks.
DOTS, ATS, PLUS = ("dot", "punkt", "point", "punto"), ("at", "arroba", "arobase", "klammeraffe"), ("plus", "más")
#: After a plain word for at, the last label must be one of these.
ENDINGS = frozenset("com org net edu gov info io biz de fr es it uk eu co us ru ch nl".split())

LETTERS = {ord(a): b for a, b in HOMOGLYPHS.items()}
HIDDEN = re.compile("[" + INVISIBLE + "]")
_END = r"(?![^\W\d_])"
_WORD, _DOT = "(?:" + "|".join(sorted(DIGITS, key=len, reverse=True)) + ")" + _END, "(?:" + "|".join(DOTS) + ")" + _END
STRETCH = re.compile(rf"(?<!\w)(?:\+|(?:{'|'.join(PLUS)})[\x20-]+)?(?:{_WORD}|[0-9]++)(?:[\x20\t,.-]*(?:{_DOT}\x20+)?(?:{_WORD}|[0-9]++))+", re.I)
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\+|[\x20\t,.-]+")
_OPEN, _CLOSE = r"[(\[{<]\x20*", r"\x20*[)\]}>]"
AT = re.compile(rf"{_OPEN}(?:{'|'.join(ATS)}|@){_CLOSE}|(?<=\x20)(?:{'|'.join(ATS)})(?=\x20)|@", re.I)
DOT = re.compile(rf"\x20*{_OPEN}(?:{'|'.join(DOTS)}|\.){_CLOSE}\x20*|\x20+(?:{'|'.join(DOTS)})\x20+|\.", re.I)
DOT_BEFORE = re.compile(rf"(?:{_OPEN}(?:{'|'.join(DOTS)}|\.){_CLOSE}|\x20(?:{'|'.join(DOTS)}))\Z", re.I)
LABEL = re.compile(r"[A-Za-z0-9-]+")
ODD = re.compile("[" + "".join(map(re.escape, HOMOGLYPHS)) + INVISIBLE + "]")
SPELLING = frozenset(DIGITS) | frozenset(DOTS)


def may_spell(text: str) -> bool:
    """Whether a spelled digit or dot stands beside a number; a cheap test that most texts fail."""
    words = text.lower().replace("-", " ").replace(",", " ").replace(".", " ").split()
    if SPELLING.isdisjoint(words):
        return False
    number = [w in DIGITS or w.isdigit() for w in words]
    return any(w in SPELLING and (k > 0 and number[k - 1] or k + 1 < len(words) and number[k + 1]) for k, w in enumerate(words))


def may_address(text: str) -> bool:
    """Whether an at or a dot is disguised; a cheap test that most texts fail."""
    low = text.lower()
    dots = any(w in low for w in DOTS) or any(o + "." in low for o in "([{<") or ". )" in low
    if "@" in low:
        return dots or " @" in low or "@ " in low or any(o + "@" in low for o in "([{<")
    return dots and any(f" {w} " in low for w in ATS) or any(f"{w}{c}" in low or f"{w} {c}" in low for w in ATS for c in ")]}>")


class Rewritten:
    """``text`` with pieces ``(start, end, new)`` replaced, ascending and apart, and the way back."""

    def __init__(self, text: str, pieces: list[tuple[int, int, str]]) -> None:
        out, at, self.starts, self.marks, size = [], 0, [], [], 0
        for start, end, new in pieces:
            out += [text[at:start], new]
            size += start - at
            self.starts.append(size)
            self.marks.append((size + len(new), start, end))
            size, at = size + len(new), end
        out.append(text[at:])
        self.text = "".join(out)

    def back(self, start: int, end: int) -> tuple[int, int]:
        """The source of what stands from ``start`` to ``end``; a replaced piece counts whole."""
        out = []
        for at in (start, end - 1):
            k = bisect_right(self.starts, at) - 1
            if k < 0:
                out.append((at, at + 1))
                continue
            stop, s, e = self.marks[k]
            out.append((s, e) if at < stop else (at - stop + e, at - stop + e + 1))
        return out[0][0], out[1][1]


def letters(text: str) -> list[tuple[int, int, str]]:
    """Characters without width; what keeps its place is translated before."""
    return [] if text.isascii() else [(m.start(), m.end(), "") for m in HIDDEN.finditer(text)]


def digits(text: str) -> Iterator[tuple[int, int, str]]:
    """Spelled digits and dots of stretches of numbers; what stands beside a spelled digit goes, but for a dot."""
    if not may_spell(text):
        return
    for m in STRETCH.finditer(text):
        tokens = [(t.start(), t.end(), t.group()) for t in TOKEN.finditer(text, m.start(), m.end())]
        words = [t.lower() for _, _, t in tokens if t[0].isalpha()]
        if sum(w in DIGITS for w in words) < 2 and not any(w in DOTS for w in words):
            continue  # one word beside numerals is prose: "... 1373 un ..."
        number = [t.isdigit() for _, _, t in tokens]
        for k, (s, e, t) in enumerate(tokens):
            word = t.lower()
            if word in DIGITS:
                yield s, e, DIGITS[word]
            elif word in DOTS:
                yield s, e, "."
            elif word in PLUS:
                yield s, e, "+"
            elif not t[0].isalnum() and t != "+" and not (0 < k < len(tokens) - 1 and number[k - 1] and number[k + 1]):
                yield s, e, "." if "." in t else ""


def addresses(text: str) -> Iterator[tuple[int, int, str]]:
    """At and dot disguises of an address: name, at, labels parted by dots of any form."""
    done = 0
    for m in AT.finditer(text) if may_address(text) else ():
        start, end = m.span()
        while end < len(text) and text[end] == " ":
            end += 1
        label = LABEL.match(text, end)
        if not label:
            continue
        dots, last = [], label
        while (dot := DOT.match(text, last.end())) and (nxt := LABEL.match(text, dot.end())):
            dots.append(dot.span())
            last = nxt
        hidden = [(s, e) for s, e in dots if e - s > 1]
        if not dots or m.group()[0].isalpha() and not (hidden and last.group().lower() in ENDINGS):
            continue  # plain words "x at y.z", "x at the dot of" are prose
        while start > done and text[start - 1] == " ":
            start -= 1
        names, at = [], start
        while True:
            name = at
            while name > done and text[name - 1] in LOCAL_CHARS:
                name -= 1
            if name == at:
                break
            at = name
            while name > done and text[name - 1] == " ":
                name -= 1
            before = DOT_BEFORE.search(text, max(done, name - 16), name)
            if not before or before.start() <= done:
                break
            begin = before.start()
            while begin > done and text[begin - 1] == " ":
                begin -= 1
            if begin == done or text[begin - 1] not in LOCAL_CHARS:
                break
            names.append((begin, at))
            at = begin
        yield from ((s, e, ".") for s, e in reversed(names))
        if end - start > 1:
            yield start, end, "@"
        yield from ((s, e, ".") for s, e in hidden)
        done = last.end()


def hidden_spans(text: str) -> list[tuple[int, int, int]]:
    """What the detectors find after rewriting, at source offsets."""
    plain, chain = text.translate(LETTERS) if not text.isascii() and ODD.search(text) else text, []
    for rule in (letters, digits, addresses):
        pieces = list(rule(plain))
        if pieces:
            chain.append(Rewritten(plain, pieces))
            plain = chain[-1].text
    if plain == text:
        return []
    out = []
    for s, kind, e in base_spans(plain):
        for step in reversed(chain):
            s, e = step.back(s, e)
        out.append((s, kind, e))
    return out


def all_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind number, end, base) sorted; a hidden span inside another of its kind goes."""
    base = base_spans(text)
    taken = {k: [(s, e) for s, kind, e in base if kind == k] for k in range(4)}
    out = [(s, k, e, True) for s, k, e in base]
    for s, k, e in sorted(set(hidden_spans(text)), key=lambda x: (x[0], -x[2], x[1])):
        if not any(a <= s and e <= b for a, b in taken[k]):
            taken[k].append((s, e))
            out.append((s, k, e, False))
    return sorted(out)


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_pii(df: DataFrame) -> DataFrame:
    """``doc_id, spans array<struct<kind,start,end,base>>`` for every row, spans by start, then kind."""

    def row(doc_id, text):
        return doc_id, [{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in all_spans(text)]

    return scan(df, row, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>", ["doc_id", "spans"], [pa.int64(), SPANS])


def span_digest(found: DataFrame, kinds: list[str]) -> DataFrame:
    """Counts and digest of the base spans, and all spans written out."""
    base = F.filter("spans", lambda x: x["base"])
    written = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in kinds], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
