"""Secret scan: fixed forms, then novelty against a dictionary-primed zstandard compressor.

Fixed forms (assign, access, hex) are the base. For the rest, candidates are unbroken runs of key characters near a word of a
sensitive context, before or behind it, of any length. A candidate's novelty is what it adds to the compressed size of its
surroundings, with a dictionary of identifiers and the surrounding text as the compressor's history: names, paths and words
compress well, random keys do not. A candidate of at least ``MIN_BITS`` added bits a character, long ones in any of their
parts of up to ``PART`` characters, is reported as kind ``novel``, together with the lines of key characters right before
and after it. A run needs ``MIN_OPAQUE`` characters in segments that are neither numbers nor like words: short runs cost
some bits more than they hold, so dates, versions and paths of words would pass by novelty alone.

Defined results: null or empty text has no spans; repeated rows give repeated results; offsets are code points; an empty
table gives an empty table; further columns are not looked at. A candidate inside a base span is not repeated; one that
reaches beyond it is reported whole.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import scan
from .pii import SPANS

KINDS = ["assign", "access", "hex", "novel"]
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Words whose neighbourhood may hold a secret.
CONTEXT = re.compile(r"(?:passw|secret|token|api.?key|credential|private.?key|access.?key|auth|bearer|signature|client.?id|pwd)", re.I | re.A)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
#: A line of key characters alone, after or before another; shorter ones only as the end of a block.
NEXT_LINE = re.compile(r"[\x20\t]*\r?\n[\x20\t]*([A-Za-z0-9+/_=.-]+)(?=[\x20\t]*(?:\r?\n|\Z))")
LINE = re.compile(r"[\x20\t]*([A-Za-z0-9+/_=.-]{16,})[\x20\t\r]*")
END_LINE = re.compile(r"[\x20\t]*\r?\n[\x20\t]*-----END")
NEAR, AROUND, WIDE, MIN_BITS, MIN_OPAQUE, PART = 64, 256, 2048, 4.5, 12, 512
#: What code and configuration are full of, as the compressor's history.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_id client_secret credential authorization bearer "
    "username user_id session cookie config settings environment development production localhost example.com https://www. "
    "function return import class public static void string integer boolean default value data result response request "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef true false null none undefined "
    "get_value set_value create_user delete_user update_user getElementById addEventListener the and that with from this"
).encode()

_compressor = None


def added_bits(before: bytes, candidate: bytes) -> float:
    """Bits a character that ``candidate`` adds after ``before`` and the identifier dictionary."""
    global _compressor
    if _compressor is None:
        import zstandard as zstd

        _compressor = zstd.ZstdCompressor(level=19, dict_data=zstd.ZstdCompressionDict(IDENTIFIERS, dict_type=zstd.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)
    grown = len(_compressor.compress(before + candidate)) - len(_compressor.compress(before))
    return 8 * grown / max(1, len(candidate))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str, near: int | None = NEAR) -> Iterator[tuple[int, int]]:
    """Whole runs of key characters up to ``near`` characters from a context word (None: anywhere in a text that has one);
    of a run ``word=...`` what follows the sign, if that is long enough."""
    near = len(text) if near is None else near
    words = [m.span() for m in CONTEXT.finditer(text)]
    runs = [m.span() for m in CANDIDATE.finditer(text)] if words else []
    ends, at = [e for _, e in runs], 0
    for left, right in words:
        at = max(at, bisect_left(ends, left - near))
        while at < len(runs) and runs[at][0] <= right + near:
            s, e = runs[at]
            at += 1
            if s <= left < e and (sign := text.find("=", right, e - 16)) >= 0:
                s = sign + 1
            yield s, e


SEGMENT = re.compile(r"[A-Za-z0-9]+")
#: Numbers, and words or single letters with a short number beside them, as in versions, hosts and times.
NUMBERED = re.compile(r"[0-9]+|([A-Za-z]+)[0-9]{1,4}|[0-9]{1,4}[A-Za-z]{1,2}[0-9]{0,2}")
HUMP = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
CONSONANTS = re.compile(r"[b-df-hj-np-tv-xz]+")


def pairs_in(text: str) -> set[str]:
    low = text.lower()
    return {low[k : k + 2] for k in range(len(low) - 1) if low[k : k + 2].isalpha() and low[k : k + 2].isascii()}


def like_words(letters: str, known: set[str]) -> bool:
    """Letters in humps of a fair length, most of whose pairs the surroundings know, without long runs of consonants."""
    humps = HUMP.findall(letters)
    if len(letters) >= 8 and 4 * len(humps) > len(letters) and not letters.isupper():
        return False
    low = letters.lower()
    pairs = [h[k : k + 2].lower() for h in humps for k in range(len(h) - 1)]
    share = sum(x in known for x in pairs) / max(1, len(pairs))
    run = max(map(len, CONSONANTS.findall(low)), default=0)
    vowels = 1 - sum(map(len, CONSONANTS.findall(low))) / len(low)
    chance = len(known) / 676 + 0.2  # what random letters hardly reach
    return len(low) < 4 or run <= 6 and 0.25 <= vowels <= 0.65 and share >= min(0.85, chance) or run <= 7 and share >= 0.85 >= chance


def opaque(own: str, around: str) -> int:
    """Characters of ``own`` in segments that are neither numbers nor like words."""
    known, n = None, 0
    for m in SEGMENT.finditer(own):
        part = m.group()
        if part.isalpha() or (numbered := NUMBERED.fullmatch(part)) and numbered.group(1):
            known = pairs_in(IDENTIFIERS.decode().replace("abcdefghijklmnopqrstuvwxyz", "") + " " + around) if known is None else known
            if like_words(part if part.isalpha() else numbered.group(1), known):
                continue
        elif numbered:
            continue
        n += len(part)
    return n


def mixed(own: str) -> bool:
    return any(c.isdigit() for c in own) + any(c.islower() for c in own) + any(c.isupper() for c in own) >= 2


def is_novel(text: str, s: int, e: int) -> bool:
    around = (text[max(0, s - AROUND) : s] + text[e : e + AROUND]).encode()
    size = -(-(e - s) // -(-(e - s) // PART))
    return any(added_bits(around, text[k : min(e, k + size)].encode()) >= MIN_BITS for k in range(s, e, size))


def carried_on(text: str, s: int, e: int) -> tuple[int, int]:
    """The span with the lines of key characters right before and after it."""
    while m := NEXT_LINE.match(text, e):
        own = m.group(1)
        if not (mixed(own) if len(own) >= 16 else own.endswith("=") or END_LINE.match(text, m.end(1))):
            break
        e = m.end(1)
    while (start := text.rfind("\n", 0, s)) >= 0 and not text[start + 1 : s].strip("\x20\t"):
        m = LINE.fullmatch(text, text.rfind("\n", 0, start) + 1, start)
        if not m or not mixed(m.group(1)):
            break
        s = m.start(1)
    return s, e


def novel_spans(text: str, taken: list[tuple[int, int]], near: int | None = NEAR) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in candidates(text, near):
        if out and s < out[-1][1] or any(x <= s and e <= y for x, y in taken):
            continue
        if opaque(text[s:e], text[max(0, s - WIDE) : s] + " " + text[e : e + WIDE]) >= MIN_OPAQUE and is_novel(text, s, e):
            out.append(carried_on(text, s, e))
    return out


def all_spans(text: str, near: int | None = NEAR) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted(base + [(s, 3, e) for s, e in novel_spans(text, [(s, e) for s, _, e in base], near)])


def find_secrets(df: DataFrame, near: int | None = NEAR) -> DataFrame:
    """``doc_id, spans array<struct<kind,start,end,base>>`` for every row, spans by start, then kind.

    ``near``: how far from a context word a key may stand; None looks at every run of a text that has such a word.
    """

    def row(doc_id, text):
        return doc_id, [{"kind": KINDS[k], "start": s, "end": e, "base": k < 3} for s, k, e in all_spans(text, near)]

    return scan(df, row, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>", ["doc_id", "spans"], [pa.int64(), SPANS])


def redact(text: str) -> str:
    """The text with each span replaced by ``[secret]``; overlapping spans become one."""
    out, at = [], 0
    for s, _, e in all_spans(text):
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], "[secret]"]
        at = e
    return "".join([*out, text[at:]]) if out else text
