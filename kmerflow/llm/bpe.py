"""Byte-level BPE: a lazily determinised transducer for encoding, a UTF-8 state machine for decoding.

**Encoding.** For each prefix of a piece there is one last token of its encoding: the token that ends there and may
follow the last token of the prefix before it. A later token can only start where the bytes since then begin some token
of the vocabulary. A state of the transducer is the bytes read since the last token boundary that all those starts agree
on; reading a byte leads to the next state and emits the tokens that became certain. States and transitions are made
when first needed and kept, so the lookahead is bounded by the longest token and the table by the text's variety.

**Words.** A space between two characters that are not white space always starts a new piece, so what lies between such
spaces is encoded alone and its ids are kept in a bounded table: the transducer runs once for each distinct word.

**Decoding.** Ids turn to bytes; a state machine over bytes, stepped a token at a time with remembered steps, tells
where the complete characters end, so that a stream can be shown while it grows.

Defined results: an empty text has no ids; no ids give no bytes; bytes that are not UTF-8 pass unchanged; a pattern that does
not start a piece at every space between words raises.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator

MAX_WORDS, MAX_STATES = 150_000, 250_000
#: A space that starts a new piece whatever stands around; both neighbours are kept.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space but for space and line feed.
OTHER_SPACE = re.compile(r"[^\S \n]")


def words_of(text: str) -> list[str]:
    """The text in parts that are encoded alone; each but the first starts with its space."""
    if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or OTHER_SPACE.search(text):
        parts = CUT.split(text)  # a space next to other white space or at an end: the plain split would not do
    else:
        parts = text.split(" ")
    if len(parts) > 1:
        parts[1:] = map(" ".__add__, parts[1:])
    return parts


PROBES = ("it's a b  c\n d\te 12 345é! -x ?? y\r\n\n z", " a", "a ", "漢 字 \xa0x", "don't STOP we'll __a== b", "1 2 a1 1a")


def check_pattern(pattern: str) -> str:
    """The pattern, if its pieces are those of the words that are encoded alone; else raises."""
    import regex

    pieces = regex.compile(pattern).findall
    for text in PROBES:
        if pieces(text) != [p for w in words_of(text) for p in pieces(w)] or pieces("word") != ["word"] or pieces(" word") != [" word"]:
            raise ValueError("the pattern does not start a piece at every space between words")
    return pattern


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


NEVER = 1 << 40


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The encoding of a short piece by its definition: the pair of the lowest rank merges first."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    pairs = [ranks.get(piece[k : k + 2], NEVER) for k in range(len(piece) - 1)]
    while pairs:
        best = min(pairs)
        if best == NEVER:
            break
        at = pairs.index(best)
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
        del pairs[at]
        if at:
            pairs[at - 1] = ranks.get(parts[at - 1] + parts[at], NEVER)
        if at < len(pairs):
            pairs[at] = ranks.get(parts[at] + parts[at + 1], NEVER)
    return parts


class State:
    """Pending bytes, and for each start still open the ends of the tokens of the encoding up to there."""

    __slots__ = ("bytes", "chains", "next", "final")

    def __init__(self, pending: bytes, chains: tuple[tuple[int, ...], ...]) -> None:
        self.bytes, self.chains = pending, chains
        self.next: dict[int, tuple[State, tuple[int, ...]]] = {}
        self.final: tuple[int, ...] | None = None


class Transducer:
    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES) -> None:
        self.ranks, self.max_states = ranks, max_states
        self.begins = {t[:k] for t in ranks for k in range(1, len(t) + 1)}
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.start = State(b"", ((0,),))
        self.states: dict[bytes, State] = {b"": self.start}
        self.follows.clear()

    def may_follow(self, a: bytes, b: bytes) -> bool:
        known = self.follows.get((a, b))
        if known is None:
            both = a + b
            known = self.follows[a, b] = merge(both, self.ranks) == ([a, b] if a else [b]) if not a or both not in self.ranks else False
        return known

    def tokens(self, pending: bytes, ends: tuple[int, ...]) -> tuple[int, ...]:
        return tuple(self.ranks[pending[s:e]] for s, e in zip(ends, ends[1:], strict=False))

    def step(self, state: State, byte: int) -> tuple[State, tuple[int, ...]]:
        """The next state and what became certain; made once and kept. A chain starts with 0 and ends with its start."""
        pending = state.bytes + bytes([byte])
        ranks, begins, n, own, chains = self.ranks, self.begins, len(pending), None, []
        for chain in state.chains:  # longest token first
            rest = pending[chain[-1] :]
            if rest in begins:
                chains.append(chain)
                if own is None and rest in ranks and self.may_follow(pending[chain[-2] : chain[-1]] if len(chain) > 1 else b"", rest):
                    own = (*chain, n)
        chains.append(own)
        sure, least = 0, min(map(len, chains))
        while sure + 1 < least and all(c[sure + 1] == own[sure + 1] for c in chains):
            sure += 1
        emitted = ()
        if sure:
            at = own[sure]
            emitted = self.tokens(pending, own[: sure + 1])
            pending = pending[at:]
            chains = [tuple(e - at for e in c[sure:]) for c in chains]
        grown = self.states.get(pending)
        if grown is None:
            grown = self.states[pending] = State(pending, tuple(chains))
        state.next[byte] = grown, emitted
        return grown, emitted

    def encode(self, piece: bytes) -> list[int]:
        if len(self.states) > self.max_states:
            self.reset()
        state, out = self.start, []
        for byte in piece:
            made = state.next.get(byte)
            state, tokens = made if made is not None else self.step(state, byte)
            if tokens:
                out += tokens
        if state.final is None:
            state.final = self.tokens(state.bytes, state.chains[-1])
        out += state.final
        return out


class WordTable(dict):
    """Word -> whatever ``make`` gives for it. Holds a bounded number of words: what was not used for long goes."""

    def __init__(self, make, most: int = MAX_WORDS) -> None:
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, word: str):
        value = self.older.pop(word, None)
        if value is None:
            value = self.make(word)
            if len(word) > 64:
                return value
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[word] = value
        return value


class Encoder:
    """Text to ids by the transducer, pieces as the public pattern cuts them."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import regex

        self.transducer = Transducer(load_ranks(ranks_path))
        self.pieces = regex.compile(check_pattern(pattern)).findall
        self.words = WordTable(self.encode_word)

    def encode_word(self, word: str) -> bytes:
        out: list[int] = []
        for piece in (word,) if word[1:].isalpha() and (word[0] == " " or word[0].isalpha()) else self.pieces(word):
            out += self.transducer.encode(piece.encode())
        return array("i", out).tobytes()

    def packed(self, text: str) -> bytes:
        """Ids as packed 32-bit integers."""
        return b"".join(map(self.words.__getitem__, words_of(text)))

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(text)).tolist()


# UTF-8 states: 0 between characters; 1, 2, 3 continuation bytes due; 4 to 7 the second byte has bounds; 8 never again.
def _utf8_step(state: int, byte: int) -> int:
    if state == 0:
        if byte < 0x80:
            return 0
        if 0xC2 <= byte <= 0xDF:
            return 1
        if byte == 0xE0:
            return 4
        if byte == 0xED:
            return 5
        if 0xE1 <= byte <= 0xEF:
            return 2
        if byte == 0xF0:
            return 6
        if byte == 0xF4:
            return 7
        return 3 if 0xF1 <= byte <= 0xF3 else 8
    low, high, after = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}.get(state, (1, 0, 8))
    return after if low <= byte <= high else 8


class Decoder:
    """Ids to bytes, and to text as far as characters are complete."""

    def __init__(self, ranks_path: str) -> None:
        self.token = {i: t for t, i in load_ranks(ranks_path).items()}
        self.steps: list[dict[int, tuple[int, int]]] = [{} for _ in range(9)]

    def bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def _made(self, state: int, i: int) -> tuple[int, int]:
        """The state after token i, and how many of its bytes lie behind the last complete character (-1: none ended)."""
        tail, token, now = -1, self.token[i], state
        for k, byte in enumerate(token):
            now = _utf8_step(now, byte)
            if now == 8:
                break
            if now == 0:
                tail = len(token) - k - 1
        self.steps[state][i] = now, tail
        return now, tail

    def stream(self, parts: Iterable[Iterable[int]]) -> Iterator[bytes]:
        """For each part the bytes of the characters that it completes; the last yield has what is left.

        Bytes that cannot be UTF-8 pass through unchanged, from the first such byte on at once.
        """
        state, held, steps, token = 0, b"", self.steps, self.token
        for ids in parts:
            ids = list(ids)
            made, behind = held + b"".join(map(token.__getitem__, ids)), len(held)
            for i in ids:
                state, tail = steps[state].get(i) or self._made(state, i)
                behind = tail if tail >= 0 else behind + len(token[i])
            if state == 8:
                behind = 0
            at = len(made) - behind
            held = made[at:]
            yield made[:at]
        yield held
