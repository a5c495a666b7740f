"""Edit-aware token counts: a segment tree of token counts for each document.

Leaves are the parts of the text that are encoded alone (a space between two other characters starts one). Inner nodes
hold sums of characters and tokens. An edit re-encodes only the leaves it touches and one on each side, then updates
the sums above; a leaf block that grew too long is split and the tree above rebuilt from block sums.

Defined results: null or empty text counts 0 tokens; offsets beyond the text are cut to it; repeated rows give repeated
results; an empty table gives an empty table; further columns are not looked at.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import WordTable, check_pattern, load_ranks, words_of
from .bpe_codec import made
from .common import scan

BLOCK = 64


class Counter:
    """Tokens of a part of a text, by the public tokenizer."""

    def __init__(self, ranks_path: str, pattern: str) -> None:
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=check_pattern(pattern), mergeable_ranks=load_ranks(ranks_path), special_tokens={})
        self.words = WordTable(lambda word: len(encoding.encode_ordinary(word)))

    def __call__(self, word: str) -> int:
        return self.words[word]


class TokenTree:
    def __init__(self, text: str, count: Callable[[str], int]) -> None:
        self.count, self.encoded = count, 0
        self.blocks = self._blocks(words_of(text) if text else [])
        self._build()

    def _counted(self, words: list[str]) -> list[tuple[str, int]]:
        self.encoded += len(words)
        return list(zip(words, map(self.count, words), strict=True))

    def _blocks(self, words: list[str]) -> list[list[tuple[str, int]]]:
        counted = self._counted(words)
        return [counted[k : k + BLOCK] for k in range(0, len(counted), BLOCK)] or [[]]

    @staticmethod
    def _sums(block: list[tuple[str, int]]) -> tuple[int, int]:
        return sum(len(w) for w, _ in block), sum(n for _, n in block)

    def _build(self) -> None:
        self.width = 1
        while self.width < len(self.blocks):
            self.width *= 2
        self.chars, self.tokens = [0] * (2 * self.width), [0] * (2 * self.width)
        for k, block in enumerate(self.blocks):
            self.chars[self.width + k], self.tokens[self.width + k] = self._sums(block)
        for k in range(self.width - 1, 0, -1):
            self._pull(k)

    def _pull(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def find(self, offset: int) -> tuple[int, int, int]:
        """(block, leaf, its first character) of the leaf that holds the character at ``offset``."""
        offset, base, k = max(0, min(offset, self.n_chars - 1)), 0, 1
        while k < self.width:
            k *= 2
            if offset - base >= self.chars[k]:
                base += self.chars[k]
                k += 1
        b = k - self.width
        ends = []
        for w, _ in self.blocks[b]:
            ends.append((ends[-1] if ends else base) + len(w))
        leaf = bisect.bisect_right(ends, offset)
        return b, leaf, ends[leaf] - len(self.blocks[b][leaf][0])

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters ``start:end`` by ``new``."""
        if not self.n_chars:
            self.blocks = self._blocks(words_of(new) if new else [])
            self._build()
            return
        start = max(0, min(start, self.n_chars))
        end = max(start, min(end, self.n_chars))
        b0, i0, at = self.find(start)
        b1, i1, _ = self.find(max(start, end - 1))
        b0, i0, before = self._left(b0, i0)  # one leaf of context on each side
        b1, i1 = self._right(b1, i1)
        at -= before
        if b0 == b1:
            old = self.blocks[b0][i0 : i1 + 1]
        else:
            old = self.blocks[b0][i0:] + [x for b in self.blocks[b0 + 1 : b1] for x in b] + self.blocks[b1][: i1 + 1]
        text = "".join(w for w, _ in old)
        text = text[: start - at] + new + text[end - at :]
        changed = self.blocks[b0][:i0] + self._counted(words_of(text) if text else []) + self.blocks[b1][i1 + 1 :]
        if b1 - b0 <= 1 and 0 < len(changed) <= 4 * BLOCK:
            self.blocks[b0] = changed if b0 == b1 else changed[: len(changed) // 2]
            if b1 != b0:
                self.blocks[b1] = changed[len(changed) // 2 :]
            for b in {b0, b1}:
                k = self.width + b
                self.chars[k], self.tokens[k] = self._sums(self.blocks[b])
                while k > 1:
                    k //= 2
                    self._pull(k)
        else:
            self.blocks[b0 : b1 + 1] = [changed[k : k + BLOCK] for k in range(0, len(changed), BLOCK)]
            self.blocks = self.blocks or [[]]
            self._build()

    def _left(self, b: int, i: int) -> tuple[int, int, int]:
        if i:
            return b, i - 1, len(self.blocks[b][i - 1][0])
        for p in range(b - 1, -1, -1):
            if self.blocks[p]:
                return p, len(self.blocks[p]) - 1, len(self.blocks[p][-1][0])
        return b, i, 0

    def _right(self, b: int, i: int) -> tuple[int, int]:
        if i + 1 < len(self.blocks[b]):
            return b, i + 1
        for p in range(b + 1, len(self.blocks)):
            if self.blocks[p]:
                return p, 0
        return b, i


def standard_edits(text: str) -> list[tuple[int, int, str]]:
    """The query's edits, each on the text as the one before left it: replace a stretch, insert, delete."""
    n = len(text)
    return [(n // 3, n // 3 + 7, "Edit 42 "), (n // 2, n // 2, text[:11]), (2 * n // 3, 2 * n // 3 + 5, "")]


def count_edits(df: DataFrame, ranks_path: str, pattern: str, edits: Callable[[str], Iterable[tuple[int, int, str]]] = standard_edits) -> DataFrame:
    """``doc_id, n_tokens, n_words, n_edits, n_tokens_edited, n_reencoded``: before, and after the edits of each document."""

    def row(doc_id, text):
        tree = TokenTree(text, made(Counter, ranks_path, pattern))
        before, words, k = tree.n_tokens, tree.encoded, 0
        for k, edit in enumerate(edits(text), 1):
            tree.edit(*edit)
        return doc_id, before, words, k, tree.n_tokens, tree.encoded - words

    names = ["doc_id", "n_tokens", "n_words", "n_edits", "n_tokens_edited", "n_reencoded"]
    return scan(df, row, ", ".join(f"{x} long" for x in names), names, [pa.int64()] * 6)
