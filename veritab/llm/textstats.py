"""Flat numpy views over runs of texts: words, lines and their numbers, without a Python loop per word.

A chunk joins its texts with one newline after each, as UTF-8 bytes. A word is a run of bytes other than
0x20 and 0x09-0x0D; a line ends at each newline. Words and lines are told apart by their bytes, never by a hash alone.
"""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa

U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
DIGIT = np.zeros(256, bool)
DIGIT[ord("0") : ord("9") + 1] = True
LETTER = UPPER.copy()
LETTER[ord("a") : ord("z") + 1] = True
LETTER[0xC3:0xF5] = True
PUNCT = np.zeros(256, bool)
PUNCT[[ord(c) for c in ".,;:!?"]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def numbered(values: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """A number for each value, equal for equal values only, and the distinct values in the order of their numbers."""
    seen: dict[bytes, int] = defaultdict(itertools.count().__next__)
    return np.fromiter(map(seen.__getitem__, values), np.int64, len(values)), list(seen)


def rows_numbered(*columns: np.ndarray) -> np.ndarray:
    """A number for each row of columns of numbers from 0 on, equal for equal rows only."""
    out, size = columns[0], int(columns[0].max(initial=0)) + 1
    for c in columns[1:]:
        n = int(c.max(initial=0)) + 1
        if size * n >= 1 << 63:
            out = np.unique(out, return_inverse=True)[1]
            size = int(out.max(initial=0)) + 1
        out, size = out * n + c, size * n
    return out


def again(keys: np.ndarray) -> np.ndarray:
    """Which rows have the key of an earlier one."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = keys[order][1:] == keys[order][:-1]
    return out


def utf8(texts: pa.Array) -> list[bytes]:
    return [x or b"" for x in texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()]


class Chunk:
    """Words and lines of a list of UTF-8 texts."""

    def __init__(self, texts: list[bytes]):
        self.n = len(texts)
        self.raw = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(self.raw, np.uint8)
        self.doc_start = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)
        space = SPACE[self.buf]
        self.solid = ~space
        first = self.solid.copy()
        first[1:] &= space[:-1]
        self.w_start = np.flatnonzero(first)
        self.w_end = np.flatnonzero(self.solid[:-1] & space[1:]) + 1
        self.w_doc = np.searchsorted(self.doc_start, self.w_start, "right") - 1
        self.l_end = np.flatnonzero(self.buf == 10)
        self.l_start = np.concatenate([[0], self.l_end[:-1] + 1])
        self.l_doc = np.searchsorted(self.doc_start, self.l_start, "right") - 1

    @functools.cached_property
    def _words(self) -> tuple[np.ndarray, list[bytes]]:
        return numbered(self.raw.split())

    @property
    def w_id(self) -> np.ndarray:
        """Equal for equal words of the chunk only."""
        return self._words[0]

    @property
    def vocabulary(self) -> list[bytes]:
        """The words by their w_id."""
        return self._words[1]

    def per_doc(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each document are in mask."""
        return np.add.reduceat(mask.astype(np.int64), self.doc_start)

    def per_line(self, mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[self.l_end] - total[self.l_start]

    @functools.cached_property
    def code_points(self) -> np.ndarray:
        """Marks the first byte of each code point inside a word."""
        return self.solid & ((self.buf & 0xC0) != 0x80)

    @functools.cached_property
    def repeated_words(self) -> np.ndarray:
        """Words in 3-word windows that their text has twice or more."""
        w, d = self.w_id, self.w_doc
        out = np.zeros(len(w), bool)
        if len(w) < 3:
            return out
        at = np.flatnonzero(d[2:] == d[:-2])
        _, inverse, counts = np.unique(rows_numbered(d[at], w[at], w[at + 1], w[at + 2]), return_inverse=True, return_counts=True)
        twice = at[counts[inverse] > 1]
        for k in range(3):
            out[twice + k] = True
        return out

    @functools.cached_property
    def duplicate_lines(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their text."""
        lines, _ = numbered(self.raw.split(b"\n")[:-1])
        return again(rows_numbered(self.l_doc, lines)) & (self.per_line(self.solid) > 0)

    def count_words(self, mask: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(self.w_doc if mask is None else self.w_doc[mask], minlength=self.n)
