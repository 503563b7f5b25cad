"""Words of many texts as one byte buffer, and hashes of their character n-grams, without a Python step per word."""

from __future__ import annotations

import re

import numpy as np

_not_letters = re.compile(r"[\W\d_]+").sub


def letters_only(text: str | None) -> str:
    """Lower-cased words of letters with single blanks between; empty if the text is null or has no letter."""
    clean = _not_letters(" ", text.lower()).strip() if text else ""
    if clean and not clean.isascii() and not any(map(str.isalpha, clean)):
        return ""
    return clean


class Buffer:
    """``texts`` (as :func:`letters_only` gives them) as bytes: a blank before and after every word.

    start, end: byte range of each word; words: words of each text, so text k owns the next words[k] of them.
    """

    def __init__(self, texts: list[str]):
        self.bytes = np.frombuffer((" " + "\n".join(texts) + "\n").encode(), np.uint8).copy()
        line = self.bytes == 10
        self.bytes[line] = 32
        self.blank = self.bytes == 32
        self.start = np.flatnonzero(self.blank[:-1] & ~self.blank[1:]) + 1
        self.end = np.flatnonzero(~self.blank[:-1] & self.blank[1:]) + 1
        ends = np.searchsorted(self.start, np.flatnonzero(line))
        self.words = np.diff(ends, prepend=0)

    @classmethod
    def of_raw(cls, texts: list[bytes]) -> Buffer:
        """Words are the stretches without space, tab, line feed, vertical tab, form feed and return; A-Z are lowered."""
        self = cls.__new__(cls)
        self.bytes = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8).copy()
        self.bytes[(self.bytes >= 9) & (self.bytes <= 13)] = 32
        self.bytes[(self.bytes >= 65) & (self.bytes <= 90)] += 32
        self.blank = self.bytes == 32
        self.start = np.flatnonzero(self.blank[:-1] & ~self.blank[1:]) + 1
        self.end = np.flatnonzero(~self.blank[:-1] & self.blank[1:]) + 1
        self.words = np.diff(np.searchsorted(self.start, np.cumsum([len(t) + 1 for t in texts])), prepend=0)
        return self

    def word_hash(self) -> np.ndarray:
        """64 bits of each whole word."""
        value = (self.bytes.astype(np.uint64) + np.uint64(0x9E37)) * np.uint64(0x9E3779B97F4A7C15)
        offset = np.arange(len(value), dtype=np.uint64) - self._first()
        value ^= value >> np.uint64(29)
        value *= (offset * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
        value ^= value >> np.uint64(32)
        value[self.blank] = 0
        return mix(np.add.reduceat(value, self.start)) if len(self.start) else np.zeros(0, np.uint64)

    def distinct(self) -> tuple[Buffer, np.ndarray]:
        """A buffer of the different words, once each, and for every word its number among them."""
        _, found, inverse = np.unique(self.word_hash(), return_index=True, return_inverse=True)
        out = Buffer.__new__(Buffer)
        length = self.end[found] - self.start[found] + 1
        edge = np.cumsum(length) - length
        place = np.repeat(self.start[found] - 1 - edge, length) + np.arange(int(length.sum()))
        out.bytes = np.append(self.bytes[place], np.uint8(32))
        out.blank = out.bytes == 32
        out.start, out.end, out.words = edge + 1, edge + length, np.array([len(found)])
        return out, inverse

    def _first(self) -> np.ndarray:
        """For each byte, where its word (or the last word before it) starts."""
        first = np.zeros(len(self.bytes), np.int64)
        first[self.start] = self.start
        return np.maximum.accumulate(first).astype(np.uint64)

    def grams(self, size: int, slots: int) -> np.ndarray:
        """For each byte position, the slot of the ``size``-gram starting there; slot 0 where that leaves its word.

        A gram may start at the blank before a word (a prefix) and end at the blank after it (a suffix).
        """
        n = len(self.bytes) - size + 1
        if n <= 0:
            return np.zeros(len(self.bytes), np.int64)
        value = np.full(n, size, np.uint64)
        for k in range(size):
            value = (value + self.bytes[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(32)
        inner = ~self.blank[0:n] | ~self.blank[1 : n + 1]
        for k in range(1, size - 1):
            inner &= ~self.blank[k : k + n]
        out = np.zeros(len(self.bytes), np.int64)
        out[:n] = np.where(inner, (value % np.uint64(slots - 1)).astype(np.int64) + 1, 0)
        return out

    def per_word(self, values: np.ndarray) -> np.ndarray:
        """Sum over the positions of each word, its leading blank included; values: a row for each byte."""
        return np.add.reduceat(values, self.start - 1, axis=0) if len(self.start) else np.zeros((0, *values.shape[1:]), values.dtype)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
