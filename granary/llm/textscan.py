"""Vectorised word, line and n-gram hashes of many texts at once, in numpy.

Texts are joined with line feeds into one byte array. A word is a run of bytes outside
{0x20, 0x09-0x0D}; its hash is a polynomial over its bytes, taken from prefix sums and passed
through a 64-bit finaliser. An n-gram's hash is a second polynomial over the hashes of its words,
rolled in the same way: the difference of two prefix sums, scaled back to position 0. Arithmetic
is modulo 2**64 with odd bases, so scaling back multiplies by the inverse.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np

from granary.llm.common import mix64

_BASE = 0x9E3779B97F4A7C15  # odd
_ROLL = 0xD6E8FEB86659FD93  # odd

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 1 for the first byte of each code point.
_LEAD = (np.arange(256) & 0xC0) != 0x80


def _powers(base: int, n: int, memo: dict = {}) -> np.ndarray:  # noqa: B006 - the memo is meant to be shared
    have = memo.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if n <= 1 << 22:  # longer ones are for single very long texts
            memo[base] = have
    return have[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def _prefix(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


class Scan:
    """Words of `texts` (bytes), in order, with the document each belongs to."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.n_docs = len(texts)
        self.bytes = np.frombuffer(b"\n".join([*texts, b""]) or b"\n", np.uint8)
        if lower:
            self.bytes = _LOWER[self.bytes]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.doc_end = np.cumsum(lengths)
        self.doc_start = self.doc_end - lengths
        inside = np.zeros(len(self.bytes) + 2, bool)
        inside[1:-1] = ~_SPACE[self.bytes]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        #: words before each document, and after the last one
        self.word_at = np.searchsorted(self.start, np.append(self.doc_start, len(self.bytes)))
        self.n_words = np.diff(self.word_at)
        self.doc = np.repeat(np.arange(self.n_docs), self.n_words)

    @cached_property
    def _sums(self) -> np.ndarray:
        return _prefix((self.bytes.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(self.bytes)))

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each byte range; equal ranges have equal hashes wherever they stand."""
        if not len(start):
            return np.zeros(0, np.uint64)
        raw = (self._sums[end] - self._sums[start]) * _powers(_inverse(_BASE), len(self.bytes))[start]
        return mix64(raw + (end - start).astype(np.uint64) * np.uint64(_ROLL))

    @cached_property
    def words(self) -> np.ndarray:
        return self.hashes(self.start, self.end)

    @cached_property
    def _word_sums(self) -> np.ndarray:
        return _prefix(self.words * _powers(_ROLL, len(self.words)))

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window of n words inside one document."""
        first = np.arange(max(0, len(self.words) - n + 1))
        first = first[self.doc[first] == self.doc[first + n - 1]] if len(first) else first
        raw = (self._word_sums[first + n] - self._word_sums[first]) * _powers(_inverse(_ROLL), len(self.words) + 1)[first]
        return first, mix64(raw + np.uint64(n))

    def ngrams_of(self, first: int, n: int) -> np.ndarray:
        """Hash of the n words from `first` on, as ngrams() has it."""
        first = np.array([first])
        raw = (self._word_sums[first + n] - self._word_sums[first]) * _powers(_inverse(_ROLL), len(self.words) + 1)[first]
        return mix64(raw + np.uint64(n))

    @cached_property
    def chars(self) -> np.ndarray:
        """Code points of each word."""
        sums = np.concatenate([[0], np.cumsum(_LEAD[self.bytes], dtype=np.int64)])
        return sums[self.end] - sums[self.start]

    def per_doc(self, word_values: np.ndarray) -> np.ndarray:
        """Sums over each document's words."""
        sums = np.concatenate([[0], np.cumsum(word_values, dtype=np.int64)])
        return sums[self.word_at[1:]] - sums[self.word_at[:-1]]

    def count(self, table: np.ndarray) -> np.ndarray:
        """How many bytes of each document the boolean table of 256 entries marks."""
        sums = np.concatenate([[0], np.cumsum(table[self.bytes], dtype=np.int64)])
        return sums[self.doc_end - 1] - sums[self.doc_start]

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, word after the last, document and hash of each line that has a word."""
        stops = np.flatnonzero(self.bytes == 10)
        begins = np.concatenate([[0], stops[:-1] + 1])
        low, high = np.searchsorted(self.start, begins), np.searchsorted(self.start, stops)
        some = high > low
        low, high = low[some], high[some]
        return low, high, self.doc[low] if len(low) else low, self.hashes(begins[some], stops[some])


def _own(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix64(key + mix64(doc.astype(np.uint64) + np.uint64(1)))


def repeated(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each key: whether its document has it twice or more."""
    out = np.zeros(len(key), bool)
    if len(key):
        own = _own(key, doc)
        order = np.argsort(own)
        own = own[order]
        same = own[1:] == own[:-1]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def seen_before(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each key: whether it stood earlier in its document."""
    out = np.zeros(len(key), bool)
    if len(key):
        own = _own(key, doc)
        order = np.argsort(own, kind="stable")
        out[order[1:][own[order][1:] == own[order][:-1]]] = True
    return out
