"""Periodic runs of words by the tandem-repeat method of Gusfield and Stoye.

A run is a stretch of consecutive words with smallest period q, at least `least` words long and at
least `exponent` periods, that no neighbouring word extends. A text's runs are found in these steps, for
many texts at once and in numpy:

1. Each word of a run stands in a window that occurs `exponent` times or more in its text (windows of
   8 words for runs of 24 words and three periods). Rolling hashes tell these windows; the stretches
   of words that they cover are the segments to search. This is exact: no run leaves its segment.
2. Segments get words of their own and an end mark each, and are put one behind the other. Ranks of
   all factors of 1, 2, 4, ... words, by doubling, give the suffix array and, in logarithmic time,
   how far any two places agree to the right and to the left. The suffix array with the lengths of
   its neighbours' common prefixes stands for the suffix tree: a node is a range of it.
3. Lempel-Ziv blocks: each is the longest factor that begins earlier, too, or a new word. The
   leftmost occurrence of a tandem repeat is inside no block, and it has no two block starts in its
   second half. So it is found where a block ends, with a half no longer than the block, or where a block
   begins, with a half no longer than it and the next one together. What the repeat's stretch covers to
   both sides comes from two common extensions.
4. From a stretch's first repeat, suffix links lead to its rotations one after the other. They are
   the vocabulary: all different repeats of the text, of which those with a primitive half are
   kept. Each one's node in the suffix tree is found by widening the range around its suffix.
5. A node's leaves are all places of its repeat. Those that continue no repeat from one word before
   begin a run; extending them gives its end.

Defined results: null text counts as empty; a text without words has no runs and an empty collapsed
text. Repeated rows are rows of their own. Very long texts are taken whole, in time and memory in
proportion to their words times a logarithm. Only id and text are read, so further columns can't
clash; an empty table gives an empty result. Runs are sorted by start, then by period.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import encoded, mix64, pieces

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd


@dataclass(frozen=True)
class RunSettings:
    least: int = 24  # words
    exponent: int = 3  # periods

    @property
    def window(self) -> int:
        """Words that a run has at least beyond its last exponent - 1 periods."""
        short = self.least // self.exponent
        return min(self.least - (self.exponent - 1) * short, short + 1)


def _inverse(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int32)


class Suffixes:
    """Suffix array, common prefixes and common extensions of numbers of which the last occurs once."""

    def __init__(self, x: np.ndarray):
        self.n, self.ranks = len(x), [_inverse(x)]
        while int(self.ranks[-1].max()) < self.n - 1:
            last, step = self.ranks[-1].astype(np.int64), 1 << len(self.ranks) - 1
            behind = np.zeros(self.n, np.int64)
            behind[: self.n - step] = last[step:] + 1
            self.ranks.append(_inverse(last * (self.n + 1) + behind))
        self.rank = self.ranks[-1]
        self.array = np.empty(self.n, np.int32)
        self.array[self.rank] = np.arange(self.n, dtype=np.int32)
        self.common = np.zeros(self.n, np.int32)
        self.common[1:] = self.ahead(self.array[:-1], self.array[1:])
        self._least = [self.common]  # over 1, 2, 4, ... neighbours from each place on

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from different places i and j on."""
        i, j = i.astype(np.int64), j.astype(np.int64)
        begin = i.copy()
        for k in range(len(self.ranks) - 2, -1, -1):
            same = np.where(self.ranks[k][i] == self.ranks[k][j], 1 << k, 0)
            i += same
            j += same
        return i - begin

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree up to different places i and j, these included; places may be -1."""
        i, j = i.astype(np.int64), j.astype(np.int64)
        begin = i.copy()
        for k in range(len(self.ranks) - 2, -1, -1):
            a, b = i - (1 << k) + 1, j - (1 << k) + 1
            inside = (a >= 0) & (b >= 0)
            same = np.where(inside & (self.ranks[k][np.where(inside, a, 0)] == self.ranks[k][np.where(inside, b, 0)]), 1 << k, 0)
            i -= same
            j -= same
        return begin - i

    def _least_of(self, k: int) -> np.ndarray:
        while len(self._least) <= k:
            last, step = self._least[-1], 1 << len(self._least) - 1
            self._least.append(np.minimum(last[:-step], last[step:]) if len(last) > step else np.zeros(0, np.int32))
        return self._least[k]

    def node(self, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges [low, high) of suffixes that begin with the `length` words from each place."""
        low = self.rank[place].astype(np.int64)
        high = low + 1
        for k in range(self.n.bit_length() - 1, -1, -1):
            least = self._least_of(k)
            if not len(least):
                continue
            at = low - (1 << k) + 1
            low -= np.where((at >= 1) & (least[np.clip(at, 0, len(least) - 1)] >= length), 1 << k, 0)
            fits = high + (1 << k) <= self.n
            high += np.where(fits & (least[np.where(fits, high, 0)] >= length), 1 << k, 0)
        return low, high

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks, and the end."""
        before, after = list(range(-1, self.n - 1)), list(range(1, self.n + 1))  # in the suffix array, of the places not later
        left, right = [0] * self.n, [0] * self.n
        rank = self.rank.tolist()
        for place in range(self.n - 1, -1, -1):
            r = rank[place]
            a, b = before[r], after[r]
            left[place], right[place] = a, b
            if a >= 0:
                after[a] = b
            if b < self.n:
                before[b] = a
        longest = np.zeros(self.n, np.int64)
        for near in (np.array(left), np.array(right)):
            some = np.flatnonzero((near >= 0) & (near < self.n))
            longest[some] = np.maximum(longest[some], self.ahead(some, self.array[near[some]]))
        step, out, at = np.maximum(longest, 1).tolist(), [], 0
        while at < self.n:
            out.append(at)
            at += step[at]
        return np.array([*out, self.n], np.int64)


def _counted(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of `first` n times, and the numbers from 0 for each."""
    return np.repeat(first, n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def covering_stretches(x: np.ndarray, s: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of stretches of tandem repeats with a primitive half: of each repeat at least the leftmost occurrence."""
    starts = s.blocks()
    size = np.diff(starts)
    found = []
    # where a block ends: halves up to its length
    at, k = _counted(starts[1:-1], size[:-1])
    k = k + 1
    same = x[at] == x[at - k]
    at, k = at[same], k[same]
    found.append((at - k - s.behind(at - 1, at - k - 1), at + s.ahead(at, at - k), k))
    # where a block begins: halves up to its and the next one's length together
    both = size.copy()
    both[:-1] += size[1:]
    at, k = _counted(starts[1:-1], both[1:])
    k = k + 1
    inside = at + k < s.n
    at, k = at[inside], k[inside]
    same = (x[at] == x[at + k]) & (x[at - 1] == x[at + k - 1])
    at, k = at[same], k[same]
    found.append((at - s.behind(at - 1, at + k - 1), at + k + s.ahead(at, at + k), k))
    start, end, period = (np.concatenate(c) for c in zip(*found, strict=True))
    whole = end - start >= 2 * period
    start, end, period = start[whole], end[whole], period[whole]
    # a stretch whose halves aren't primitive is found with its least period, too, at the same place
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def runs_of(x: np.ndarray, settings: RunSettings = RunSettings()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of the numbers, of which the last occurs once; by start and period."""
    s = Suffixes(x)
    start, end, period = covering_stretches(x, s)
    place, turn = _counted(start, np.minimum(period, end - start - 2 * period + 1))
    place, half = place + turn, np.repeat(period, np.minimum(period, end - start - 2 * period + 1))
    low, high = s.node(place, 2 * half)
    _, once = np.unique(low * (s.n + 1) + half, return_index=True)
    low, high, half = low[once], high[once], half[once]
    leaf, turn = _counted(low, high - low)
    begin, period = s.array[leaf + turn].astype(np.int64), np.repeat(half, high - low)
    first = (begin == 0) | (x[begin - 1] != x[begin + period - 1])
    begin, period = begin[first], period[first]
    length = period + s.ahead(begin, begin + period)
    long = length >= np.maximum(settings.least, settings.exponent * period)
    begin, length, period = begin[long], length[long], period[long]
    order = np.lexsort((period, begin))
    return begin[order], length[order], period[order]


def segments(codes: np.ndarray, doc: np.ndarray, settings: RunSettings = RunSettings()) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that can hold runs, of word numbers with the text each belongs to."""
    width, none = settings.window, np.zeros(0, np.int64)
    if len(codes) < settings.least:
        return none, none
    value, n = mix64(codes.astype(np.uint64) + _BASE), len(codes) - width + 1
    key = np.zeros(n, np.uint64)
    for k in range(width):
        key = key * _BASE + value[k : k + n]
    at = np.flatnonzero(doc[:n] == doc[width - 1 :])
    key = mix64(key[at] ^ mix64(doc[at].astype(np.uint64) + _BASE))
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key)))
    often = at[order[np.repeat(count >= settings.exponent, count)]]
    step = np.zeros(len(codes) + 1, np.int64)
    np.add.at(step, often, 1)
    np.add.at(step, often + width, -1)
    covered = np.concatenate([[False], np.cumsum(step[:-1]) > 0, [False]])
    change = covered[1:] != covered[:-1]
    change[1 : len(codes)] |= covered[1:-2] & (doc[1:] != doc[:-1])  # two texts that touch
    edges = np.flatnonzero(change)
    start, end = edges[:-1], edges[1:]
    some = covered[start + 1] & (end - start >= settings.least)
    return start[some], end[some]


def find_runs(texts: list[list[bytes]], settings: RunSettings = RunSettings()) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of each text's runs; texts are lists of words."""
    index: dict[bytes, int] = {}
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.fromiter((index.setdefault(w, len(index)) for words in texts for w in words), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    start, end = segments(codes, doc, settings)
    if not len(start):
        return out
    length = end - start
    # each segment's words are its own; an end mark follows them
    own, turn = _counted(np.arange(len(start)), length + 1)
    mark = turn == length[own]
    at = np.where(mark, 0, start[own] + turn)
    x = np.where(mark, own, len(start) + own * len(index) + codes[at])
    first_of = np.cumsum(sizes) - sizes
    for b, n, q in zip(*(c.tolist() for c in runs_of(x, settings)), strict=True):
        d = int(doc[at[b]])
        out[d].append((int(at[b] - first_of[d]), n, q))
    return [sorted(r, key=lambda run: (run[0], run[2])) for r in out]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, without those that stand in a run after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(step[:-1]) == 0)
    return b" ".join([words[k] for k in kept.tolist()])


def periodic_runs(df: DataFrame, rewrite: Callable[[str, list[bytes]], list[bytes]] | None = None, id_col: str = "doc_id", text_col: str = "text", settings: RunSettings = RunSettings()) -> DataFrame:
    """One row for each row of df: id, runs (start, length, period), collapsed (the text without the runs' repeats).

    `rewrite` gets an id that isn't null, as text, and a text's words, and returns the words to search.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for piece in pieces(batches, "text"):
            texts = [t.split() for t in encoded(piece.column("text"))]  # bytes are split at ASCII white space
            if rewrite is not None:
                texts = [words if name is None else rewrite(name, words) for name, words in zip(piece.column("name").to_pylist(), texts, strict=True)]
            found = find_runs(texts, settings)
            rows = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in found], kind)
            yield pa.RecordBatch.from_arrays([piece.column("id"), rows, pa.array(map(collapsed, texts, found), pa.binary())], names=["id", "runs", "collapsed"])

    source = df.select(F.col(id_col).alias("id"), F.col(id_col).cast("string").alias("name"), F.col(text_col).alias("text"))
    rows = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return rows.select(F.col("id").alias(id_col), "runs", F.col("collapsed").cast("string").alias("collapsed"))
