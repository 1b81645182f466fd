"""Spelling variants of words, found by bands of letter-parity masks.

Words are counted over all texts, each task's counts first. A word's mask has a bit for each letter,
set if the word holds the letter an odd number of times. One inserted or deleted letter flips one
bit and one replaced letter two, so two words that are one edit apart differ in at most two bits of
their masks, and of three bands of a mask at least one is equal in both.

1. Each word goes into the buckets of its three bands, by length: a bucket holds the words of one
   band value that have l or l + 1 letters, so that a pair meets once in each band it has in common.
   Buckets above a bound are cut into blocks by the words' hashes, and each block meets each.
2. In a bucket words meet whose other two bands can differ in one or two bits together: one of them
   is equal, or both differ in one bit. The rest of their masks is compared by exclusive or and a
   count of bits; what is left is verified letter by letter. A pair counts in its first equal band
   only. A task returns for each word the number of its near words and the most frequent one, no pairs.
3. A word's form is its most frequent near word, if that is frequent enough; forms are followed to
   the last by pointer doubling. Counts grow along the way, so there are no cycles and few rounds.

Defined results: null and empty texts have no words; a null id is an empty one where ids matter.
Repeated rows count again. Very long texts are taken whole, a piece at a time, and very long words
as any other. Of near words with equal counts the least in code-point order is the form. Only id and
text are read, so further columns can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import checkpointed

#: Letters: a to z and U+00C0 to U+00FF, A to Z being lower-cased.
_LETTERS = "A-Za-zÀ-ÿ"
#: Code points of a text that are searched at a time.
_PIECE = 1 << 20
#: Distinct words that a task counts before it hands them on.
_HELD = 200_000
#: Pairs of masks that are compared at a time.
_COMPARED = 1 << 18
#: Letters of pairs that are verified at a time.
_CHUNK = 1 << 20


@dataclass(frozen=True)
class SpellingSettings:
    least: int = 7  # code points of a word
    occurrences: int = 2  # of a word, at least
    ratio: int = 10  # of a form's count to its word's
    block: int = 1 << 15  # words of a bucket's block
    letters: int = 1 << 21  # of a block
    task: int = 1 << 20  # letters of a task


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that end between words."""
    if len(text) <= _PIECE:
        yield text
        return
    gap, at = re.compile(f"[^{_LETTERS}]"), 0
    while at < len(text):
        cut = gap.search(text, at + _PIECE)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end


def word_counts(df: DataFrame, rewrite: Callable[[str, str], str] | None = None, id_col: str = "doc_id", text_col: str = "text", settings: SpellingSettings = SpellingSettings()) -> DataFrame:
    """(word, n) of the words that are long and frequent enough.

    `rewrite` gets an id as text and a lower-cased run of letters, and returns the run to count; it may shorten runs only.
    """
    least = settings.least

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, held = re.compile(f"[{_LETTERS}]{{{least},}}"), Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = Counter()
                for piece in _pieces(text):
                    own.update(run.findall(piece.encode().lower().decode()))  # bytes.lower() changes A to Z only
                for word, n in own.items():
                    if rewrite is not None:
                        word = rewrite(id_, word)
                    if len(word) >= least:
                        held[word] += n
                if len(held) > _HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    texts = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= settings.occurrences)


def letter_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All words' letters as numbers from 0 to 89, and each word's length."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    return np.where(points < 123, points - 97, 26 + (points - 0xC0) % 64).astype(np.uint8), np.fromiter(map(len, words), np.int64, len(words))


def masks(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(words, 3): the three bands of each mask. Letters are dealt to the bands in turn, so each has common ones."""
    starts = np.cumsum(lengths) - lengths
    bit = np.left_shift(np.int64(1), codes.astype(np.int64) // 3)
    bands = [np.bitwise_xor.reduceat(np.where(codes % 3 == band, bit, 0), starts) if len(lengths) else np.zeros(0, np.int64) for band in range(3)]
    return np.stack(bands, axis=1)


def _one_edit(codes: np.ndarray, start: np.ndarray, a: np.ndarray, b: np.ndarray, length: int, longer: int) -> np.ndarray:
    """Whether words a of `length` letters and b of `length + longer` are one edit apart."""
    out, step = np.zeros(len(a), bool), max(1, _CHUNK // max(1, length))
    at = np.arange(length)
    for k in range(0, len(a), step):
        left = codes[start[a[k : k + step], None] + at]
        first = start[b[k : k + step], None]
        ahead = left == codes[first + at]
        if longer:
            # equal to the left of some place, and one letter further on from there
            prefix = np.where(ahead.all(axis=1), length, ahead.argmin(axis=1))
            behind = (left == codes[first + at + 1])[:, ::-1]
            suffix = np.where(behind.all(axis=1), length, behind.argmin(axis=1))
            out[k : k + step] = prefix + suffix >= length
        else:
            out[k : k + step] = (~ahead).sum(axis=1) == 1
    return out


def _crossed(low_a: np.ndarray, n_a: np.ndarray, low_b: np.ndarray, n_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a place in a range and one in its partner range, in pieces of bounded size."""
    some = (n_a > 0) & (n_b > 0)
    low_a, n_a, low_b, n_b = low_a[some], n_a[some], low_b[some], n_b[some]
    step = np.maximum(1, _COMPARED // np.maximum(n_b, 1))  # of places of a range at a time
    parts = -(-n_a // step)
    which = np.repeat(np.arange(len(n_a)), parts)
    turn = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    low_a, low_b, n_b = low_a[which] + turn * step[which], low_b[which], n_b[which]
    n_a = np.minimum(step[which], n_a[which] - turn * step[which])
    ends = np.cumsum(n_a * n_b)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _COMPARED, "right")))
        size = n_a[at:stop] * n_b[at:stop]
        width = np.repeat(n_b[at:stop], size)
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        yield np.repeat(low_a[at:stop], size) + place // width, np.repeat(low_b[at:stop], size) + place % width
        at = stop


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of the keys, and the different ones with their start and number in that order."""
    order = np.argsort(key, kind="stable")
    value, start, count = np.unique(key[order], return_index=True, return_counts=True)
    return order, value, start, count


def near_masks(bucket: np.ndarray, band: np.ndarray, long: np.ndarray, bands: np.ndarray, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one bucket whose masks differ as by one edit: in one bit, the second row being the longer one, or, of
    rows that aren't long, in two. Each pair comes in its first equal band only; with sides, only pairs across them.

    The differing bits are in one of the two other bands, so the third one is equal, too, and rows
    meet by both; or there is one in each, so rows meet by a neighbouring value of the first of them.
    """
    first, second = np.where(band == 0, bands[:, 1], bands[:, 0]), np.where(band == 2, bands[:, 1], bands[:, 2])
    short = np.flatnonzero(~long)

    def met(a: np.ndarray, b: np.ndarray, open_: np.ndarray, bits: int, once: bool) -> tuple[np.ndarray, np.ndarray]:
        fits = np.bitwise_count(open_[a] ^ open_[b]) == bits
        if once:
            fits &= a < b
        if side is not None:
            fits &= side[a] != side[b]
        return a[fits], b[fits]

    for equal, open_, bands_here in ((first, second, band == 0), (second, first, band < 2)):
        key = (bucket << 30) | equal
        shorts, longs = short[bands_here[short]], np.flatnonzero(long & bands_here)
        order, value, start, count = _groups(key[shorts])
        shorts = shorts[order]
        for i, j in _crossed(start, count, start, count):
            yield met(shorts[i], shorts[j], open_, 2, True)
        order = np.argsort(key[longs], kind="stable")
        longs = longs[order]
        low, high = (np.searchsorted(key[longs], value, how) for how in ("left", "right"))
        for i, j in _crossed(start, count, low, high - low):
            yield met(shorts[i], longs[j], open_, 1, False)
    order, value, start, count = _groups((bucket[short] << 30) | first[short])
    short = short[order]
    used = int(np.bitwise_or.reduce(first[short])) if len(short) else 0
    for bit in range(30):
        if used >> bit & 1:
            without = np.flatnonzero(value & (1 << bit) == 0)
            at = np.minimum(np.searchsorted(value, value[without] | (1 << bit)), len(value) - 1)
            there = value[at] == value[without] | (1 << bit)
            a, b = without[there], at[there]
            for i, j in _crossed(start[a], count[a], start[b], count[b]):
                yield met(short[i], short[j], second, 1, False)


_ROWS = "word string, n long, letters long, band int, value long, length long"


def _banded(words: DataFrame) -> DataFrame:
    """One row for each word, band and bucket length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, lengths = letter_codes(batch.column("word").to_pylist())
            bands = masks(codes, lengths)
            for band in range(3):
                for less in (0, 1) if band < 2 else (0,):  # a letter more leaves two bands equal
                    columns = [pa.array(x) for x in (lengths, np.full(len(lengths), band, np.int32), bands[:, band], lengths - less)]
                    yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), *columns], names=["word", "n", "letters", "band", "value", "length"])

    return words.select("word", "n").mapInArrow(run, _ROWS)


def near_words(words: DataFrame, settings: SpellingSettings = SpellingSettings()) -> DataFrame:
    """(word, n_near, near_n, near): of the words (word, n) with any word one edit away, how many those are, and the most frequent one."""
    rows, key = _banded(words), ["band", "value", "length"]
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("held"), F.sum("letters").alias("in_all"))
    blocks = F.ceil(F.greatest(F.col("held") / settings.block, F.col("in_all") / settings.letters)).alias("blocks")
    counts = checkpointed(counts.select(*key, "held", "in_all", blocks))
    total = counts.agg(F.coalesce(F.sum("in_all"), F.lit(0))).first()[0]
    tasks = max(1, -(-total // settings.task))
    large = counts.where("blocks > 1").select(*[F.col(c).alias(f"large_{c}") for c in key], "blocks")
    if large.isEmpty():
        rows = rows.withColumns({"own": F.lit(0).cast("long"), "i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")})
    else:
        same = (F.col("band") == F.col("large_band")) & (F.col("value") == F.col("large_value")) & (F.col("length") == F.col("large_length"))
        rows = rows.join(large, same, "left").withColumn("own", F.pmod(F.xxhash64("word"), F.coalesce("blocks", F.lit(1))))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1)) - 1)))
        rows = rows.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    rows = rows.select(F.pmod(F.xxhash64(*key, "i", "j"), F.lit(tasks)).alias("task"), *key, "i", "j", "own", "word", "n")

    def compare(group: pa.Table) -> pa.Table:
        band, value, length, i, j, own, n = (group[c].to_numpy() for c in (*key, "i", "j", "own", "n"))
        words = group["word"].to_pylist()
        codes, lengths = letter_codes(words)
        bands, start = masks(codes, lengths), np.cumsum(lengths) - lengths
        order = np.lexsort((j, i, length, value, band))
        new = np.zeros(len(order), bool)
        for c in (band, value, length, i, j):
            new[1:] |= c[order[1:]] != c[order[:-1]]
        bucket = np.empty(len(order), np.int64)
        bucket[order] = np.cumsum(new)
        # of a block against another one only words of different blocks meet; in a block of its own all do
        side = np.where(i == j, np.arange(len(own)), own) if (i != j).any() else None
        left, right = [], []
        for a, b in near_masks(bucket, band, lengths > length, bands, side):
            longer = lengths[b] - lengths[a]
            for size in np.unique(lengths[a]).tolist():
                for more in (0, 1):
                    some = np.flatnonzero((lengths[a] == size) & (longer == more))
                    near = some[_one_edit(codes, start, a[some], b[some], size, more)]
                    left.append(a[near])
                    right.append(b[near])
        a, b = (np.concatenate([*x, *y]) if x else np.zeros(0, np.int64) for x, y in ((left, right), (right, left)))
        hit, place = np.unique(a, return_inverse=True)
        by_count = sorted(set(b.tolist()), key=lambda k: (-n[k], words[k]))  # strings compare by code point
        rank = np.zeros(len(words), np.int64)
        rank[by_count] = np.arange(len(by_count))
        best = np.full(len(hit), len(by_count), np.int64)
        np.minimum.at(best, place, rank[b])
        best = np.array(by_count, np.int64)[best] if len(hit) else best
        return pa.table({
            "word": pa.array([words[k] for k in hit.tolist()], pa.string()), "n_near": pa.array(np.bincount(place, minlength=len(hit)), pa.int64()),
            "near_n": pa.array(n[best], pa.int64()), "near": pa.array([words[k] for k in best.tolist()], pa.string()),
        })

    found = rows.groupBy("task").applyInArrow(compare, "word string, n_near long, near_n long, near string")
    least = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), least).select("word", "n_near", (-F.col("best.less")).alias("near_n"), "best.near")


def spelling_variants(words: DataFrame, settings: SpellingSettings = SpellingSettings()) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for each of the words (word, n), which differ."""
    words = checkpointed(words.select("word", "n"))
    near = near_words(words, settings)
    known = words.select(F.col("word").alias("own"), "n").join(near, F.col("own") == F.col("word"), "left")
    formed = F.col("near_n") >= settings.ratio * F.col("n")
    known = checkpointed(known.select(F.col("own").alias("word"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(formed, F.col("near")).alias("form"), F.when(formed, F.col("near_n")).alias("form_n")))
    roots, moved = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), True
    while moved:
        ahead = roots.select(F.col("word").alias("at"), F.col("root").alias("further"))
        roots = roots.join(ahead, F.col("root") == F.col("at"), "left")
        roots = checkpointed(roots.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        moved = not roots.where("moved").isEmpty()
    roots = roots.select(F.col("word").alias("at"), "root")
    return known.join(roots, F.col("word") == F.col("at"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
