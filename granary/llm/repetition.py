"""Repetition coverage: how much of a text stands inside n-grams and lines that it repeats.

For each of several n the n-grams' rolling hashes are computed in numpy over whole batches of
texts; a word is covered when any window over it occurs twice or more in its document (the first
occurrence counts too). The measure is the share of the words' characters (code points) that are
covered. Repeated lines are measured in the same way, with lines that equal an earlier one.

Defined results: a null text counts as empty; an empty text or one without words has zeros in all
measures and fails the base rule; equal texts have equal results, and repeated rows each have a row;
null ids are kept; a text exactly at a limit stays. A very long text is handled
whole, as a piece of its own. The operator returns only the id and its own columns, so further
input columns, whatever they are called, don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import encoded, pieces
from granary.llm.textscan import Scan, repeated, seen_before

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class RepetitionRules:
    """Limits as per cent of the words' characters; a text that exceeds any of them is rejected.

    The limits of the n-grams and lines are measured, by measured_limits on any documents with labels:
    of texts that are labelled good and pass the base rule, the share that 99.5 % don't exceed,
    rounded up. On 16,906 such texts that was 19.7 for n = 5 to 8, 19.5 and 19.3 for n = 9 and 10, and
    9.8 for lines.
    """

    min_words: int = 50
    max_repeat_words_percent: int = 50
    ngram_percent: tuple[tuple[int, int], ...] = ((5, 20), (6, 20), (7, 20), (8, 20), (9, 20), (10, 20))
    line_percent: int = 10


def measure(texts: list[bytes], lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts for each text, of which cover_n are the characters inside repeated n-grams."""
    scan = Scan(texts)
    out = {"n_words": scan.n_words.astype(np.int64), "word_chars": scan.per_doc(scan.chars), "n_symbols": scan.count(_SYMBOLS)}
    low, high, doc, key = scan.lines
    later = seen_before(key, doc)
    out["n_dup_lines"] = np.bincount(doc[later], minlength=scan.n_docs).astype(np.int64)
    sums = np.concatenate([[0], np.cumsum(scan.chars, dtype=np.int64)])
    line_chars = np.zeros(scan.n_docs, np.int64)
    np.add.at(line_chars, doc[later], (sums[high] - sums[low])[later])
    out["dup_line_chars"] = line_chars
    for n in (3, *lengths):
        first, key = scan.ngrams(n)
        both = repeated(key, scan.doc[first])
        step = np.zeros(len(scan.words) + 1, np.int64)
        np.add.at(step, first[both], 1)
        np.add.at(step, first[both] + n, -1)
        covered = np.cumsum(step[:-1]) > 0
        if n == 3:
            out["n_repeat_words"] = scan.per_doc(covered)
        if n in lengths:
            out[f"cover_{n}"] = scan.per_doc(scan.chars * covered)
    return out


def repetition_coverage(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """One row for each row of df: the id, the counts, base_failed, kept.

    kept is false if the base rule fails (too few words, or too many of them in repeated 3-word
    windows), else whether every n-gram length and the lines stay within the limits.
    """
    lengths = tuple(n for n, _ in rules.ngram_percent)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"cover_{n}" for n in lengths)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            got = measure(encoded(piece.column("text")), lengths)
            yield pa.RecordBatch.from_arrays([piece.column("id"), *(pa.array(got[c], pa.int64()) for c in counts)], names=["id", *counts])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    measured = source.mapInArrow(run, f"id {kind}, " + ", ".join(f"{c} long" for c in counts))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_words_percent * F.col("n_words"))
    bad = 100 * F.col("dup_line_chars") > rules.line_percent * F.col("word_chars")
    for n, percent in rules.ngram_percent:
        bad = bad | (100 * F.col(f"cover_{n}") > percent * F.col("word_chars"))
    return measured.select(F.col("id").alias(id_col), *counts[:5], failed.alias("base_failed"), (~failed & ~bad).alias("kept"), *counts[5:])


def measured_limits(docs: DataFrame, labels: DataFrame, share: float = 0.995, id_col: str = "doc_id", text_col: str = "text") -> dict[str, float | None]:
    """By measure, the per cent of characters that this share of the good texts which pass the base rule don't exceed.

    `labels` has the id and quality, 1 for good. One row of numbers comes to the driver. Null where no such text is.
    """
    lengths = [n for n, _ in RepetitionRules().ngram_percent]
    good = labels.where("quality = 1").select(F.col(id_col).alias("__good")).distinct()
    rows = repetition_coverage(docs, id_col=id_col, text_col=text_col).where("NOT base_failed")
    rows = rows.join(good, F.col(id_col) == F.col("__good"), "left_semi")
    names = {**{f"cover_{n}": f"cover_{n}" for n in lengths}, "lines": "dup_line_chars"}
    return rows.agg(*[F.percentile_approx(100 * F.col(c) / F.col("word_chars"), share, 10_000).alias(k) for k, c in names.items()]).first().asDict()
