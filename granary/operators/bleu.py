"""BLEU of pairs of texts: clipped n-gram matches and a brevity penalty, on sums over the corpus or over groups."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDERS = 4


def ngram_matches(candidate: list[str], reference: list[str], orders: int = ORDERS) -> list[tuple[int, int]]:
    """For each order, how many n-grams of the candidate are in the reference (each as often as it is there at most), and how many it has."""
    out = []
    for n in range(1, orders + 1):
        ours, theirs = (Counter(zip(*(words[k:] for k in range(n)), strict=False)) for words in (candidate, reference))
        out.append((sum((ours & theirs).values()), sum(ours.values())))
    return out


def pair_counts(df: DataFrame, candidate: str, reference: str, *keys: str, orders: int = ORDERS) -> DataFrame:
    """(keys, matches, totals, candidate_words, reference_words) of each row: what BLEU sums up.

    Words are what stands between blanks and other white space. A row's n-grams are counted where the row is, so none is
    shuffled. A null text has no words; a row with two null texts counts as a pair of empty ones.
    """
    source = df.select(*[F.col(f"`{k}`") for k in keys], F.col(candidate).alias("__candidate"), F.col(reference).alias("__reference"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ours, theirs = ([(t or "").split() for t in batch.column(c).to_pylist()] for c in ("__candidate", "__reference"))
            counts = [ngram_matches(a, b, orders) for a, b in zip(ours, theirs, strict=True)]
            columns = [pa.array([[c[k] for c in row] for row in counts], pa.list_(pa.int64())) for k in (0, 1)]
            sizes = [pa.array(list(map(len, x)), pa.int64()) for x in (ours, theirs)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *columns, *sizes], names=[*keys, "matches", "totals", "candidate_words", "reference_words"])

    kinds = "".join(f"`{k}` {source.schema[k].dataType.simpleString()}, " for k in keys)
    return source.mapInArrow(run, kinds + "matches array<long>, totals array<long>, candidate_words long, reference_words long")


def bleu(df: DataFrame, candidate: str, reference: str, *keys: str, orders: int = ORDERS) -> DataFrame:
    """(keys, n_pairs, candidate_words, reference_words, matches_n and totals_n for each order, bleu) of each group, or of all rows.

    The score is the geometric mean of the orders' shares of matching n-grams, times exp(1 - r / c) if
    the candidates' c words are fewer than the references' r; it is 0 if any order has no match, and
    null without candidate words. Scores of groups can't be averaged, but their sums can be summed.
    """
    counts = pair_counts(df, candidate, reference, *keys, orders=orders)
    sums = [F.sum(F.col(c)[k]).alias(f"{c}_{k + 1}") for c in ("matches", "totals") for k in range(orders)]
    out = counts.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum("candidate_words").alias("candidate_words"), F.sum("reference_words").alias("reference_words"), *sums)
    return out.withColumn("bleu", bleu_of(orders))


def bleu_of(orders: int = ORDERS) -> Column:
    """The score from the sums' columns."""
    matched = [F.col(f"matches_{k}") for k in range(1, orders + 1)]
    share = sum((F.log(m / F.col(f"totals_{k + 1}")) for k, m in enumerate(matched)), F.lit(0.0)) / orders
    brevity = F.when(F.col("candidate_words") < F.col("reference_words"), 1 - F.col("reference_words") / F.col("candidate_words")).otherwise(0.0)
    return F.when(F.coalesce(F.col("candidate_words"), F.lit(0)) == 0, None).when(F.least(*matched) == 0, 0.0).otherwise(F.exp(share + brevity))
