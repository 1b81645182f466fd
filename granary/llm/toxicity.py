"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased and split into words at ASCII characters that are neither letters nor digits
and at white space. Each distinct word of a text gives its character n-grams (with marks for a
gram at the word's start or end), hashed into a fixed number of features; a feature counts the
text's distinct words that hold the gram. The log ratio of a feature's smoothed shares among toxic
and other training texts scales it, and logistic regression with an L2 penalty is trained on the
scaled features. As the model is linear, scoring adds up table entries over a text's grams, in
numpy, for a whole batch of texts. A text is scored in windows of `window` words and has the score
of its most toxic window, so a few toxic words weigh as much in a very long text as in a short one.

The fit takes at most `max_rows_per_class` labelled texts of each class, those with the smallest
hashes of their ids, both classes weighing the same. Workers turn them into distinct features with
counts; these are summed by class in Spark, and the `max_features` features whose counts depart most
from an even spread (by the log-likelihood ratio) stay. Only those reach the driver, three bytes for
each that a text holds, so what it gets is bounded by rows and features and not by the texts'
lengths. Scoring covers every row.

Defined results: null text counts as empty; an empty text gets the score of the intercept. Null
labels and labels of absent documents are passed over; an id labelled twice takes the larger label;
an id that several documents bear is fitted once. Without labels of both classes every score is the
smoothed share of label 1 (0.5 without rows). Equal texts get equal scores. A very long text is a
piece of its own. Only id and text are read, so further columns can't clash; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import checkpointed, mix64, pieces

_PRIME = np.uint64(0x100000001B3)
#: Texts turned into arrays of four bytes a character at a time.
_PIECE = 1 << 19


@dataclass(frozen=True)
class ToxicitySettings:
    max_rows_per_class: int = 2_000
    grams: tuple[int, ...] = (3, 4, 5)
    bits: int = 18
    max_features: int = 32_768
    smoothing: float = 1.0
    penalty: float = 30.0
    steps: int = 60
    window: int = 300


def _separators() -> np.ndarray:
    out = np.zeros(0x3001, bool)
    out[:128] = [not chr(c).isalnum() for c in range(128)]
    out[[c for c in range(128, 0x3001) if chr(c).isspace()]] = True
    return out


_SEPARATOR = _separators()


def gram_features(texts: list[str], settings: ToxicitySettings, window: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, window number and hashed feature of each gram of each distinct word of each window.

    Window numbers ascend over all texts; without a window each text is one.
    """
    codes = np.frombuffer(("\n".join([*texts, ""]).lower() if texts else "\n").encode("utf-32-le", "replace"), "<u4")
    word = ~_SEPARATOR[np.minimum(codes, 0x2FFF)]
    line = np.cumsum(np.array([len(t.lower()) for t in texts], np.int64) + 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], word.astype(np.int8), [0]])))
    start, end = edge[::2], edge[1::2]
    doc = np.searchsorted(line, start, "right")
    unit = doc
    if window and len(doc):
        place = np.arange(len(doc)) - np.searchsorted(doc, doc)
        unit = np.cumsum(np.concatenate([[False], (place[1:] % window == 0)]))
    # a word's hash: its characters' values by place, summed; only the first of equal words in a window stays
    size = end - start
    at = np.arange(len(codes)) - np.repeat(start, size)[np.cumsum(word) - 1] if len(start) else np.zeros(len(codes), np.int64)
    value = mix64(codes.astype(np.uint64) + (at.astype(np.uint64) << np.uint64(32)))
    value[~word] = 0
    sums = np.concatenate([[np.uint64(0)], np.cumsum(value)])
    key = mix64(sums[end] - sums[start] + (unit.astype(np.uint64) << np.uint64(20)) + size.astype(np.uint64))
    first = np.sort(np.unique(key, return_index=True)[1])
    start, end, doc, unit, size = start[first], end[first], doc[first], unit[first], size[first]
    docs, units, grams = [], [], []
    for n in settings.grams:
        count = np.maximum(size - n + 1, np.where(size > 0, 1, 0))  # a shorter word is one gram
        owner = np.repeat(np.arange(len(start)), count)
        if not len(owner):
            continue
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        begin = start[owner] + offset
        stop = np.minimum(begin + n, end[owner])
        h = np.full(len(owner), n, np.uint64)
        for k in range(n):
            inside = begin + k < stop
            h = np.where(inside, h * _PRIME + codes[np.minimum(begin + k, len(codes) - 1)] + np.uint64(1), h)
        h = mix64(h * np.uint64(4) + (offset == 0).astype(np.uint64) + np.uint64(2) * (stop == end[owner]).astype(np.uint64))
        docs.append(doc[owner])
        units.append(unit[owner])
        grams.append((h >> np.uint64(64 - settings.bits)).astype(np.int32))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    return np.concatenate(docs), np.concatenate(units), np.concatenate(grams)


@dataclass
class ToxicityModel:
    intercept: float
    weights: np.ndarray | None
    settings: ToxicitySettings

    def scores(self, texts: list[str]) -> np.ndarray:
        margin = np.full(len(texts), self.intercept)
        if self.weights is not None:
            doc, unit, gram = gram_features(texts, self.settings, self.settings.window)
            if len(doc):
                sums = np.bincount(unit, self.weights[gram])
                owner = np.zeros(len(sums), np.int64)
                owner[unit] = doc
                best = np.full(len(texts), -np.inf)
                np.maximum.at(best, owner, sums)
                margin += np.where(np.isfinite(best), best, 0)
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def log_ratios(clean: np.ndarray, toxic: np.ndarray, sums: tuple[float, float], settings: ToxicitySettings) -> np.ndarray:
    """Log ratio of the smoothed shares of features with these counts, given each class's sum over all features."""
    size = settings.smoothing * (1 << settings.bits)
    return np.log((toxic + settings.smoothing) / (sums[1] + size)) - np.log((clean + settings.smoothing) / (sums[0] + size))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, share: float, ratio: np.ndarray, features: np.ndarray, settings: ToxicitySettings) -> ToxicityModel:
    """rows: for each text places in `features`, and counts. ratio: the features' log ratios. share: of label 1 among all labels."""
    logit = lambda p: float(np.log(p / (1 - p)))
    if not len(y) or y.min() == y.max():
        return ToxicityModel(logit(min(max(share, 0.01), 0.99)), None, settings)
    size = len(features)
    gram = np.concatenate([g for g, _ in rows]).astype(np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(g) for g, _ in rows])
    scaled = (ratio[gram] * np.concatenate([n for _, n in rows])).astype(np.float32)
    sample_weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    w, bias = np.zeros(size), 0.0
    # Adam over all rows at once; the sample is bounded, so is each step
    m, v, mb, vb, rate = np.zeros(size), np.zeros(size), 0.0, 0.0, 0.02
    for t in range(1, settings.steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[gram] * scaled, len(y)) + bias, -30, 30)))
        err = ((p - y) * sample_weight).astype(np.float32)
        g = np.bincount(gram, err[doc] * scaled, size) + settings.penalty / len(y) * w
        gb = float(err.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    weights = np.zeros(1 << settings.bits, np.float32)
    weights[features] = w * ratio
    return ToxicityModel(bias, weights, settings)


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def toxicity_column(model: ToxicityModel, text: Column) -> Column:
    """The score of a text column, as a column: input columns stay as they are."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], names=["text"])
        out = [model.scores(_texts(piece.column(0))) for piece in pieces(iter([batch]), "text", _PIECE)]
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score(text)


def fit_toxicity(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """A model of the labelled documents; `labels` has the ids to learn from and their 0/1 labels."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    n, ones = known.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    by_hash = lambda c: known.where(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(settings.max_rows_per_class)
    sample = by_hash(1.0).unionByName(by_hash(0.0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's distinct features, ascending, as four bytes each, and counts, as one."""
        for piece in pieces(batches, "text", _PIECE):
            doc, _, gram = gram_features(_texts(piece.column("text")), settings)
            key, n = np.unique(doc.astype(np.int64) << settings.bits | gram, return_counts=True)
            cut = np.searchsorted(key, np.arange(piece.num_rows + 1, dtype=np.int64) << settings.bits)
            gram, n = (key & ((1 << settings.bits) - 1)).astype("<u4"), np.minimum(n, 255).astype(np.uint8)
            packed = [pa.array([x[lo:hi].tobytes() for lo, hi in zip(cut, cut[1:], strict=False)], pa.binary()) for x in (gram, n)]
            yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("y"), *packed], names=["id", "y", "grams", "counts"])

    # the sample has at most twice max_rows_per_class rows, so it is broadcast whatever the size of the corpus
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    kind = joined.schema["id"].dataType.simpleString()
    counted = joined.select("id", "y", "text").mapInArrow(count, f"id {kind}, y double, grams binary, counts binary")
    rows = checkpointed(counted.groupBy("id").agg(F.max("y").alias("y"), F.min(F.struct("grams", "counts")).alias("x")).select("id", "y", "x.grams", "x.counts"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << settings.bits), np.int64)
        for batch in batches:
            for y, grams, counts in zip(*(batch.column(c).to_pylist() for c in ("y", "grams", "counts")), strict=True):
                sums[int(y), np.frombuffer(grams, "<u4")] += np.frombuffer(counts, np.uint8)
        held = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (held, sums[0, held], sums[1, held])], names=["gram", "clean", "toxic"])

    totals = rows.mapInArrow(add, "gram long, clean long, toxic long").groupBy("gram").agg(F.sum("clean").cast("double").alias("clean"), F.sum("toxic").cast("double").alias("toxic"))
    totals = checkpointed(totals)
    sums = totals.agg(F.coalesce(F.sum("clean"), F.lit(0.0)), F.coalesce(F.sum("toxic"), F.lit(0.0))).first()
    whole = max(sum(sums), 1.0)
    part = lambda c, total: F.when((F.col(c) > 0) & F.lit(total > 0), F.col(c) * F.log(F.col(c) / ((F.col("clean") + F.col("toxic")) * (max(total, 1.0) / whole)))).otherwise(0.0)
    departure = F.round(part("clean", sums[0]) + part("toxic", sums[1]), 6)
    chosen = totals.orderBy(departure.desc(), "gram").limit(settings.max_features).toArrow()
    chosen = chosen.take(np.argsort(chosen["gram"].to_numpy(), kind="stable")) if chosen.num_rows else chosen
    features = chosen["gram"].to_numpy()
    ratio = log_ratios(chosen["clean"].to_numpy(), chosen["toxic"].to_numpy(), sums, settings)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed: list[list[bytes]] = [[], []]
            for grams, counts in zip(*(batch.column(c).to_pylist() for c in ("grams", "counts")), strict=True):
                gram = np.frombuffer(grams, "<u4").astype(np.int64)
                place = np.searchsorted(features, gram)
                hit = features[np.minimum(place, len(features) - 1)] == gram if len(features) else np.zeros(len(gram), bool)
                packed[0].append(place[hit].astype("<u2" if len(features) <= 1 << 16 else "<u4").tobytes())
                packed[1].append(np.frombuffer(counts, np.uint8)[hit].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), *(pa.array(x, pa.binary()) for x in packed)], names=["id", "y", "places", "counts"])

    got = rows.mapInArrow(select, f"id {kind}, y double, places binary, counts binary").toArrow()
    order = np.argsort(got["id"].to_numpy(), kind="stable") if got.num_rows else np.zeros(0, int)
    width = "<u2" if len(features) <= 1 << 16 else "<u4"
    x = [(np.frombuffer(got["places"][int(i)].as_py(), width), np.frombuffer(got["counts"][int(i)].as_py(), np.uint8)) for i in order]
    return fit(x, got["y"].to_numpy()[order] if got.num_rows else np.zeros(0), (ones + 1) / (n + 2), ratio, features, settings)
