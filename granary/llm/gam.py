"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature of a text is cut into quantile bins. Boosting goes round the features in a cycle: for
one feature at a time a shallow tree over its bins is fitted to the logistic loss (Newton step) and
added, damped, to that feature's lookup table. Then the pairs of features that explain most of what
is left get two-way tables, boosted in a cycle in the same way with one cut on each axis. A score
is the logistic of an intercept plus one table entry for each feature and pair: vectorised
additions of binned lookups.

The fit takes at most `max_rows` labelled rows, those with the smallest hashes of their ids, and
runs in numpy on the driver; features of that many rows are all that reaches it. Scoring covers
every row.

Defined results: null text counts as empty; an empty text gets the score of its (zero) features.
Null labels and labels of absent documents are passed over; an id labelled twice takes the larger
label; an id that several documents bear is fitted once. Without any labelled row, or with one
class only, every score is the smoothed share of label 1 (0.5 without rows). Equal texts get equal
scores. Only id and text are read, so further columns can't clash; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import encoded, pieces
from granary.llm.textscan import Scan, repeated, seen_before

FEATURES = (
    "log_words", "word_length", "word_length_spread", "symbols", "pipes", "upper", "digits", "marks", "repeat_words",
    "repeat_lines", "stutter", "distinct_words", "log_line_words",
)


def _marked(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOLS, _PIPES, _MARKS = _marked("#*$%&<>@^~=+_\\{}[]"), _marked("|"), _marked("!?")
_UPPER, _LOWER, _DIGITS = _marked("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _marked("abcdefghijklmnopqrstuvwxyz"), _marked("0123456789")


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES for each text."""
    s = Scan(texts)
    words = np.maximum(s.n_words, 1).astype(float)
    chars = s.per_doc(s.chars)
    first, key = s.ngrams(3)
    both = repeated(key, s.doc[first])
    step = np.zeros(len(s.words) + 1, np.int64)
    np.add.at(step, first[both], 1)
    np.add.at(step, first[both] + 3, -1)
    low, _, line_doc, line_key = s.lines
    lines = np.bincount(line_doc, minlength=s.n_docs) if len(low) else np.zeros(s.n_docs)
    again = np.bincount(line_doc[seen_before(line_key, line_doc)], minlength=s.n_docs) if len(low) else np.zeros(s.n_docs)
    stutter = np.concatenate([[False], (s.words[1:] == s.words[:-1]) & (s.doc[1:] == s.doc[:-1])]) if len(s.words) else np.zeros(0, bool)
    mean = chars / words
    letters = np.maximum(s.count(_UPPER) + s.count(_LOWER), 1)
    return np.stack([
        np.log1p(s.n_words), mean, np.sqrt(np.maximum(s.per_doc(s.chars**2) / words - mean**2, 0)), s.count(_SYMBOLS) / words, s.count(_PIPES) / words,
        s.count(_UPPER) / letters, s.count(_DIGITS) / np.maximum(chars, 1), s.count(_MARKS) / words, s.per_doc(np.cumsum(step[:-1]) > 0) / words,
        again / np.maximum(lines, 1), s.per_doc(stutter) / words, 1 - s.per_doc(seen_before(s.words, s.doc)) / words, np.log1p(s.n_words / np.maximum(lines, 1)),
    ], axis=1)

#: Bytes of text that are turned into numpy arrays at a time.
_PIECE = 1 << 20


@dataclass(frozen=True)
class GamSettings:
    max_rows: int = 12_000
    bins: int = 48
    pair_bins: int = 12
    pairs: int = 8
    rounds: int = 150
    pair_rounds: int = 60
    leaves: int = 4
    rate: float = 0.15
    ridge: float = 2.0


@dataclass
class Gam:
    """Lookup tables of the single features and of the pairs."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += values[np.searchsorted(edges, x[:, f], "right")]
        if self.pairs:
            coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.pair_edges)]
            for i, j, values in self.pairs:
                out += values[coarse[i], coarse[j]]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints between quantiles that differ."""
    values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="inverted_cdf"))
    return (values[1:] + values[:-1]) / 2


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A tree over ordered bins with sums of gradients g and of curvatures h: a value for each bin."""
    cuts = [0, len(g)]
    sg, sh = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, -1
        m = np.arange(a + 1, b)
        lg, lh = sg[m] - sg[a], sh[m] - sh[a]
        rg, rh = sg[b] - sg[m], sh[b] - sh[m]
        gain = lg**2 / (lh + ridge) + rg**2 / (rh + ridge) - (lg + rg) ** 2 / (lh + rh + ridge)
        k = int(np.argmax(gain))
        return float(gain[k]), int(m[k])

    for _ in range(leaves - 1):
        gain, cut = max(best(a, b) for a, b in zip(cuts, cuts[1:], strict=False))
        if gain <= 1e-9:
            break
        cuts = sorted([*cuts, cut])
    out = np.empty(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (sg[b] - sg[a]) / (sh[b] - sh[a] + ridge)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best single cut on each axis of a grid: its gain, and a value for each cell."""
    cum = lambda a: np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    cg, ch = cum(g), cum(h)
    inner = (slice(1, -1), slice(1, -1))
    tl_g, tl_h = cg[inner], ch[inner]
    top_g, top_h, left_g, left_h = cg[1:-1, -1:], ch[1:-1, -1:], cg[-1:, 1:-1], ch[-1:, 1:-1]
    parts = [(tl_g, tl_h), (top_g - tl_g, top_h - tl_h), (left_g - tl_g, left_h - tl_h), (cg[-1, -1] - top_g - left_g + tl_g, ch[-1, -1] - top_h - left_h + tl_h)]
    gain = sum(a**2 / (b + ridge) for a, b in parts) - cg[-1, -1] ** 2 / (ch[-1, -1] + ridge)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    r, c = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [float(a[r, c] / (b[r, c] + ridge)) for a, b in parts]
    out = np.empty_like(g)
    out[: r + 1, : c + 1], out[: r + 1, c + 1 :], out[r + 1 :, : c + 1], out[r + 1 :, c + 1 :] = v
    return float(gain[r, c]), out


def fit(x: np.ndarray, y: np.ndarray, settings: GamSettings = GamSettings()) -> Gam:
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(intercept=float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    n = x.shape[1]
    model.edges = [_edges(x[:, f], settings.bins) for f in range(n)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    binned = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.edges)]
    margin = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(settings.rounds):
        for f in range(n):
            g, h = slopes()
            size = len(model.tables[f])
            step = settings.rate * _tree(np.bincount(binned[f], g, size), np.bincount(binned[f], h, size), settings.leaves, settings.ridge)
            model.tables[f] += step
            margin += step[binned[f]]
    model.pair_edges = [_edges(x[:, f], settings.pair_bins) for f in range(n)]
    coarse = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(model.pair_edges)]

    def grid(i: int, j: int, v: np.ndarray) -> np.ndarray:
        a, b = len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1
        return np.bincount(coarse[i] * b + coarse[j], v, a * b).reshape(a, b)

    g, h = slopes()
    gains = sorted(((_quarters(grid(i, j, g), grid(i, j, h), settings.ridge)[0], i, j) for i in range(n) for j in range(i + 1, n)), reverse=True)
    model.pairs = [(i, j, np.zeros((len(model.pair_edges[i]) + 1, len(model.pair_edges[j]) + 1))) for gain, i, j in gains[: settings.pairs] if gain > 0]
    for _ in range(settings.pair_rounds):
        for i, j, values in model.pairs:
            g, h = slopes()
            _, step = _quarters(grid(i, j, g), grid(i, j, h), settings.ridge)
            values += settings.rate * step
            margin += settings.rate * step[coarse[i], coarse[j]]
    return model


def quality_column(model: Gam, text: Column) -> Column:
    """The score of a text column, as a column: input columns stay as they are."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        out: list[np.ndarray] = []
        for piece in pieces(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), "text", _PIECE):
            out.append(model.scores(features(encoded(piece.column(0)))))
        return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return score(text)


def fit_quality(docs: DataFrame, labels: DataFrame, settings: GamSettings = GamSettings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Gam:
    """A model of the labelled documents; `labels` has the ids to learn from and their 0/1 labels."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("double").alias("y"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(settings.max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", _PIECE):
            rows = features(encoded(piece.column("text")))
            yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("y"), pa.array(list(rows), pa.list_(pa.float64()))], names=["id", "y", "x"])

    # the sample has at most max_rows rows, so it is broadcast whatever the size of the corpus
    joined = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id")
    kind = joined.schema["id"].dataType.simpleString()
    rows = joined.select("id", "y", "text").mapInArrow(run, f"id {kind}, y double, x array<double>").groupBy("id").agg(F.min("x").alias("x"), F.max("y").alias("y"))
    got = rows.toArrow()
    if not got.num_rows:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0), settings)
    order = np.argsort(got["id"].to_numpy(), kind="stable")
    x = np.array(got["x"].to_pylist(), float)[order]
    return fit(x, got["y"].to_numpy()[order], settings)
