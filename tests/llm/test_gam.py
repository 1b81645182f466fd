from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import gam, queries
from granary.llm.gam import FEATURES, GamSettings, features, fit, fit_quality, quality_column


def test_features_by_plain_counting():
    text = "The cat | the CAT!\nthe cat | the CAT!\n\nx1 x1 $$"
    row = dict(zip(FEATURES, features([b"other text", text.encode(), b""])[1], strict=True))
    words = text.split()
    assert row["log_words"] == pytest.approx(np.log1p(len(words)))
    assert row["word_length"] == pytest.approx(np.mean([len(w) for w in words]))
    assert row["word_length_spread"] == pytest.approx(np.std([len(w) for w in words]))
    assert row["symbols"] == pytest.approx(text.count("$") / len(words)) and row["pipes"] == pytest.approx(2 / len(words))
    letters = re.findall("[A-Za-z]", text)
    assert row["upper"] == pytest.approx(sum(c.isupper() for c in letters) / len(letters))
    assert row["digits"] == pytest.approx(2 / len("".join(words))) and row["marks"] == pytest.approx(2 / len(words))
    assert row["stutter"] == pytest.approx(1 / len(words)) and row["repeat_lines"] == 0  # the lines differ by a capital
    assert row["distinct_words"] == pytest.approx(len(set(words)) / len(words))
    assert np.isfinite(features([b"", b" ", b"a"])).all() and features([]).shape == (0, len(FEATURES))


def test_single_features_are_learnt():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((np.abs(x[:, 0]) > 1) ^ (rng.random(3000) < 0.02)).astype(float)
    model = fit(x[:2000], y[:2000], GamSettings(rounds=60, pair_rounds=10))
    assert ((model.scores(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.94
    spread = [np.ptp(t) for t in model.tables]
    assert spread[0] > 3 * max(spread[1:])


def test_interactions_are_learnt_by_pairs_only():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    y = (x[:, 0] * x[:, 2] > 0).astype(float)
    model = fit(x[:3000], y[:3000], GamSettings(rounds=20, pair_rounds=60, pairs=1))
    assert [(i, j) for i, j, _ in model.pairs] == [(0, 2)]
    assert ((model.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.9
    alone = fit(x[:3000], y[:3000], GamSettings(rounds=20, pair_rounds=0, pairs=0))
    assert ((alone.scores(x[3000:]) >= 0.5) == y[3000:]).mean() < 0.65


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(500, 3)), (rng.random(500) < 0.5).astype(float)
    model = fit(x, y, GamSettings(rounds=5, pair_rounds=5))
    for row, score in zip(x[:20], model.scores(x[:20]), strict=True):
        margin = model.intercept + sum(t[sum(row[f] >= c for c in e)] for f, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
        margin += sum(v[sum(row[i] >= c for c in model.pair_edges[i]), sum(row[j] >= c for c in model.pair_edges[j])] for i, j, v in model.pairs)
        assert score == pytest.approx(1 / (1 + np.exp(-margin)))


def test_degenerate_labels_and_odd_rows(spark, odd_docs, no_docs):
    labels = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, quality int")
    nothing = fit_quality(odd_docs, labels((99, 1), (None, 1), (1, None)))
    assert nothing.scores(features([b"x"]))[0] == 0.5
    ones = fit_quality(odd_docs, labels((1, 1), (8, 1)))
    assert ones.scores(features([b"x"]))[0] == pytest.approx(0.75)
    both = fit_quality(odd_docs, labels((1, 1), (1, 0), (7, 0), (5, 1)), GamSettings(rounds=2))
    rows = odd_docs.select("doc_id", "score", quality_column(both, F.col("text")).alias("s")).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.s <= 1 for r in rows)
    assert len({r.s for r in rows if r.doc_id in (2, 3)}) == 1
    assert no_docs.select(quality_column(both, F.col("text"))).count() == 0
    assert fit_quality(no_docs, labels((1, 1))).scores(features([b""]))[0] == 0.5


def test_sample_is_bounded(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    seen = []
    original = gam.fit
    try:
        gam.fit = lambda x, y, s: seen.append(len(y)) or original(x, y, s)
        fit_quality(docs, labels, GamSettings(max_rows=40, rounds=1, pair_rounds=0))
    finally:
        gam.fit = original
    assert seen == [40]


def plain_features(text):
    """FEATURES, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n, chars = max(len(words), 1), sum(map(len, words))
    raw = text.encode()
    count = lambda marks: sum(chr(b) in marks for b in raw)
    letters = max(sum(65 <= b <= 90 or 97 <= b <= 122 for b in raw), 1)
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    often = Counter(grams)
    covered = {k + i for k, g in enumerate(grams) if often[g] > 1 for i in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    mean = chars / n
    return [
        np.log1p(len(words)), mean, math.sqrt(max(sum(len(w) ** 2 for w in words) / n - mean**2, 0)), count("#*$%&<>@^~=+_\\{}[]") / n, count("|") / n,
        sum(65 <= b <= 90 for b in raw) / letters, sum(48 <= b <= 57 for b in raw) / max(chars, 1), count("!?") / n, len(covered) / n,
        (len(lines) - len(set(lines))) / max(len(lines), 1), sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, 1 - (len(words) - len(set(words))) / n, np.log1p(len(words) / max(len(lines), 1)),
    ]


def test_query_against_plain_python(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, queries.learnable(labels, 4, 2))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op8_quality_gam(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and model.tables
    for r in rows:
        x = plain_features(texts[r.doc_id])
        assert x == pytest.approx(features([texts[r.doc_id].encode()])[0].tolist(), abs=1e-9)
        margin = model.intercept + sum(t[sum(x[f] >= c for c in e)] for f, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
        margin += sum(v[sum(x[i] >= c for c in model.pair_edges[i]), sum(x[j] >= c for c in model.pair_edges[j])] for i, j, v in model.pairs)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7)
        assert r.score == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-6)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op8_quality_gam(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert len(rows) > 500 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.98
