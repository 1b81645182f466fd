from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import queries
from granary.llm.toxicity import ToxicitySettings, fit, fit_toxicity, gram_features, log_ratios, toxicity_column

SMALL = ToxicitySettings(bits=14, steps=40)


def test_grams_do_not_depend_on_the_batch():
    texts = ["Ab, ab cde", "", "é\U0001f600x ?!", "cde"]
    alone = [sorted(gram_features([t], SMALL)[2].tolist()) for t in texts]
    doc, _, gram = gram_features(texts, SMALL)
    assert [sorted(gram[doc == k].tolist()) for k in range(4)] == alone
    assert alone[1] == [] and gram_features([], SMALL)[0].size == 0
    # two distinct words: one shorter than any gram gives itself once for each length
    assert len(alone[0]) == len(SMALL.grams) * 2 and alone[3] == sorted(set(alone[3]))


def test_equal_words_count_once_and_case_is_ignored():
    assert sorted(gram_features(["word WORD word"], SMALL)[2]) == sorted(gram_features(["word"], SMALL)[2])


def test_windows():
    text = " ".join(f"w{k}" for k in range(25))
    doc, unit, _ = gram_features(["a", text, "b"], SMALL, 10)
    assert sorted(set(zip(doc.tolist(), unit.tolist(), strict=True))) == [(0, 0), (1, 1), (1, 2), (1, 3), (2, 4)]


def model():
    clean = ["the cat sat on the mat", "nothing to see here", "a pleasant day outside", "reading books quietly"] * 10
    toxic = ["you stupid cat", "what an idiot here", "stupid idiot outside", "the mat is stupid"] * 10
    rows = [np.unique(gram_features([t], SMALL)[2], return_counts=True) for t in clean + toxic]
    sums = np.zeros((2, 1 << SMALL.bits))
    for k, (gram, n) in enumerate(rows):
        sums[int(k >= 40), gram] += n
    ratio = log_ratios(sums[0], sums[1], tuple(sums.sum(axis=1)), SMALL)
    return fit(rows, np.array([0.0] * 40 + [1.0] * 40), 0.5, ratio, np.arange(1 << SMALL.bits), SMALL)


def test_unseen_texts_and_very_long_ones():
    long = " ".join(f"the day sat books{k}" for k in range(3000))
    scores = model().scores(["such a stupid book", "the cat outside", "", f"{long} stupid idiot {long}", long, "STUPIDLY done, IDIOT!"])
    assert scores[0] > 0.5 > scores[1] and scores[3] > 2 * scores[4] and scores[5] > 0.5
    assert abs(scores[2] - 1 / (1 + np.exp(-model().intercept))) < 1e-9


def test_scores_equal_the_sum_over_grams():
    m, text = model(), "a stupid day"
    margin = m.intercept + sum(float(m.weights[g]) for g in gram_features([text], SMALL)[2])
    assert abs(m.scores([text])[0] - 1 / (1 + np.exp(-margin))) < 1e-6


def test_degenerate_labels_and_odd_rows(spark, odd_docs, no_docs):
    labels = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, toxic int")
    assert fit_toxicity(odd_docs, labels((99, 1), (98, 0), (None, 1)), SMALL).weights is None
    assert fit_toxicity(odd_docs, labels((1, 1)), SMALL).weights is None
    both = fit_toxicity(odd_docs, labels((1, 1), (1, 0), (7, 0), (5, 0), (2, None)), SMALL)
    rows = odd_docs.select("doc_id", "score", toxicity_column(both, F.col("text")).alias("s")).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.s <= 1 for r in rows)
    assert len({r.s for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert no_docs.select(toxicity_column(both, F.col("text"))).count() == 0


def mixed(x):
    """The 64-bit finaliser, in plain numbers."""
    low = (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & low
    x = (x ^ x >> 27) * 0x94D049BB133111EB & low
    return x ^ x >> 31


def plain_margin(text, model):
    """The largest sum over the windows of a text, word by word."""
    s, best = model.settings, None
    apart = lambda c: not c.isalnum() if c < "\x80" else c <= "\u3000" and c.isspace()
    words = "".join(" " if apart(c) else c for c in text.lower()).split(" ")
    words = [w for w in words if w]
    for lo in range(0, len(words), s.window):
        total = 0.0
        for word in set(words[lo : lo + s.window]):
            for n in s.grams:
                for k in range(max(len(word) - n + 1, 1)):
                    gram, h = word[k : k + n], n
                    for c in gram:
                        h = (h * 0x100000001B3 + ord(c) + 1) % (1 << 64)
                    total += float(model.weights[mixed((4 * h + (k == 0) + 2 * (k + len(gram) == len(word))) % (1 << 64)) >> 64 - s.bits])
        best = total if best is None or total > best else best
    return model.intercept + (best or 0.0)


def test_query_against_plain_python(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, queries.learnable(labels, 3, 1))
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = queries.op10_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts) and model.weights is not None
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7)
        assert r.score == pytest.approx(1 / (1 + math.exp(-plain_margin(texts[r.doc_id], model))), abs=2e-4)


def test_the_chosen_features_do_not_depend_on_partitions(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    few = ToxicitySettings(bits=14, max_features=500)
    one, other = (fit_toxicity(d, queries.learnable(labels, 3, 1), few) for d in (docs, docs.repartition(7)))
    assert np.array_equal(np.flatnonzero(one.weights), np.flatnonzero(other.weights)) and np.count_nonzero(one.weights) <= 500
    assert np.allclose(one.weights, other.weights, atol=1e-5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op10_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    toxic = [r for r in rows if r.toxic == 1]
    assert len(toxic) > 50 and sum(r.predicted for r in toxic) / len(toxic) > 0.88
    assert sum(r.predicted for r in rows if r.toxic == 0) / len(rows) < 0.01
