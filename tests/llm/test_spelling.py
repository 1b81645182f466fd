from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.llm.queries import drop_letter, op11_spelling_variants
from granary.llm.spelling import SpellingSettings, spelling_variants, word_counts

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_counts(rows, rewrite, least=7, occurrences=2):
    counts = Counter()
    for id_, text in rows:
        for run in LETTERS.findall(text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            counts[rewrite("" if id_ is None else str(id_), word)] += 1
    return {w: n for w, n in counts.items() if len(w) >= least and n >= occurrences}


def plain(counts, ratio=10):
    """All words against all words."""
    words, out = sorted(counts), {}
    for w in words:
        near = [v for v in words if abs(len(v) - len(w)) < 2 and one_edit(w, v)]
        best = min(near, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= ratio * counts[w] else None
        out[w] = (counts[w], len(near), form, counts[form] if form else None)
    def root(w):
        return root(out[w][2]) if out[w][2] else w
    return {w: (*v, root(w)) for w, v in out.items()}


def got(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def corpus(seed, n=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice("aabcdéèñöÿ×") for _ in range(rng.choice([7, 8, 9, 12]))) for _ in range(20)]
    rows = []
    for k in range(n):
        words = []
        for _ in range(80):
            w = base[min(int(rng.expovariate(0.3)), 19)]
            at = rng.randrange(len(w))
            w = rng.choice([w] * 30 + [w[:at] + w[at + 1 :], w[:at] + "b" + w[at + 1 :], w[:at] + "x" + w[at:], w.upper()])
            words.append(w)
        rows.append((k, rng.choice([" ", ", ", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("settings", [SpellingSettings(), SpellingSettings(block=7, task=2_000), SpellingSettings(letters=50)])
def test_equals_comparing_everything(spark, settings):
    rows = corpus(settings.block)
    counts = plain_counts(rows, drop_letter)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    result = got(spelling_variants(word_counts(df, drop_letter, settings=settings), settings))
    assert result == plain(counts)
    assert any(v[2] for v in result.values()) and any(v[2] and v[4] != v[2] for v in plain({"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100}).values())


def test_forms_are_followed_to_the_last(spark):
    counts = {"abcdefg": 1, "abcdefh": 10, "abcdeih": 100, "abcdjih": 1000, "abckjih": 10_000, "ablkjih": 100_000, "zzzzzzz": 5, "zzzzzzzz": 49}
    assert got(spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == plain(counts)


def test_ties_and_accents(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaaaÿ": 20, "aaaaaaaa": 20, "ÀÀÀÀÀÀÀ": 3, "àÀÀÀÀÀÀ": 40, "x" * 70_000: 2, "x" * 70_001: 30}
    assert got(spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == plain(counts)


def test_long_texts_are_cut_between_words(spark, monkeypatch):
    import granary.llm.spelling as S

    monkeypatch.setattr(S, "_PIECE", 10)
    text = "abcdefghijkl, abcdefghijklmnopqrstuvwxyz abcdefg " * 3
    assert [w for p in S._pieces(text) for w in LETTERS.findall(p)] == LETTERS.findall(text) and "".join(S._pieces(text)) == text


def test_odd_rows(odd_docs, no_docs):
    counts = plain_counts([(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()], drop_letter)
    assert got(spelling_variants(word_counts(odd_docs, drop_letter))) == plain(counts)
    assert word_counts(no_docs).count() == 0 and spelling_variants(word_counts(no_docs)).count() == 0


def test_hot_word(spark):
    rows = spark.range(20_000).select("id", F.lit("Trainingdata trainingdate").alias("text")).withColumnRenamed("id", "doc_id")
    counts = {r.word: r.n for r in word_counts(rows).collect()}
    assert counts == {"trainingdata": 20_000, "trainingdate": 20_000}


def test_query_equals_plain(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    counts = plain_counts(rows, drop_letter)
    result = got(op11_spelling_variants(spark, sf))
    assert {w: v[0] for w, v in result.items()} == counts
    holes, near = {}, {w: set() for w in counts}
    for w in counts:
        for k in range(len(w)):
            holes.setdefault(w[:k] + "*" + w[k + 1 :], []).append(w)
            if (v := w[:k] + w[k + 1 :]) in counts:
                near[w].add(v)
                near[v].add(w)
    for group in holes.values():
        for w in group:
            near[w].update(v for v in group if v != w)
    assert {w: v[1] for w, v in result.items()} == {w: len(v) for w, v in near.items()}


def test_dropped_letter():
    word = next(w for w in (f"abcdefg{chr(97 + a)}{chr(97 + b)}" for a in range(26) for b in range(26)) if zlib.crc32(f"3:{w}".encode()) % 31 == 0)
    assert len(drop_letter("3", word)) == len(word) - 1
