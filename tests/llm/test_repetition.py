from __future__ import annotations

import os
import random
import re
from collections import Counter

import pytest

from granary.llm.repetition import RepetitionRules, measure, measured_limits, repetition_coverage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text: str, n: int) -> tuple[list[str], list[bool]]:
    words = WORD.findall(text)
    counts = Counter(tuple(words[k : k + n]) for k in range(len(words) - n + 1))
    covered = [False] * len(words)
    for k in range(len(words) - n + 1):
        if counts[tuple(words[k : k + n])] > 1:
            covered[k : k + n] = [True] * n
    return words, covered


def lines(text: str) -> list[str]:
    seen, out = set(), []
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                out.append(line)
            seen.add(line)
    return out


def texts() -> list[str]:
    rng = random.Random(1)
    out = ["", " \n\t", "a", "a a a a", "# * | <>", "x\ny\nx\n \n \nx ", "é é é\né é é", "naïve x naïve x naïve x"]
    for _ in range(60):
        out.append("".join(rng.choice(["a", "b", "ab", "ß", "|"]) + rng.choice([" ", "  ", "\n", "\t"]) for _ in range(rng.randrange(120))))
    return out


def test_counts_equal_plain_counting():
    all_texts = texts()
    for batch in (all_texts, all_texts[::-1], all_texts[:1]):
        got = measure([t.encode() for t in batch], (5, 8))
        for k, t in enumerate(batch):
            words, covered = plain(t, 3)
            assert got["n_words"][k] == len(words)
            assert got["word_chars"][k] == sum(map(len, words))
            assert got["n_symbols"][k] == len(re.findall(r"[#*$%&|<>]", t))
            assert got["n_repeat_words"][k] == sum(covered)
            assert got["n_dup_lines"][k] == len(lines(t))
            assert got["dup_line_chars"][k] == sum(len(w) for x in lines(t) for w in WORD.findall(x))
            for n in (5, 8):
                words, covered = plain(t, n)
                assert got[f"cover_{n}"][k] == sum(len(w) for w, c in zip(words, covered, strict=True) if c)


def test_measure_of_nothing():
    assert len(measure([], (5,))["n_words"]) == 0


def test_odd_rows(odd_docs, no_docs):
    rows = repetition_coverage(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    empty = [r for r in rows if r.doc_id in (2, 3, 4)]
    assert len(empty) == 3 and all(r.n_words == 0 and r.base_failed and not r.kept for r in empty)
    assert [r.kept for r in rows if r.doc_id == 5] == [True]
    assert repetition_coverage(no_docs).count() == 0


def test_rules_reject_repeats_that_the_base_rule_lets_pass(spark):
    rng = random.Random(3)
    fresh = " ".join(f"w{rng.randrange(10**6)}" for _ in range(120))
    line = " ".join(f"looooooooooooong{k}" for k in range(12))
    rows = [(1, fresh), (2, f"{fresh}\n" + "\n".join([line] * 6))]
    got = {r.doc_id: r for r in repetition_coverage(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and not got[1].base_failed
    assert not got[2].kept and not got[2].base_failed
    loose = RepetitionRules(ngram_percent=((5, 100),), line_percent=100)
    assert all(r.kept for r in repetition_coverage(spark.createDataFrame(rows, "doc_id long, text string"), rules=loose).collect())


def test_the_method_decides_on_the_tables(spark):
    path = "/root/testdata/sf0.1/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    rows = repetition_coverage(spark.read.parquet(path)).where("NOT base_failed").collect()
    gone = [r for r in rows if not r.kept]
    assert 0 < len(gone) < 0.02 * len(rows)
    assert all(100 * max(*(r[f"cover_{n}"] for n in range(5, 11)), 2 * r.dup_line_chars) > 20 * r.word_chars for r in gone)


def test_limits_can_be_measured_again(spark):
    """On tables that the limits weren't taken from: at most one good text in a hundred exceeds them."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    limits, rules = measured_limits(docs, labels), RepetitionRules()
    assert all(limits[f"cover_{n}"] <= p for n, p in rules.ngram_percent) and 0 < limits["lines"] <= rules.line_percent and limits["cover_5"] > 5
    good = labels.where("quality = 1").select("doc_id").distinct()
    rows = repetition_coverage(docs).where("NOT base_failed").join(good, "doc_id", "left_semi")
    assert rows.where("NOT kept").count() <= 0.01 * rows.count()
    assert set(measured_limits(docs.limit(0), labels).values()) == {None}
