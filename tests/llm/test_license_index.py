from __future__ import annotations

import random
import re

from granary.llm.license_index import TEMPLATES, document_frequencies, index_files, scan_licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(text: str | None) -> tuple[int, list]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lower)
    out = []
    for t in TEMPLATES:
        for start in range(-len(t.words), len(words)):
            at = lambda k, s=start: words[s + k] if 0 <= s + k < len(words) else None
            if all(at(k) == w for k, w in t.mandatory.items()):
                share = sum(at(k) == w for k, w in enumerate(t.words)) / len(t.words)
                if share >= t.share:
                    out.append((start, t.label, t.base, share))
    return len(words), sorted(out)


def test_all_alignments_are_found(spark):
    texts = [
        None, "", "GNU general, public\nlicense", "gnu gnu general public license license", "cc by cc by", "CC BY-NC 4.0", "mit licensé mit license",
        "apache license version 2 0", "Licensed under the Apache License, Version 2.0.", "under the mozilla public license v 2 0", "x " * 3000 + "mit license",
        "licence by cc", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files",
        "Permission is hereby granted, free of charge", "cc-by-sa 4.0 gnu lesser general public license",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in scan_licenses(df).collect():
        n, matches = plain(texts[r.doc_id])
        assert r.n_words == n
        assert [(m.start, m.label, m.base, m.share) for m in r.matches] == matches, texts[r.doc_id]


def test_the_choice_of_rare_tokens_changes_nothing(spark):
    df = spark.createDataFrame([(1, "license license gnu gnu general public license version 3 apache license")], "doc_id long, text string")
    want = scan_licenses(df).collect()
    words = sorted({w for t in TEMPLATES for w in t.mandatory.values()})
    for k in range(4):
        frequencies = {w: (i * (2 * k + 1)) % 7 for i, w in enumerate(words)}
        assert scan_licenses(df, frequencies=frequencies).collect() == want


def test_files_and_their_index(spark):
    df = spark.createDataFrame([(1, "license"), (2, "the license MIT"), (3, "license license")], "doc_id long, text string")
    index = index_files(df)
    frequencies = document_frequencies(index)
    assert frequencies["license"] == 3 and frequencies["mit"] == 1
    assert {r.id: [tuple(p) for p in r.postings] for r in index.collect()} == {1: [], 2: [(0, "the"), (1, "license"), (2, "mit")], 3: []}


def test_bodies(spark):
    rng = random.Random(6)
    texts = []
    for t in TEMPLATES:
        if t.label.endswith("-body"):
            words, keys = t.words, t.mandatory
            changed = [w if k in keys or rng.random() < 0.7 else "other" for k, w in enumerate(words)]
            texts += [" ".join(words), "; ".join(w.title() for w in words[: len(words) * 4 // 5]) + " x", " ".join(changed), " ".join([*words, *words]), " ".join(words[5:])]
            texts.append(" ".join("gap" if k == min(keys) else w for k, w in enumerate(words)))
    texts.append("mit license " * 30_000 + "licensed under cc by 4 0 " * 10_000)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in scan_licenses(df).collect()}
    for k, text in enumerate(texts[:-1]):
        assert [(m.start, m.label, m.base, m.share) for m in rows[k].matches] == plain(text)[1]
    assert {m.label for r in rows.values() for m in r.matches} >= {"mit-body", "isc-body", "bsd-2-body", "zlib-body"}
    assert sum(m.label == "mit" for m in rows[len(texts) - 1].matches) == 30_000 and sum(m.label == "cc-by-4.0" for m in rows[len(texts) - 1].matches) == 10_000


def test_odd_rows(odd_docs, no_docs):
    rows = scan_licenses(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert [m.label for r in rows if r.doc_id == 8 for m in r.matches] == ["mit", "mit"]
    assert all(r.matches == [] and r.n_words == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert scan_licenses(no_docs).count() == 0
