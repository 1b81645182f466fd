from __future__ import annotations

import re

import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from granary.llm.gam import features, fit_quality
from granary.llm.mixing import mix_sources
from granary.llm.queries import learnable, n_words
from granary.llm.secret_ledger import RULES


def write(df, path):
    df.write.parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """What each stage got and what it returned."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        got = write(stage(spark, docs, sf), folder / name)
        out[name] = (docs.collect(), got.collect(), got.columns)
        docs = got
    return out


def test_columns(stages):
    for name, _ in cp.STAGES[:-1]:
        assert stages[name][2] == cp.COLUMNS


def test_quality(spark, sf, stages):
    before, after, _ = stages["quality"]
    model = fit_quality(spark.read.parquet(f"{sf}/documents.parquet"), learnable(spark.read.parquet(f"{sf}/labels.parquet"), 4, 2))
    scores = model.scores(features([r.text.encode() for r in before]))
    assert sorted(r.doc_id for r in after) == sorted(r.doc_id for r, s in zip(before, scores, strict=True) if s >= cp.KEEP)
    assert 0 < len(after) < len(before)


def test_near_duplicates(stages):
    from tests.llm.test_partenum import plain

    before, after, _ = stages["near_duplicates"]
    groups = plain([r.doc_id for r in before], [r.text for r in before], 5, 80)
    assert sorted(r.doc_id for r in after) == sorted(i for i, _, component, _ in groups if i == component)
    assert len(after) < len(before)


def test_secrets(spark, sf, stages):
    before, after, _ = stages["secrets"]
    texts = {r.doc_id: r for r in after}
    assert len(texts) == len(before)
    for r in before:
        found = any(len(m[x.group]) >= x.least for x in RULES for m in re.finditer(x.pattern, r.text, re.ASCII))
        assert (texts[r.doc_id].text != r.text) == found and texts[r.doc_id].n_chars == len(texts[r.doc_id].text)
    rows = [(1, "a password = hunter22 b", "en", "s", 1), (2, "clean", None, None, 5), (3, None, "en", "s", None)]
    masked = cp.secrets(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), sf)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in masked.collect()) == [(1, "a [secret] b", 12), (2, "clean", 5), (3, None, None)]


def test_mixing_and_packing(stages):
    before, after, _ = stages["mixing"]
    words = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows)
    assert {r.doc_id for r in after} <= {r.doc_id for r in before}
    assert 0.9 * words(before) <= words(after) <= words(before)  # whole documents, about eight a source here
    copies = {}
    for r in after:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= 3
    _, rows, _ = stages["packing"]
    assert sum(r.piece == 0 for r in rows) == len(after)
    content = {}
    for r in rows:
        content.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in content.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_equals_the_stages(spark, sf, stages):
    key = lambda rows: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows)
    assert key(cp.run(spark, sf).collect()) == key(stages["packing"][1])


def test_odd_and_empty_tables(spark, sf, odd_docs, no_docs, tmp_path):
    for k, df in enumerate((odd_docs, no_docs)):
        docs = write(df, tmp_path / f"{k}-in")
        for name, stage in cp.STAGES:
            docs = write(stage(spark, docs, sf), tmp_path / f"{k}-{name}")
        assert (docs.count() > 0) == (k == 0)


def test_mixing_of_rows_without_ids_and_of_shared_ids(spark, sf, tmp_path):
    """40 rows without an id and three under one, of different sizes: each is a row of its own."""
    rows = [(None, " ".join(["w"] * (k % 7 + 3)) + f" n{k}", "en", "s1", 1) for k in range(40)]
    rows += [(7, " ".join(["v"] * k), "en", "s2", 1) for k in (1, 30, 90)] + [(8, "", "en", "s2", 0), (9, None, "en", "s1", 0)]
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (given, write(given, tmp_path / "docs")):
        mix = mix_sources(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), F.col("size")).collect()
        out = cp.mixing(spark, docs, sf)
        assert out.columns == cp.COLUMNS
        texts = [r.text for r in out.collect()]
        for source in ("s1", "s2"):
            own = {t for _, t, _, s, _ in rows if s == source}
            target = next(r.target for r in mix if r.source == source)
            taken = sum(len(t.split()) for t in texts if t in own)
            assert taken == sum(r.taken for r in mix if r.source == source) <= target + 1e-6
        assert max(texts.count(t) for t in texts) <= 3 and all(texts)


def test_documents_without_an_id_are_not_dropped_as_duplicates(spark, sf):
    rows = [(None, "a b c d e f g", "en", "s", 1), (None, "a b c d e f g", "en", "s", 1), (4, "a b c d e f g", "en", "s", 1), (2, "a b c d e f g", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.near_duplicates(spark, docs, sf)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, None, None]
    assert kept.where(F.col("doc_id") == 4).count() == 0
