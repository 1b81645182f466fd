from __future__ import annotations

import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from granary.llm.secret_ledger import BASE_RULES, RULES, redact, redacted, scan, scan_increments

KEY = "AKIA" + "ABCDEFGH12345678"
TEXTS = [
    None, "", "password = hunter22", "passWORD:'abc'", 'api_key="abcdef" APIKEY=ghijkl api-key=mnopqr', "password=token: abcdefgh", "secret=token=abcdefgh",
    f"é\U0001f600 {KEY} and AKIA123 {KEY}x", "a" * 24 + " " + "0123456789abcdef01234567" + "G", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" tail",
    "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "ghp_short", "https://user:pass@host/", "xoxb-1234567890-abc", "AIza" + "B" * 35, "eyJ" + "a" * 20 + ".eyJ" + "b" * 20 + ".c",
    "token=\n" * 5, "password = hunter22", "token: abcdef" * 500,
]


def plain(text, rules=RULES):
    out = []
    for k, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or "", re.ASCII):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), k, m.end(), r.kind))
    return sorted(out)


def spans(row):
    return [(s.start, s.order, s.end, s.kind) for s in row.spans]


def test_spans_equal_plain_matching(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    findings, entries = scan(df)
    got = {r.doc_id: spans(r) for r in findings.collect()}
    assert got == {k: plain(t) for k, t in enumerate(TEXTS)}
    assert len({s[3] for v in got.values() for s in v}) == len(RULES)
    assert entries.count() == len(RULES) * (len(set(TEXTS)) - 1)  # null and empty are one blob


def test_only_unseen_pairs_are_scanned(spark):
    first = spark.createDataFrame([(1, "password = hunter22"), (2, "clean")], "doc_id long, text string")
    _, entries = scan(first)
    ledger = entries.cache()
    again = spark.createDataFrame([(3, "password = hunter22"), (4, "secret: abcdef9"), (5, "clean")], "doc_id long, text string")
    findings, fresh = scan(again, ledger)
    assert {r.doc_id: [s[3] for s in spans(r)] for r in findings.collect()} == {3: ["assign"], 4: ["assign"], 5: []}
    assert fresh.select("blob").distinct().count() == 1 and fresh.count() == len(RULES)
    changed = tuple(replace(r, version=2, least=8) if r.kind == "assign" else r for r in RULES)
    findings, fresh = scan(again, ledger.unionByName(fresh), changed)
    assert {r.rule for r in fresh.select("rule").distinct().collect()} == {"assign@2"} and fresh.count() == 3
    assert {r.doc_id: len(r.spans) for r in findings.collect()} == {3: 1, 4: 0, 5: 0}


@pytest.mark.parametrize("known", [0, 1 << 17])
def test_a_full_ledger_leaves_only_hashing(spark, tmp_path, monkeypatch, known):
    """With every pair known no text survives the first pass, no hint is tried, and no pattern runs above the filter."""
    import granary.llm.secret_ledger as L

    monkeypatch.setattr(L, "_KNOWN", known)
    spark.createDataFrame(list(enumerate(TEXTS)) * 3, "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    scan(df)[1].write.parquet(str(tmp_path / "ledger"))
    ledger = spark.read.parquet(str(tmp_path / "ledger"))
    # a hint that fails wherever it is tried
    failing = lambda text, rules, asked: F.when(F.array_contains(F.array(*asked), True), F.raise_error(F.lit("a hint was tried")).cast("boolean")).otherwise(False)
    monkeypatch.setattr(L, "_hinted", failing)
    monkeypatch.setattr(L, "_pieces", lambda rule, text: F.raise_error(F.lit("a pattern was matched")).cast("array<struct<gap:int,size:int,deciding:int>>"))
    findings, entries = scan(df, ledger)
    got = {r.doc_id: spans(r) for r in findings.collect()}
    assert got == {k: plain(t) for k, t in enumerate(TEXTS)} and entries.count() == 0
    scanned = L._scan(df, ledger, RULES, "doc_id", "text")
    assert scanned.open.count() == 0
    try:
        L._scan(df, None, RULES, "doc_id", "text")
        raise AssertionError("without a ledger the hints are tried")
    except Exception as e:
        assert "a hint was tried" in str(e)


@pytest.mark.parametrize("known", [0, 1 << 17])
def test_only_the_changed_rule_is_tried(spark, tmp_path, monkeypatch, known):
    import granary.llm.secret_ledger as L

    monkeypatch.setattr(L, "_KNOWN", known)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    scan(df)[1].write.parquet(str(tmp_path / "ledger"))
    ledger = spark.read.parquet(str(tmp_path / "ledger"))
    changed = tuple(replace(r, version=2) if r.kind == "hex" else r for r in RULES)
    whole = L._pieces
    monkeypatch.setattr(L, "_pieces", lambda rule, text: whole(rule, text) if rule.kind == "hex" else F.raise_error(F.lit("a known rule was matched")).cast("array<struct<gap:int,size:int,deciding:int>>"))
    findings, entries = scan(df, ledger, changed)
    assert {r.doc_id: spans(r) for r in findings.collect()} == {k: plain(t) for k, t in enumerate(TEXTS)}
    assert {r.rule for r in entries.collect()} == {"hex@2"}


def test_pairs_that_the_filter_mistakes_are_scanned(spark, tmp_path, monkeypatch):
    """A filter that takes everything for known: all that is new comes by the second read."""
    import granary.llm.secret_ledger as L
    from granary.operators.filters import Bloom

    monkeypatch.setattr(L, "_KNOWN", 0)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    ledger = scan(df.where("doc_id < 7"))[1].cache()
    whole = Bloom.maybe
    monkeypatch.setattr(Bloom, "maybe", lambda self, *key: whole(self, *key) | F.lit(True))
    findings, entries = L.scan(df, ledger)
    assert {r.doc_id: spans(r) for r in findings.collect()} == {k: plain(t) for k, t in enumerate(TEXTS)}
    assert entries.count() == len(RULES) * (len({t or "" for t in TEXTS}) - len({t or "" for t in TEXTS[:7]}))


def test_redaction_with_a_ledger(spark, tmp_path):
    df, path = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), str(tmp_path / "ledger")
    want = sorted(map(tuple, redact(df).collect()))
    assert sorted(map(tuple, redact(df.where("doc_id < 9"), ledger_path=path).collect())) == [r for r in want if r[0] < 9]
    assert sorted(map(tuple, redact(df, ledger_path=path).collect())) == want
    assert sorted(map(tuple, redact(df, ledger_path=path).collect())) == want
    ledger = spark.read.parquet(path)
    assert ledger.count() == ledger.select("blob", "rule").distinct().count() == len(RULES) * len({t or "" for t in TEXTS})


def test_redaction(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    findings, _ = scan(df)
    rows = findings.join(df, "doc_id").select("doc_id", redacted(F.coalesce("text", F.lit("")), F.col("spans")).alias("t")).collect()
    for r in rows:
        text, out, at = TEXTS[r.doc_id] or "", [], 0
        for start, _, end, _ in plain(text):
            if end <= at:
                continue
            if start >= at:
                out.append(text[at:start] + "[secret]")
            at = end
        assert r.t == "".join(out) + text[at:]
        assert not plain(r.t, BASE_RULES)


def test_repeated_ledger_rows_and_other_rule_orders(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    _, entries = scan(df, rules=RULES[::-1])
    ledger = entries.unionByName(entries).cache()
    findings, fresh = scan(df, ledger)
    assert {r.doc_id: spans(r) for r in findings.collect()} == {k: plain(t) for k, t in enumerate(TEXTS)}
    assert fresh.count() == 0


def test_increments_equal_one_scan(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    parts = [df.where("doc_id < 5"), df.where("doc_id < 9"), df]
    got = scan_increments(parts, str(tmp_path / "ledger"))
    assert {r.doc_id: spans(r) for r in got.collect()} == {k: plain(t) for k, t in enumerate(TEXTS)}
    ledger = spark.read.parquet(str(tmp_path / "ledger"))
    assert ledger.count() == ledger.select("blob", "rule").distinct().count() == len(RULES) * len({t or "" for t in TEXTS[:9]})


def test_many_matches_in_one_text_and_many_copies(spark):
    long = "token: abcdef " * 20_000
    rows = spark.createDataFrame([(0, long)], "doc_id long, text string").unionByName(spark.range(1, 3000).select(F.col("id").alias("doc_id"), F.lit("password=hunter22").alias("text")))
    got = scan(rows)[0].select("doc_id", F.size("spans").alias("n"))
    assert got.where("doc_id = 0").first().n == 20_000 and got.where("n = 1").count() == 2999
    masked = redact(rows).where("doc_id = 0").first()
    assert masked.redacted and masked.text == "[secret] " * 20_000


def test_odd_rows(odd_docs, no_docs):
    rows = scan(odd_docs)[0].collect()
    assert len(rows) == odd_docs.count()
    assert [s.kind for r in rows if r.doc_id == 1 for s in r.spans] == ["assign"]
    assert scan(no_docs)[0].count() == 0 and scan(no_docs)[1].count() == 0
    assert scan(odd_docs, scan(no_docs)[1])[0].count() == odd_docs.count()
    masked = redact(odd_docs)
    assert masked.columns == [*odd_docs.columns, "redacted"] and masked.count() == odd_docs.count()
    assert [r.doc_id for r in masked.where("redacted").collect()] == [1] and redact(no_docs).count() == 0


def test_main_path_has_no_python(odd_docs):
    for plan in (df._jdf.queryExecution().executedPlan().toString() for df in scan(odd_docs)):
        assert not re.search("Python|Pandas|Arrow", plan)
