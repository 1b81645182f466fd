from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from granary.sources import files, sinks
from granary.streaming import ingest


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "n": 1}\n\n   \nnot json\nnull\n[1]\n', encoding="utf-8")
    (tmp_path / "B.JSONL").write_text('{"text": "y", "m": 2}\n', encoding="utf-8")
    (tmp_path / "c.txt").write_text("other\n")
    return str(tmp_path)


def test_patterns(spark, folder):
    name = lambda df: {r.file for r in df.select("file").distinct().collect()}
    assert name(files.read_lines(spark, folder, "*.jsonl")) == {"a.jsonl"}
    assert name(files.read_lines(spark, folder, files.ANY_CASE_JSONL)) == {"a.jsonl", "B.JSONL"}


def test_tolerant_lines_and_counts(spark, folder):
    lines = files.read_lines(spark, folder, files.ANY_CASE_JSONL)
    assert sorted(r.line for r in files.valid_json(lines).collect()) == sorted(['{"text": "x", "n": 1}', "null", "[1]", '{"text": "y", "m": 2}'])
    assert [r.line for r in files.invalid_json(lines).collect()] == ["not json"]
    assert {r.file: (r.raw, r.skipped, r.valid) for r in files.line_statistics(lines).collect()} == {"a.jsonl": (6, 3, 3), "B.JSONL": (1, 0, 1)}
    assert {r.field: r.n_lines for r in files.field_union(files.valid_json(lines)).collect()} == {"text": 2, "n": 1, "m": 1}
    assert [(r.line, r.error) for r in files.quarantined(lines).collect()] == [("not json", "Expecting value: line 1 column 1 (char 0)")]


def test_line_numbers_over_several_splits(spark, tmp_path):
    for name, n in (("a.txt", 5000), ("b.txt", 3)):
        (tmp_path / name).write_text("".join(f"{name} {k}\n" for k in range(1, n + 1)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        lines = files.read_lines(spark, str(tmp_path), blocks=True)
        assert lines.select("block").distinct().count() > 3
        rows = files.numbered(lines).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5003 and all(r.line == f"{r.file} {r.line_no}" for r in rows)


def test_chat_records_and_spaced_lines(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"messages":[{"role":"user","content":"a"},{"role":"user","content":null}]}\n\n{"messages":3}\n')
    got = [r.messages for r in files.chat_records(files.read_lines(spark, str(tmp_path))).collect()]
    assert [[tuple(m) for m in ms] if ms is not None else None for ms in got] == [[("user", "a"), ("user", None)], None]
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "c.jsonl").write_text('{"messages":[{"role":"user","content":["a"]},7,{"role":3,"content":"b"},{"content":{"x":1}}]}\n')
    got = [r.messages for r in files.chat_records(files.read_lines(spark, str(tmp_path / "odd"))).collect()]
    assert [[tuple(m) for m in ms] for ms in got] == [[("user", None), (None, "b"), (None, None)]]
    df = spark.createDataFrame([(1, "é, :", [1, 2], None)], "a int, b string, c array<int>, d string")
    sinks.write_jsonl(sinks.without(df, "d", "none"), f"{tmp_path}/out", spaced=True)
    assert [r.value for r in spark.read.text(f"{tmp_path}/out").collect()] == ['{"a": 1, "b": "é, :", "c": [1, 2]}']


def test_sentencepiece_equals_the_plain_processor(spark):
    public_tokenizers, sentencepiece = pytest.importorskip("public_tokenizers"), pytest.importorskip("sentencepiece")
    from granary.plans.registry import QUERIES

    sf = "/root/testdata/sf0.001"
    processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = processor.encode(r.text)
        want[r.doc_id] = (len(ids), hashlib.md5(",".join(map(str, ids)).encode()).hexdigest())
    assert {r.doc_id: (r.n_ids, r.ids_md5) for r in QUERIES["sentencepiece_tokens"](spark, sf).collect()} == want


def test_no_local_folder_off_this_machine(spark, monkeypatch):
    from granary.plans import session

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

        class conf:
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError, match="all executors share"):
        session.shared_folder(Session)


def test_strict_reads_fail_on_bad_lines(spark, folder):
    lines = files.read_lines(spark, folder, "*.jsonl")
    with pytest.raises(Exception, match="invalid JSON"):
        files.strict_json(lines).collect()
    with pytest.raises(Exception, match="no text"):
        files.text_field(files.valid_json(lines)).collect()
    assert [r.text for r in files.text_field(files.read_lines(spark, folder, "*.JSONL")).collect()] == ["y"]


def test_bad_bytes_and_line_ends(spark, tmp_path):
    (tmp_path / "x.txt").write_bytes(b"a\xffb\r\nc\rd\n")
    assert sorted(r.line for r in files.read_lines(spark, str(tmp_path), drop_bad_bytes=True).collect()) == ["ab", "c", "d"]


def test_jsonl_sink_keeps_nulls_and_text(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, None)], "a int, b string")
    sinks.write_jsonl(df, f"{tmp_path}/out")
    sinks.write_jsonl(df, f"{tmp_path}/out")  # overwrites
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ['{"a":1,"b":"é"}', '{"a":2,"b":null}']


def test_shards_have_exact_sizes(spark, tmp_path):
    df = spark.range(25)
    sinks.write_sharded_jsonl(df, f"{tmp_path}/s", [F.col("id")], 10)
    rows = spark.read.text(f"{tmp_path}/s").collect()
    got = {}
    for r in rows:
        got.setdefault(r.shard, []).append(json.loads(r.value)["id"])
    assert got == {1: list(range(10)), 2: list(range(10, 20)), 3: list(range(20, 25))}


def test_id_lists(spark, tmp_path):
    sinks.write_ids(spark.createDataFrame([(10,), (9,), (10,)], "doc_id long"), f"{tmp_path}/ids")
    (tmp_path / "more.txt").write_text("7\n\n 9 \n")
    assert sorted(r.doc_id for r in files.read_ids(spark, f"{tmp_path}/*").collect()) == [7, 9, 10]


def test_parquet_union_of_columns_and_preview(spark, tmp_path):
    sinks.write_parquet(spark.createDataFrame([(1, "a")], "id int, x string"), f"{tmp_path}/p/k=1")
    sinks.write_parquet(spark.createDataFrame([(2, 5)], "id int, y int"), f"{tmp_path}/p/k=2")
    df = files.read_parquet(spark, f"{tmp_path}/p", ["id", "x", "y"])
    assert sorted(map(tuple, df.collect()), key=str) == [(1, "a", None), (2, None, 5)]
    schema, rows = files.preview(df)
    assert "id:int" in schema and rows.count() == 2


def test_streaming_ingest_drops_repeats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"a":1}\n{"a":1}\nbad\n{"a":2}\n')
    lines = ingest.stream_valid(ingest.stream_lines(spark, f"{tmp_path}/in"))
    query = ingest.to_parquet(ingest.stream_dedup(lines, F.md5("line"), "seen_at", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/cp")
    query.awaitTermination()
    assert sorted(r.line for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ['{"a":1}', '{"a":2}']
