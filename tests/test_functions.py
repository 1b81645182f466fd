from __future__ import annotations

import hashlib
import json
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import text as X
from granary.functions import tokens as K


def one(spark, column, *values, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], schema).select(column).collect()]


def test_strip_takes_exactly_python_white_space(spark):
    every = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c,) for c in every], "v string").where(X.is_blank(F.col("v"))).collect()
    assert {r.v for r in rows} == {c for c in every if c.isspace()}


def test_strip_and_words(spark):
    text = "\u2003 a\u00a0 b\x1c\n"
    assert one(spark, X.strip(F.col("v")), text) == [text.strip()]
    assert one(spark, X.lstrip(F.col("v")), text) == [text.lstrip()]
    assert one(spark, X.words(F.col("v")), text, None, "") == [text.split(), [], []]


def test_bidi_is_removed_from_values_at_any_depth_and_not_from_keys(spark):
    mark = "\u202e"
    assert one(spark, X.clean_bidi(F.col("v")), f"a{mark}b\u200f", None) == ["ab", None]
    assert one(spark, X.was_cleaned(F.col("v")), f"a{mark}", "a", None) == [True, False, False]
    kind = T.StructType.fromDDL("a string, b array<struct<c:string,d:int>>, m map<string,string>")
    row = spark.createDataFrame([((f"x{mark}", [(f"y{mark}", 1)], {f"k{mark}": f"z{mark}"}),)], T.StructType([T.StructField("v", kind)]))
    got = row.select(X.clean_value(F.col("v"), kind).alias("v")).first().v
    assert (got.a, got.b[0].c, got.b[0].d, got.m) == ("x", "y", 1, {f"k{mark}": "z"})
    line = json.dumps({f"k{mark}": [f"v{mark}", 1, None]})
    value, changed = one(spark, X.canonical_json_exact(F.col("v")), line)[0]
    assert json.loads(value) == {f"k{mark}": ["v", 1, None]} and changed


def test_canonical_json(spark):
    lines = ['{"b":1,"a":{"d":[1, 2],"c":"é"}}', '{"a":{"c":"é","d":[1,2]}, "b":1}', "null", "[1,2]", '"x"', "{", ""]
    got = one(spark, X.canonical_json(F.col("v")), *lines)
    assert got[0] == got[1] == '{"a":{"c":"é","d":[1,2]},"b":1}' and got[2:] == ["null", "[1,2]", '"x"', None, None]
    exact = [r and r.value for r in one(spark, X.canonical_json_exact(F.col("v")), *lines, "1.0", "1")]
    assert exact == [*got, "1.0", "1"]


@pytest.mark.parametrize("algorithm", ["md5", "sha1", "sha224", "sha512", "sha3_256", "blake2b"])
def test_hashes(spark, algorithm):
    assert one(spark, X.content_hash(F.col("v"), algorithm), "é", None) == [hashlib.new(algorithm, "é".encode()).hexdigest(), None]


def test_an_unknown_hash_fails_at_once():
    with pytest.raises(ValueError):
        X.content_hash(F.lit("x"), "no_such_hash")


def ints(spark, column, *values):
    return one(spark, column, *values, schema="v array<int>")


def test_pad_head_wrap(spark):
    v = F.col("v")
    assert ints(spark, K.pad_to(v, 3), [7], [7, 8, 9], [1, 2, 3, 4]) == [[7, K.PAD, K.PAD], [7, 8, 9], [1, 2, 3, 4]]
    assert ints(spark, K.head(v, 2), [1, 2, 3], []) == [[1, 2], []]
    assert ints(spark, K.wrap(v), [9]) == [[K.BOS, 9, K.EOS]]


def test_shifted_targets_at_the_block_length(spark):
    P = K.PAD
    for n, inputs, targets in ((2, [10, P, P, P], [11, P, P, P]), (3, [10, 11, P, P], [11, 12, P, P]), (4, [10, 11, 12, P], [11, 12, 13, P]), (5, [10, 11, 12, 13], [11, 12, 13, 14])):
        start = K.crop_start(F.col("v"), 4, 1, F.lit(5))
        x, y = K.training_pair(F.col("v"), 4, start)
        row = spark.createDataFrame([(list(range(10, 10 + n)),)], "v array<int>").select(start.alias("s"), x.alias("x"), y.alias("y")).first()
        assert (row.s, row.x, row.y) == (0, inputs, targets)


def test_crop_starts_cover_all_places(spark):
    rows = spark.range(200).select(K.crop_start(F.array_repeat(F.lit(1), 10), 4, 3, F.col("id")).alias("s")).collect()
    assert {r.s for r in rows} == set(range(6))


def test_chat_ids_and_mask(spark):
    messages = [("system", "s"), ("user", "a b"), ("assistant", "c"), ("user", None)]
    df = spark.createDataFrame([(messages,)], "m array<struct<role:string,content:string>>")
    ids, mask = K.chat_ids(F.col("m"), K.each(lambda c: F.transform(F.split(c, " "), lambda w: F.ascii(w))))
    row = df.select(ids.alias("i"), mask.alias("k")).first()
    assert row.i == [K.BOS, K.USER, 97, 98, K.EOS, K.BOT, 99, K.EOS]
    assert row.k == [0, 0, 0, 0, 0, 1, 1, 1]


def test_chat_example_at_the_block_length(spark):
    P = K.PAD
    cases = (
        (3, [10, 11, P, P], [11, 12, P, P], [1, 0, 0, 0]), (4, [10, 11, 12, P], [11, 12, 13, P], [1, 0, 1, 0]),
        (5, [10, 11, 12, 13], [11, 12, 13, 14], [1, 0, 1, 0]), (6, [10, 11, 12, 13], [11, 12, 13, 14], [1, 0, 1, 0]),
    )
    for n, inputs, targets, mask in cases:
        arrays = K.chat_example(F.col("v"), F.col("m"), 4)
        row = spark.createDataFrame([(list(range(10, 10 + n)), [i % 2 for i in range(n)])], "v array<int>, m array<int>").select(F.array(*arrays).alias("a")).first()
        assert row.a == [inputs, targets, mask]


def test_sentencepiece_round_trip(spark):
    pytest.importorskip("public_tokenizers")
    from granary.plans.registry import _piece_model

    texts = ["The quick brown fox.", "", "naïve 你好"]
    df = spark.createDataFrame([(t,) for t in texts], "v string").select("v", K.sentencepiece_ids(F.col("v"), _piece_model).alias("i"))
    rows = df.select("v", "i", K.sentencepiece_text(F.col("i"), _piece_model).alias("t")).collect()
    assert [r.t for r in rows] == texts and rows[1].i == []


def test_pieces_of_each_text_keep_their_rows(spark):
    public_tokenizers, sentencepiece = pytest.importorskip("public_tokenizers"), pytest.importorskip("sentencepiece")
    from granary.plans.registry import _piece_model

    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = [["a b", "", "naïve 你好"], [], None, [None, "x"], ["word " * 3000]]
    df = spark.createDataFrame(list(enumerate(rows)), "k int, t array<string>").coalesce(1)
    got = {r.k: r.i for r in df.select("k", K.sentencepiece_ids_of_each(F.col("t"), _piece_model).alias("i")).collect()}
    assert got == {k: None if ts is None else [p.encode(t or "") for t in ts] for k, ts in enumerate(rows)}
    tokens = K.sentencepiece_chat_tokens(_piece_model, "<0x01>", "<bot>")
    assert (tokens.bos, tokens.eos, tokens.user, tokens.bot) == (1, 2, p.piece_to_id("<0x01>"), p.unk_id()) and tokens.pad == p.unk_id()


def test_pieces_are_encoded_a_bounded_number_of_bytes_at_a_time(spark):
    public_tokenizers, sentencepiece = pytest.importorskip("public_tokenizers"), pytest.importorskip("sentencepiece")

    def model():
        import public_tokenizers
        import sentencepiece

        kind = sentencepiece.SentencePieceProcessor
        if not hasattr(kind, "plain_encode"):
            kind.plain_encode = kind.encode

        def counted(self, texts, **more):
            assert len(texts) == 1 or sum(len(t.encode()) for t in texts) <= 1 << 20
            return self.plain_encode(texts, **more)

        kind.encode = counted
        return public_tokenizers.path("piece_bpe_32k.model")

    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    df = spark.range(600).coalesce(1).select("id", F.when(F.col("id") % 9 > 0, F.repeat(F.concat(F.lit("añb "), F.col("id")), 1000)).alias("t"))
    df = df.select("id", K.sentencepiece_ids(F.col("t"), model).alias("a"), K.sentencepiece_ids_of_each(F.array("t", F.lit("x")), model).alias("b"))
    rows = df.select("id", F.size("a").alias("n"), F.element_at("b", 1).alias("same"), "a", F.element_at("b", 2).alias("x")).where(F.col("id").isin(0, 1, 598)).collect()
    for r in rows:
        want = p.encode("" if r.id % 9 == 0 else f"añb {r.id}" * 1000)
        assert r.a == want and r.same == want and r.x == p.encode("x")
    assert len(rows) == 3 and df.where(F.size("a") > 0).count() == sum(i % 9 > 0 for i in range(600))


def test_chat_examples_pieces_equal_plain_python(spark):
    public_tokenizers, sentencepiece = pytest.importorskip("public_tokenizers"), pytest.importorskip("sentencepiece")
    import hashlib

    from granary.plans.registry import QUERIES

    sf, block = "/root/testdata/sf0.001", 256
    p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    said = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        said.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    want, digest = {}, lambda xs: hashlib.md5(",".join(map(str, xs)).encode()).hexdigest()
    for conv, rows in said.items():
        ids, mask = [p.bos_id()], [0]
        for _, role, text in sorted(rows):
            if role in ("user", "assistant"):
                own = [p.piece_to_id("<0x01>" if role == "user" else "<0x02>"), *p.encode(text), p.eos_id()]
                ids += own
                mask += [int(role == "assistant")] * len(own)
        if len(ids) < 2:
            continue
        x, y, k = (ids[:block], ids[1 : block + 1], mask[1 : block + 1]) if len(ids) > block else (ids[:-1], ids[1:], mask[1:])
        fill = lambda a, v: a + [v] * (block - len(a))
        want[conv] = (len(ids), sum(k), digest(fill(x, p.unk_id())), digest(fill(y, p.unk_id())), digest(fill(k, 0)))
    got = {r.conv_id: (r.n_ids, r.n_loss, r.input_md5, r.target_md5, r.mask_md5) for r in QUERIES["chat_examples_pieces"](spark, sf).collect()}
    assert got == want and len(want) > 5


def test_texts_of_one_long_row_are_encoded_a_bounded_number_of_bytes_at_a_time():
    pa = pytest.importorskip("pyarrow")
    calls = []

    class Processor:
        def encode(self, texts, num_threads):
            calls.append(sum(len(t.encode()) for t in texts))
            return [[len(t)] * 2 for t in texts]

    texts = ["añ" * (i % 700) if i % 9 else None for i in range(6000)]
    assert K._encoded(Processor(), pa.array(texts)).to_pylist() == [[len(t or "")] * 2 for t in texts]
    assert len(calls) > 3 and max(calls) <= 1 << 20
    assert K._encoded(Processor(), pa.array([], pa.string())).to_pylist() == []
    assert K._encoded(Processor(), pa.array(["é" * (1 << 20), "b"])).to_pylist() == [[1 << 20] * 2, [1] * 2]


def test_chat_examples_pieces_encode_each_message_once(spark, tmp_path):
    pytest.importorskip("public_tokenizers"), pytest.importorskip("sentencepiece")
    from granary.plans.registry import QUERIES

    rows = [(1, 0, "user", "a b"), (1, 1, "assistant", "c"), (2, 0, "system", "x"), (3, 0, "user", None), (3, 1, None, "y"), (4, 0, "user", None), (4, 1, "assistant", ""), (None, 0, "user", "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    df = QUERIES["chat_examples_pieces"](spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    got = {r.conv_id: (r.n_ids > 2, r.n_loss) for r in df.collect()}
    assert got.keys() == {1, 4, None} and got[4] == (True, 2) and got[None] == (True, 0)


def test_python_versions_agree():
    assert sys.version_info >= (3, 10)


def test_a_worker_gives_memory_back_after_the_last_batch(monkeypatch):
    from granary.functions import batches

    seen = []
    monkeypatch.setattr(batches, "give_back", lambda: seen.append("back"))
    run = batches.tidy(lambda rows: (seen.append(r) or r for r in rows))
    assert list(run(iter([1, 2]))) == [1, 2] and seen == [1, 2, "back"]
