from __future__ import annotations

import math
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from granary.operators import chat, dedup, metrics, ordering, sampling


def test_positions_are_dense_and_ordered(spark):
    df = spark.range(1000).select((F.lit(999) - F.col("id")).alias("k"))
    rows = ordering.positions(df, [F.col("k")], start=5).collect()
    assert sorted((r.k, r.position) for r in rows) == [(k, k + 5) for k in range(1000)]
    assert ordering.positions(df.where("k < 0"), [F.col("k")]).count() == 0


def test_row_ids_refuse_an_existing_column(spark):
    with pytest.raises(ValueError):
        ordering.row_ids(spark.range(3), [F.col("id")], "id")
    assert ordering.row_ids(spark.range(3), [F.col("id")]).columns == ["doc_id", "id"]


def test_shuffles_are_permutations_and_rerun_alike(spark):
    df = spark.range(300)
    a = {r.id: r.position for r in ordering.shuffled(df, ["id"]).collect()}
    assert sorted(a.values()) == list(range(300)) and a != {k: k for k in range(300)}
    assert a == {r.id: r.position for r in ordering.shuffled(df.repartition(7), ["id"]).collect()}
    b = {r.id: r.position for r in ordering.buffered_shuffle(df, [F.col("id")], ["id"], 32).collect()}
    assert sorted(b.values()) == list(range(300)) and all(k // 32 == v // 32 for k, v in b.items())


def test_holdout_of_a_small_table_is_all_validation(spark):
    df = ordering.positions(spark.range(10), [F.col("id")])
    count = lambda size: {r.split: r["count"] for r in ordering.holdout(df, size, 10).groupBy("split").count().collect()}
    assert count(10) == {"valid": 10} and count(3) == {"train": 7, "valid": 3}


def test_ratio_bounds():
    assert ordering.ratio_bounds(1000, (0.6, 0.25, 0.15)) == (600, 850)
    assert ordering.ratio_bounds(1000, (6, 2.5, 1.5)) == (600, 850)
    assert ordering.ratio_bounds(0, (0.6, 0.25, 0.15)) == (0, 0)


@pytest.mark.parametrize(
    "total, sizes",
    [(100, (0, 25, 15, 60)), (1000, (0, 250, 150, 600)), (16_666, (0, 4166, 2499, 10_000)), (40_001, (14_000, 10_000, 6000, 10_000))],
)
def test_sequential_sizes(spark, total, sizes):
    df = spark.range(total).withColumnRenamed("id", "position")
    got = {r.split: r["count"] for r in ordering.sequential_split(df, total).groupBy("split").count().collect()}
    assert tuple(got.get(k, 0) for k in ("train", "second", "third", "extra")) == sizes


def test_batches_and_latest(spark):
    df = spark.range(10).withColumnRenamed("id", "position")
    rows = {r.position: (r.batch, r.group) for r in ordering.batches(df, 3, skip=1, accumulate=2).collect()}
    assert rows == {p: (p // 3, p // 6) for p in range(3, 10)}
    assert sorted(r.position for r in ordering.latest(df, 2, F.col("position"), F.col("position")).collect()) == [8, 9]
    assert ordering.progress_total(100, 2, 8, 5) == 5


def test_exact_dedup_keeps_the_first(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "id int, t string")
    assert sorted(r.id for r in dedup.exact_dedup(df, F.md5("t"), [F.col("id")]).collect()) == [1, 2]


def test_exact_dedup_of_repeated_rows_and_shared_keys(spark):
    rows = [(1, "A"), (1, "B"), (0, "B"), (2, "C"), (2, "C"), (None, "D"), (None, "E"), (3, None), (4, None)]
    df = spark.createDataFrame(rows, "hash int, `at.row` string")
    got = dedup.exact_dedup(df, F.md5(F.col("`at.row`")), [F.col("hash")])
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "A"), (0, "B"), (2, "C"), (None, "D"), (None, "E"), (3, None)], key=str)
    assert dedup.exact_dedup(df.limit(0), F.md5(F.col("`at.row`")), [F.col("hash")]).count() == 0
    maps = spark.createDataFrame([(2, {"a": 1}), (1, {"b": 2})], "id int, m map<string,int>")
    assert [r.id for r in dedup.exact_dedup(maps, F.lit("x"), [F.col("id")]).collect()] == [1]


def test_signatures_equal_plain_arithmetic(spark):
    rng = random.Random(4)
    sets = [sorted({rng.randrange(dedup.MODULUS) for _ in range(n)}) for n in (0, 1, 700, 3, 0, 1500, 511, 2)]
    df = spark.createDataFrame(list(enumerate(sets)), "doc_id long, hashes array<long>").unionByName(spark.createDataFrame([(99, None)], "doc_id long, hashes array<long>"))
    a, b = dedup.permutations()
    for r in dedup.signatures(df).collect():
        hashes = sets[r.doc_id] if r.doc_id < 99 else []
        assert r.signature == [min([(x * h + y) % dedup.MODULUS for h in hashes], default=dedup.MODULUS) for x, y in zip(a, b, strict=True)]


def test_signature_store_equals_signatures_of_word_hashes(spark):
    texts = [None, "", " \u00a0\u3000", "a b a\u2003c", "c\x1cb\x85a", "\u200b x", "é\U0001f600 é"] + [" ".join(f"w{k * j}" for k in range(900)) for j in (1, 3)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    store = {r.doc_id: r for r in dedup.signature_store(df).collect()}
    assert {k: r.signature for k, r in store.items()} == {r.doc_id: r.signature for r in dedup.signatures(dedup.word_hashes(df)).collect()}
    assert len({store[k].digest for k in (0, 1, 2)}) == 1 and store[3].digest == store[4].digest != store[5].digest


def test_remembered_words_are_bounded_within_a_text():
    hashes = dedup.WordHashes(limit=100)
    words = [f"w{k}" for k in range(1000)]
    for text in (" ".join(words), "w1 w999 w5", None):
        assert hashes.of(text).tolist() == sorted({int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dedup.MODULUS for w in (text or "").split()})
        assert len(hashes) <= 100 and len(hashes.old) <= 100


def test_positions_by_key_equal_positions(spark):
    df = spark.range(200).select(F.col("id").alias("k"), F.pmod(F.col("id") * 7, F.lit(50)).alias("v"), F.lit("wide").alias("text"))
    order = [F.col("v"), F.col("k")]
    plain, keyed = (sorted(map(tuple, ordering.positions(df, order, key=key).collect())) for key in (None, ["k"]))
    assert plain == keyed and ordering.positions(df, order, key=["k"]).columns == ["k", "v", "text", "position"]


def test_no_text_is_lost_with_its_id(spark):
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (6, "x y z"), (None, "u v"), (None, "v u"), (6, "z y x")], "doc_id long, text string")
    kept = dedup.near_dedup(df)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [5, 6, None]
    assert {r.text for r in dedup.semi_join(df, kept).collect()} >= {"a b c", "x y z"}
    three = df.limit(3)
    assert sorted(map(tuple, dedup.semi_join(three, dedup.near_dedup(three)).collect())) == [(5, "a b c"), (6, "x y z")]
    rows = dedup.near_dedup_rows(df.coalesce(1))
    assert rows.columns == df.columns and sorted(r.text for r in rows.collect()) == ["a b c", "u v", "x y z"]
    assert dedup.near_dedup_rows(df.limit(0)).count() == 0


def test_exact_dedup_moves_no_whole_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(500).select("id", (F.col("id") % 200).alias("k"), F.repeat(F.lit("wide"), 50).alias("text")).write.parquet(path)
    kept = dedup.exact_dedup(spark.read.parquet(path), F.md5(F.col("k").cast("string")), [F.col("id")], from_files=True)
    assert sorted(r.id for r in kept.select("id").collect()) == list(range(200))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "LeftAnti" in plan


def test_near_dedup_of_one_id_with_several_texts(spark):
    rows = [(1, "a b c"), (1, "x y z"), (2, "c b a"), (None, "u v")]
    assert sorted((r.doc_id for r in dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str) == [1, None]


def test_greedy_keeps_what_is_near_a_dropped_row_only(spark):
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id long")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "low long, high long")
    assert sorted(r.doc_id for r in dedup.resolve_greedily(nodes, pairs).collect()) == [1, 3, 4]


def test_greedy_equals_the_loop_on_random_graphs(spark):
    for seed in range(3):
        rng = random.Random(seed)
        pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(60)}
        kept = []
        for x in range(40):
            if not any((k, x) in pairs for k in kept):
                kept.append(x)
        got = dedup.resolve_greedily(spark.range(40).withColumnRenamed("id", "doc_id"), spark.createDataFrame(list(pairs), "low long, high long"))
        assert sorted(r.doc_id for r in got.collect()) == kept


def test_buckets_resolve_like_their_pairs(spark):
    for seed in range(3):
        rng = random.Random(seed)
        banded = spark.createDataFrame(list({(rng.randrange(40), b, str(rng.randrange(25))) for b in range(3) for _ in range(30)}), "doc_id long, band int, key string")
        nodes = banded.select("doc_id").distinct()
        by_pairs = dedup.resolve_greedily(nodes, dedup.near_pairs(banded))
        by_buckets = nodes.join(dedup.resolve_buckets(banded), "doc_id", "left_anti")
        assert sorted(r.doc_id for r in by_pairs.collect()) == sorted(r.doc_id for r in by_buckets.collect())


def test_near_dedup_of_blank_null_and_repeated_texts(spark):
    rows = [(1, None), (2, " "), (3, "a b c"), (4, "c b a"), (5, "x y z"), (6, "")]
    assert sorted(r.doc_id for r in dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()) == [1, 3, 5]


def test_near_dedup_is_idempotent(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = []
    for k in range(60):
        words = list(base) if k % 3 == 0 else [f"v{rng.randrange(5000)}" for _ in range(200)]
        words[rng.randrange(200)] = f"u{k}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = dedup.near_dedup(df)
    once = sorted(r.doc_id for r in kept.collect())
    assert 40 <= len(once) < 60
    assert sorted(r.doc_id for r in dedup.near_dedup(dedup.semi_join(df, kept)).collect()) == once


def lines(spark, *values):
    return spark.createDataFrame([("f", v) for v in values], "file string, line string")


def test_records_to_messages(spark):
    df = lines(
        spark, '{"prompt":"p","response":"r","conversation":[{"human":"h"}]}', '{"conversation":[{"assistant":"a","human":"h"},{"assistant":"b"},7]}',
        '{"conversation":[]}', '{"conversation":"x"}', "[1]", "null", "{", '{"prompt":"p"}',
    )
    got = [[(m.role, m.content) for m in r.messages] for r in chat.records_to_messages(df).collect()]
    assert got == [[("user", "p"), ("assistant", "r")], [("user", "h"), ("assistant", "a"), ("assistant", "b")]]
    other = chat.records_to_messages(lines(spark, '{"conversation":[{"human":["x"],"assistant":{"a":1}},{"human":5,"assistant":"ok"},{"human":null}]}', '{"prompt":["p"],"response":"r"}')).collect()
    assert [[(m.role, m.content) for m in r.messages] for r in other] == [[("user", None), ("assistant", None), ("user", None), ("assistant", "ok"), ("user", None)], [("user", None), ("assistant", "r")]]
    named = chat.records_to_messages(lines(spark, '{"conversation":[{"q":"1","a":"2"}]}'), "q", "a").collect()
    assert [(m.role, m.content) for m in named[0].messages] == [("user", "1"), ("assistant", "2")]


def test_turn_rows_strip_and_fill(spark):
    df = lines(spark, '{"conversation":[{"human":" h\\u00a0","assistant":null},{"assistant":"a"},5,{}]}', '{"conversation":3}', "x")
    assert [(r.human, r.assistant) for r in chat.turns_to_rows(df).collect()] == [("h", ""), ("", "a"), ("", "")]


def test_nest_flat_and_pairs(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", " a "), (1, 0, "system", "s"), (1, 3, "user", "c")]
    nested = chat.nest(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [(r.position, r.role) for r in chat.flat(nested).orderBy("position").collect()] == [(0, "system"), (1, "user"), (2, "assistant"), (3, "user")]
    assert [tuple(p) for p in nested.select(chat.paired(F.col("messages")).alias("p")).first().p] == [("a", "b"), ("c", "")]


def test_metrics(spark):
    df = spark.range(10).select(F.col("id").alias("step"), F.col("id").cast("double").alias("loss"))
    assert [(r.interval, r.mean_loss) for r in metrics.interval_means(df, "step", "loss", 4, 2).orderBy("interval").collect()] == [(0, 3.0), (1, 11.0)]
    assert [r.total_loss for r in metrics.accumulated(df, "step", "loss", 5).orderBy("group").collect()] == [10.0, 35.0]
    best = metrics.running_best(spark.createDataFrame([(0, 3.0), (1, 4.0), (2, 2.0)], "s int, v double"), ["s"], "v", [])
    assert [r.improved for r in best.orderBy("s").collect()] == [True, False, True]
    assert df.agg(metrics.masked_mean(F.col("loss"), (F.col("step") < 2).cast("int"))).first()[0] == pytest.approx(0.5)
    assert metrics.evaluation(df, "loss").first().perplexity == pytest.approx(math.exp(4.5))
    rates = [r[0] for r in spark.range(100).select(metrics.one_cycle(F.col("id"), 100, 1.0)).collect()]
    assert rates[0] == pytest.approx(0.04) and max(rates) == pytest.approx(1.0) and rates[-1] == pytest.approx(4e-6)


def test_sampling(spark):
    df = spark.createDataFrame([(0, t, v) for t, v in enumerate([3.0, 2.0, 2.0, -1.0])], "seq long, token int, logit double")
    tokens = lambda d: sorted(r.token for r in d.collect())
    assert tokens(sampling.top_k(df, 2)) == [0, 1, 2]
    assert tokens(sampling.top_p(df, 0.1)) == [0] and tokens(sampling.top_p(df, 0.98)) == [0, 1, 2]
    seen = spark.createDataFrame([(0, 0), (0, 3), (0, 0)], "seq long, token int")
    assert {r.token: r.logit for r in sampling.penalised(df, seen, 2.0).collect()} == {0: 1.5, 1: 2.0, 2: 2.0, 3: -2.0}
    with pytest.raises(ValueError):
        sampling.with_temperature(df, 0.0)


def test_nulls_in_series_and_samples(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (None, 0, 2.0), (None, 1, 0.0)], "seq long, token int, logit double")
    rows = lambda d: sorted(((r.seq, r.token) for r in d.collect()), key=str)
    assert rows(sampling.top_k(df, 5)) == rows(sampling.top_p(df, 1.0)) == [(0, 0), (None, 0), (None, 1)]
    assert {r.token: r.probability for r in sampling.softmax(df.where("seq = 0")).collect()} == {0: 1.0, 1: None}
    assert sorted((r.seq for r in sampling.draw(df, 1).collect()), key=str) == [0, None] and sampling.draw(df.limit(0), 1).count() == 0
    seen = spark.createDataFrame([(None, 0), (None, 0), (None, None)], "seq long, token int")
    assert sorted(((r.seq, r.token, r.logit) for r in sampling.penalised(df, seen, 2.0).collect()), key=str) == sorted([(0, 0, 1.0), (0, 1, None), (None, 0, 1.0), (None, 1, 0.0)], key=str)
    series = spark.createDataFrame([(0, 1.0), (1, None), (None, 5.0), (None, 6.0)], "step long, loss double")
    assert [(r.interval, r.mean_loss) for r in metrics.interval_means(series, "step", "loss", 2).collect()] == [(0, 0.5)]
    assert [(r.group, r.total_loss) for r in metrics.accumulated(series, "step", "loss", 2).collect()] == [(0, 1.0)]
    best = metrics.running_best(spark.createDataFrame([(0, None), (1, 2.0), (2, None), (3, 1.0)], "s int, v double"), ["s"], "v", [])
    assert [r.improved for r in best.orderBy("s").collect()] == [False, True, False, True]
    assert metrics.interval_means(series.limit(0), "step", "loss", 2).count() == 0
    placed = spark.createDataFrame([(None, [1]), (0, None), (1, [2])], "position long, a array<int>")
    assert [r.a for r in ordering.stacked(ordering.batches(placed, 2), ["a"]).collect()] == [[None, [2]]]
    assert [r.position for r in ordering.latest(placed, 2, F.col("position"), F.size("a")).orderBy("age").collect()] == [1, 0]
    assert chat.flat(spark.createDataFrame([(1, None), (2, []), (3, [(None, None)])], "conv_id long, messages array<struct<role:string,content:string>>")).collect() == [(3, 0, None, None)]
    assert chat.turns_to_rows(lines(spark, "", "[]", '{"a":1}')).count() == 0


def test_draws_follow_the_probabilities(spark):
    df = spark.range(4000).select(F.col("id").alias("seq"), F.explode(F.array(*[F.struct(F.lit(t).alias("token"), F.lit(v).alias("logit")) for t, v in ((0, math.log(0.7)), (1, math.log(0.3)))])).alias("x"))
    share = sampling.draw(df.select("seq", "x.token", "x.logit"), 3).where("token = 0").count() / 4000
    assert abs(share - 0.7) < 0.03
