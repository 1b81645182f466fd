from __future__ import annotations

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from granary.llm.mixing import MixSettings, mix_sources, targets
from granary.llm.queries import n_words


def fill(sizes, weights, epochs=3):
    """Targets by sharing what lies above caps again and again."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        share = sum(weights[k] for k in open_)
        over = {k for k in open_ if total * weights[k] / share > epochs * sizes[k] + 1e-9}
        if not over:
            for k in open_:
                out[k] = total * weights[k] / share
            break
        for k in over:
            out[k] = float(epochs * sizes[k])
            total -= out[k]
        open_ -= over
    return out


def test_targets_equal_repeated_sharing(spark):
    rng = random.Random(1)
    for case in ([5], [1, 1, 1], [0, 10], [0], [10, 1, 100, 100, 1, 5, 1000], [rng.randrange(1, 10 ** rng.randrange(1, 6)) for _ in range(40)]):
        names = [f"s{k:03}" for k in range(len(case) - 1)] + [None]
        rows = {r.source: r for r in targets(spark.createDataFrame(list(zip(names, case, strict=True)), "source string, source_size long"), MixSettings()).collect()}
        weights = [(5.0, 2.0, 1.0)[k % 3] for k in range(len(case))]
        assert [rows[n].weight for n in names] == weights
        assert [rows[n].target for n in names] == pytest.approx(fill(case, weights), abs=1e-4)


def docs(spark, n=600, seed=2):
    rng = random.Random(seed)
    rows = [(k, rng.choice(["a", "a", "a", "b", "c", "é", None]), rng.randrange(0, 400)) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, size long")


def test_epochs_budgets_and_reruns(spark):
    df = docs(spark)
    rows = mix_sources(df, F.col("size")).collect()
    assert len(rows) == df.count()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    assert sum(r.size for r in rows) == pytest.approx(sum(v[0].target for v in by.values()))
    for v in by.values():
        size, target = v[0].source_size, v[0].target
        assert sum(r.size for r in v) == size and target <= 3 * size + 1e-6
        whole = int(target // size)
        assert all(r.taken in (whole * r.size, (whole + 1) * r.size) and r.taken <= 3 * r.size for r in v)
        taken = sum(r.taken for r in v)
        assert 0.99 * target <= taken <= target
    again = mix_sources(df.repartition(9), F.col("size"), settings=MixSettings(ranges=7, alone=0)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)
    other = mix_sources(df, F.col("size"), settings=MixSettings(seed="else")).collect()
    assert sorted(map(tuple, other), key=str) != sorted(map(tuple, rows), key=str)


def test_better_documents_are_taken_more_often(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"), F.lit(10).alias("size"), (F.col("id") % 2).alias("good"))
    settings = MixSettings(weights=(1.0, 3.0))
    rows = mix_sources(df, F.col("size"), F.when(F.col("good") == 1, 4.0).otherwise(1.0), settings=settings).where("source = 'a'").collect()
    good = sum(r.taken for r in rows if r.doc_id % 2 == 1) / sum(r.taken for r in rows)
    assert 0.68 < good < 0.82  # half of the documents, with weights 4 to 1


def in_order(rows, budget):
    """Whatever fits, in the order of keys; rows are (key, id, size)."""
    taken, room = set(), budget
    for _, i, size in sorted(rows):
        if 0 < size <= room:
            taken.add(i)
            room -= size
    return taken


def test_nothing_that_is_left_fits(spark):
    rng = random.Random(4)
    # of "a" a long document comes early and shuts out the short ones behind it
    sizes = [(f"a{k}", "a", 10) for k in range(1000)] + [(f"b{k}", "b", int(2 ** rng.uniform(0, 9))) for k in range(400)] + [(f"n{k}", None, rng.randrange(1, 90)) for k in range(200)]
    key = lambda i: -math.log((int(hashlib.md5(f"mix:{i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48)
    early = next(f"x{k}" for k in range(10_000) if key(f"x{k}") < 0.02)
    sizes.append((early, "a", 20_000))
    df = spark.createDataFrame(sizes, "doc_id string, source string, size long")
    for ranges, alone in ((3, 0), (3, 300), (4096, 1 << 16)):
        got = mix_sources(df, F.col("size"), settings=MixSettings(weights=(1.0, 9.0, 1.0), ranges=ranges, alone=alone)).collect()
        for source in ("a", "b", None):
            mine = [r for r in got if r.source == source]
            epochs = int(mine[0].target // mine[0].source_size)
            budget = mine[0].target - epochs * mine[0].source_size
            taken = {r.doc_id for r in mine if r.taken > epochs * r.size}
            assert taken == in_order([(key(r.doc_id), r.doc_id, r.size) for r in mine], budget)
            room = budget - sum(r.size for r in mine if r.doc_id in taken)
            assert room >= 0 and all(r.size > room for r in mine if r.doc_id not in taken)


def test_ties_repeats_and_odd_weights(spark):
    rows = [(1, "a", 5)] * 30 + [(None, "a", 5)] * 10 + [(2, "b", 40)] * 3
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    for weight, alone in ((F.lit(None), 0), (F.lit(0.0), 20), (F.lit(float("nan")), 1000), (F.lit(-1), 1000)):
        got = mix_sources(df, F.col("size"), weight, settings=MixSettings(weights=(1.0, 2.0), alone=alone)).collect()
        assert len(got) == len(rows)
        for source in "ab":
            mine = [r for r in got if r.source == source]
            assert 0 <= mine[0].target - sum(r.taken for r in mine) < max(r.size for r in mine)


def test_one_id_may_hold_a_third_of_all_rows(spark):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("a").alias("source"), (F.col("id") % 5 + 1).alias("size"), F.col("id").alias("own"))
    other = spark.range(10).select((F.col("id") + 10_000).alias("doc_id"), F.lit("b").alias("source"), F.lit(1).alias("size"), F.col("id").alias("own"))
    got = mix_sources(rows.unionByName(other).repartition(5), F.col("size"), settings=MixSettings(weights=(1.0, 1.0), alone=0), carry=("own",)).collect()
    assert sorted(r.own for r in got if r.source == "a") == list(range(6000))
    mine = [r for r in got if r.source == "a"]
    key = lambda i: -math.log((int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48)
    epochs = int(mine[0].target // mine[0].source_size)
    room, want = mine[0].target - epochs * mine[0].source_size, []
    for _, _, i, size in sorted(((key(r.doc_id), r.doc_id is None, r.doc_id, r.size) for r in mine), key=lambda x: (x[0], x[1], x[2] or 0, x[3])):
        if size <= room:
            room -= size
            want.append((i, size))
    assert sorted(((r.doc_id, r.size) for r in mine if r.taken > epochs * r.size), key=str) == sorted(want, key=str)


def test_odd_rows(odd_docs, no_docs):
    got = mix_sources(odd_docs, n_words(F.col("text"))).collect()
    assert len(got) == odd_docs.count() and all(r.taken == 0 for r in got if r.size == 0)
    assert mix_sources(no_docs, n_words(F.col("text"))).count() == 0


def test_word_counts(spark):
    texts = ["", None, " \t\n\r\x0b\x0c", "a", " a  b\n", "a\x0bb\x0cc", "é x y", "a\x1cb"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(n_words(F.col("text"))).collect()]
    assert got == [0, 0, 0, 1, 2, 3, 2, 1]
