from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from granary.operators import filters, joins

START = datetime(2024, 1, 1)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def times(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


@pytest.mark.parametrize("width", [7.0, 1000.0, 1e9])
def test_as_of_equals_a_search(spark, width):
    rng = random.Random(1)
    # one key holds a third of the rows; there are ties, nulls, repeated rows
    key = lambda: rng.choice([0, 0, 0, 1, 2, 3, 4, 5, None])
    left = [(key(), rng.choice([None, *range(0, 3000, 3)]), k) for k in range(400)]
    left += left[:5]
    right = [(key(), rng.choice([None, *range(0, 3000, 50)]), rng.randrange(9), k) for k in range(300)]
    l = spark.createDataFrame([(k, times(t), i) for k, t, i in left], "key int, at timestamp, id int")  # noqa: E741
    r = spark.createDataFrame([(k, times(t), p, i) for k, t, p, i in right], "key int, at timestamp, p int, id int")
    for tolerance in (None, 100.0):
        want = []
        for k, t, i in left:
            fits = [x for x in right if k is not None and t is not None and x[0] == k and x[1] is not None and x[1] <= t]
            best = max(fits, key=lambda x: (x[1], x[2], x[3]), default=None)
            if best and tolerance is not None and t - best[1] > tolerance:
                best = None
            want.append((k, times(t), i, best and best[3]))
        got = joins.as_of_join(l, r, ["key"], "at", "at", {"id": "other"}, width, ["p"], tolerance)
        assert got.columns == ["key", "at", "id", "other"] and rows_of(got) == sorted(want, key=repr)
        assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)
    assert joins.as_of_join(l.limit(0), r, ["key"], "at", "at", {"id": "other"}).count() == 0
    assert joins.as_of_join(l, r.limit(0), ["key"], "at", "at", {"id": "other"}).where("other IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        joins.as_of_join(l, r, ["key"], "at", "at", {"id": "id"})


@pytest.mark.parametrize("width", [0.5, 8.0, 1e6])
def test_range_join_equals_comparing_everything(spark, width):
    rng = random.Random(2)
    points = [(rng.choice([1, 1, 2, None]), rng.choice([None, *range(-200, 200)]), k) for k in range(200)]
    ranges = []
    for k in range(120):
        low = rng.randrange(-220, 220)
        ranges.append((rng.choice([1, 1, 2, None]), rng.choice([low, low, low, None]), low + rng.choice([-3, 0, 1, 5, 50, 400]), k))
    p = spark.createDataFrame([(k, None if v is None else float(v), i) for k, v, i in points], "key int, v double, p int")
    r = spark.createDataFrame([(k, None if a is None else float(a), float(b), i) for k, a, b, i in ranges], "key int, a double, b double, r int")
    fits = lambda v, a, b: v is not None and a is not None and a <= v <= b
    keyed = joins.range_join(p, r, "v", "a", "b", width, ["key"])
    assert keyed.columns == ["key", "v", "p", "a", "b", "r"]
    assert rows_of(keyed.select("p", "r")) == sorted([(x[2], y[3]) for x in points for y in ranges if x[0] is not None and x[0] == y[0] and fits(x[1], y[1], y[2])], key=repr)
    free = joins.range_join(p.drop("key"), r.drop("key"), "v", "a", "b", width)
    assert rows_of(free.select("p", "r")) == sorted([(x[2], y[3]) for x in points for y in ranges if fits(x[1], y[1], y[2])], key=repr)
    assert "NestedLoop" not in plan_of(free) and "Cartesian" not in plan_of(free)
    assert joins.range_join(p, r.limit(0), "v", "a", "b", width, ["key"]).count() == 0


@pytest.mark.parametrize("width", [0.5, 8.0, 1e6])
def test_overlap_join_equals_comparing_everything(spark, width):
    rng = random.Random(3)

    def some(n):
        out = []
        for k in range(n):
            low = rng.randrange(-100, 100)
            out.append((rng.choice([1, 1, 2, None]), rng.choice([low, low, low, None]), low + rng.choice([-2, 0, 1, 7, 60, 300]), k))
        return out

    left, right = some(90), some(70)
    l = spark.createDataFrame(left, "key int, a int, b int, l int")  # noqa: E741
    r = spark.createDataFrame(right, "key int, c int, d int, r int")
    want = [(x[3], y[3]) for x in left for y in right if None not in (x[0], x[1], y[1]) and x[0] == y[0] and x[1] <= x[2] and y[1] <= y[2] and x[1] <= y[2] and y[1] <= x[2]]
    got = joins.overlap_join(l, r, ("a", "b"), ("c", "d"), width, ["key"])
    assert rows_of(got.select("l", "r")) == sorted(want, key=repr) and "NestedLoop" not in plan_of(got)


def test_multisets(spark, monkeypatch):
    monkeypatch.setattr(joins, "_CHUNK", 4)
    rng = random.Random(4)
    rows = lambda n: [(rng.choice([None, 1, 2]), rng.choice([None, "a", "b"])) for _ in range(n)]
    a, b = rows(100) + [(7, "x")] * 30, rows(60) + [(7, "x")] * 13
    l, r = (spark.createDataFrame(x, "n_left_ int, `t.x` string") for x in (a, b))  # noqa: E741
    assert Counter(map(tuple, joins.intersect_all(l, r).collect())) == Counter(a) & Counter(b)
    assert Counter(map(tuple, joins.except_all(l, r).collect())) == Counter(a) - Counter(b)
    diff = {tuple(x)[:2]: x.times * (1 if x.change == "added" else -1) for x in joins.table_diff(l, r).collect()}
    ca, cb = Counter(a), Counter(b)
    assert diff == {k: cb[k] - ca[k] for k in ca | cb if cb[k] != ca[k]}
    assert joins.intersect_all(l, r.limit(0)).count() == 0 and joins.except_all(l, r.limit(0)).count() == len(a)
    with pytest.raises(ValueError):
        joins.counted(l, r.withColumn("more", F.lit(1)))


def test_cube_tells_nulls_from_totals(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b"]), rng.choice([None, 1]), rng.choice([None, 1, 2, 3])) for _ in range(90)]
    want = []
    for g in range(4):
        groups = {}
        for a, b, v in rows:
            groups.setdefault((None if g & 2 else a, None if g & 1 else b), []).append(v)
        want += [(*k, g, len(v), len({x for x in v if x is not None})) for k, v in groups.items() if len(v) >= 12]
    df = spark.createDataFrame(rows, "a string, b int, v int")
    assert rows_of(joins.cube_counts(df, ["a", "b"], "v", 12)) == sorted(want, key=repr)
    assert rows_of(joins.cube_counts(df.limit(0), ["a", "b"], "v", 0)) == [(None, None, 3, 0, 0)]


@pytest.mark.parametrize("most, few", [(1, 0), (1 << 18, 0), (1, 1 << 16)])
def test_rows_by_filter_equal_plain_joins(spark, most, few, monkeypatch):
    monkeypatch.setattr(filters, "FEW", few)
    rng = random.Random(6)
    df = spark.createDataFrame([(rng.choice([None, *range(50)]), rng.choice(["a", "b", None]), k) for k in range(600)], "id int, s string, `x.y` int")
    keys = df.where("`x.y` % 7 = 0").select("id", "s")
    listed = {tuple(r) for r in keys.collect()}
    rows = [tuple(r) for r in df.collect()]
    assert rows_of(filters.without(df, ["id", "s"], keys, most)) == sorted([r for r in rows if r[:2] not in listed], key=repr)
    assert rows_of(filters.only(df, ["id", "s"], keys, most)) == sorted([r for r in rows if r[:2] in listed], key=repr)
    numbers = df.where("id % 3 = 0 OR id IS NULL").select("id")
    assert rows_of(filters.without(df, ["id"], numbers, most)) == sorted([r for r in rows if r[0] is not None and r[0] % 3], key=repr)
    assert rows_of(filters.only(df, ["id"], numbers, most)) == sorted([r for r in rows if r[0] is None or r[0] % 3 == 0], key=repr)
    assert filters.without(df, ["id"], keys.limit(0)).columns == df.columns
    assert filters.without(df, ["id"], keys.limit(0)).count() == 600 and filters.only(df, ["id"], keys.limit(0)).count() == 0


def test_a_filter_lets_few_others_pass(spark):
    f = filters.bloom(spark.range(20_000), ["id"])
    passed = f.attach(spark.range(20_000, 60_000), F.col("id")).where(f.maybe(F.col("id"))).count()
    assert passed < 400 and f.attach(spark.range(20_000), F.col("id")).where(f.maybe(F.col("id"))).count() == 20_000
