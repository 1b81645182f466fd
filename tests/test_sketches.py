from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granary.operators import bleu, resume, sketches


def test_merged_sketches_equal_whole_ones(spark):
    df = spark.range(60_000).select((F.col("id") % 3).alias("g"), (F.col("id") % 17_000).alias("v"), (F.col("id") % 7).alias("part"))
    whole = {r.g: r.sketch for r in sketches.distinct_sketch(df, F.col("v"), "g").collect()}
    merged = {r.g: r.sketch for r in sketches.merge_distinct(sketches.distinct_sketch(df, F.col("v"), "g", "part"), "g").collect()}
    assert merged == whole
    total = sketches.merge_distinct(sketches.distinct_sketch(df, F.col("v"), "g", "part"))
    estimate = total.select(sketches.distinct_estimate(F.col("sketch"))).first()[0]
    assert abs(estimate - 17_000) < 3 * 1.04 / 64 * 17_000
    numbers = df.select("g", "part", ((F.col("v") - 5000) / 10).alias("x"))
    assert {r.g: r.sketch for r in sketches.quantile_sketch(numbers, F.col("x"), "g").collect()} == {r.g: r.sketch for r in sketches.merge_quantiles(sketches.quantile_sketch(numbers, F.col("x"), "g", "part"), "g").collect()}


@pytest.mark.parametrize("n", [0, 1, 3, 500, 3000, 9000, 40_000])
def test_distinct_counts_within_the_bound(spark, n):
    df = spark.range(n).select(F.col("id").alias("v")).unionByName(spark.createDataFrame([(None,)] * 3, "v long"))
    estimate = sketches.distinct_sketch(df, F.col("v")).select(sketches.distinct_estimate(F.col("sketch"))).first()[0]
    assert abs(estimate - n) <= max(1, 4 * 1.04 / 64 * n)


def test_quantiles_within_the_bound(spark):
    rng = random.Random(1)
    values = [rng.choice([0.0, -rng.expovariate(0.01), rng.lognormvariate(0, 6), 1e-12]) for _ in range(3001)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "v double")
    sketch = sketches.quantile_sketch(df, F.col("v"))
    for share in (0.0, 0.01, 0.3, 0.5, 0.9, 1.0):
        exact = sorted(values)[max(math.ceil(share * len(values)), 1) - 1]
        got = sketch.select(sketches.quantile(F.col("sketch"), share)).first()[0]
        assert abs(got - exact) <= 1.0001 * sketches.ALPHA * abs(exact) + 2e-9
    assert sketches.quantile_sketch(df.where("v IS NULL"), F.col("v")).select(sketches.quantile(F.col("sketch"), 0.5)).first()[0] is None


def plain_bleu(pairs):
    matches, totals, c, r = [0] * 4, [0] * 4, 0, 0
    for a, b in pairs:
        a, b = (a or "").split(), (b or "").split()
        c, r = c + len(a), r + len(b)
        for n in range(1, 5):
            x, y = (Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) for w in (a, b))
            matches[n - 1] += sum(min(k, y[g]) for g, k in x.items())
            totals[n - 1] += sum(x.values())
    if not c:
        return None
    if not all(matches):
        return 0.0
    return math.exp(sum(math.log(m / t) for m, t in zip(matches, totals, strict=True)) / 4 + min(0, 1 - r / c))


def test_bleu(spark):
    rng = random.Random(2)
    pairs = [("the cat sat on the mat", "the cat sat on the mat"), ("the the the the", "the cat"), (None, "a b"), ("a", None), ("", ""), (None, None)]
    for _ in range(60):
        words = [f"w{rng.randrange(6)}" for _ in range(rng.randrange(1, 30))]
        other = [w if rng.random() < 0.8 else "z" for w in words][: rng.randrange(1, 30)]
        pairs.append((" ".join(words), "　".join(other)))
    df = spark.createDataFrame([(k % 3, a, b) for k, (a, b) in enumerate(pairs)], "g int, a string, b string")
    assert bleu.bleu(df, "a", "b").first().bleu == pytest.approx(plain_bleu(pairs))
    for r in bleu.bleu(df, "a", "b", "g").collect():
        assert r.bleu == pytest.approx(plain_bleu(pairs[r.g :: 3])) and r.n_pairs == len(pairs[r.g :: 3])
    for row in (("x y z v", "x y z v", 1.0), ("x y z v", "x y z v w w w w", math.exp(-1)), ("x y", "x y", 0.0), ("", "x", None)):
        assert bleu.bleu(spark.createDataFrame([row[:2]], "a string, b string"), "a", "b").first().bleu == (row[2] if row[2] is None else pytest.approx(row[2]))
    assert bleu.bleu(df.limit(0), "a", "b", "g").count() == 0


def test_pages(spark, tmp_path):
    path = str(tmp_path / "pages")
    assert resume.load_page(spark, path) == resume.Page()
    page = resume.Page(epoch=1, batch=3, step=9, rows=100, best_loss=0.5, note='é "quoted"\n')
    resume.save_page(spark, page, path)
    assert resume.load_page(spark, path) == page
    files = list((tmp_path / "pages").glob("page=*/part-*"))
    assert len(files) == 1 and files[0].read_text().count("\n") > 5
    later = resume.Page(step=10)
    resume.save_page(spark, later, path)
    (tmp_path / "pages" / "page=000000000011").mkdir()  # a job that hasn't committed
    assert resume.load_page(spark, path) == later


def test_halves_equal_one_run(spark, tmp_path):
    df = spark.range(103).withColumnRenamed("id", "k")

    def run(cuts):
        page, out, path = resume.Page(batch_size=10, seed=5), [], f"{tmp_path}/pages-{len(cuts)}"
        for most in cuts:
            rows, page = resume.next_batches(df, ["k"], page, most)
            out += [(r.epoch, r.batch, r.position, r.k) for r in rows.collect()]
            resume.save_page(spark, page, path)
            page = resume.load_page(spark, path)
        return sorted(out), page

    whole, end = run([11, 11])
    parts, same = run([4, 1, 100, 3, 3, 5])
    assert whole == parts and end == same and end.epoch == 2 and end.step == 22
    assert sorted(k for e, _, _, k in whole if e == 0) == list(range(103)) and [r[3] for r in whole[:103]] != [r[3] for r in whole[103:]]
    with pytest.raises(ValueError):
        resume.next_batches(df.limit(5), ["k"], end, 1)
    rows, page = resume.next_batches(df.limit(0), ["k"], resume.Page(), 1)
    assert rows.count() == 0 and page.epoch == 1
