"""Queries of joins, set operations, groupings, sketches, BLEU and resumed runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import bleu, joins, resume, sketches
from granary.plans.registry import _SPACE, query, read
from granary.plans.session import scratch

_DAYS = 9000  # between the times of orders and of events


def _seconds(name: str):
    return F.unix_timestamp(F.col(name).cast("timestamp")).alias(name)


@query(
    f"""SELECT event_id, arg_max(o_orderkey, {{'d': o_orderdate, 'k': o_orderkey}}) AS o_orderkey, epoch(max(o_orderdate))::BIGINT AS o_orderdate
FROM events LEFT JOIN orders ON o_custkey = user_id AND o_orderdate <= ts - INTERVAL {_DAYS} DAY GROUP BY 1"""
)
def asof_latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the latest order of its customer before it."""
    events = read(spark, sf_dir, "events").select("event_id", "user_id", F.expr(f"ts - INTERVAL {_DAYS} DAYS").alias("at"))
    take = {"o_orderkey": "o_orderkey", "o_orderdate": "o_orderdate"}
    orders = read(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "user_id")
    joined = joins.as_of_join(events, orders, ["user_id"], "at", "o_orderdate", take, width=30 * 86_400.0, tie=["o_orderkey"])
    return joined.select("event_id", "o_orderkey", _seconds("o_orderdate"))


@query(
    """SELECT e.event_id, p.event_id AS click_id FROM (SELECT * FROM events WHERE event_type <> 'click') e LEFT JOIN LATERAL (
SELECT c.event_id FROM events c WHERE c.event_type = 'click' AND c.user_id = e.user_id AND c.ts <= e.ts AND c.ts >= e.ts - INTERVAL 1 DAY ORDER BY c.ts DESC, c.event_id DESC LIMIT 1) p ON true"""
)
def asof_last_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each other event with its user's latest click, if that is a day old at most."""
    events = read(spark, sf_dir, "events")
    clicks = events.where("event_type = 'click'").select("user_id", "ts", "event_id")
    other = events.where("event_type <> 'click'").select("event_id", "user_id", "ts")
    joined = joins.as_of_join(other, clicks, ["user_id"], "ts", "ts", {"event_id": "click_id"}, width=2 * 86_400.0, tie=["event_id"], tolerance=86_400.0)
    return joined.select("event_id", "click_id")


@query(f"SELECT event_id, o_orderkey FROM events JOIN orders ON o_custkey = user_id AND ts BETWEEN o_orderdate + INTERVAL {_DAYS} DAY AND o_orderdate + INTERVAL {_DAYS + 60} DAY")
def range_order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of each order's customer in the 60 days after it."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id"), F.expr(f"o_orderdate + INTERVAL {_DAYS} DAYS").alias("low"), F.expr(f"o_orderdate + INTERVAL {_DAYS + 60} DAYS").alias("high"))
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return joins.range_join(events, orders, "ts", "low", "high", 60 * 86_400.0, ["user_id"]).select("event_id", "o_orderkey")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_acctbal BETWEEN s_acctbal - abs(s_acctbal) / 500 AND s_acctbal + abs(s_acctbal) / 500")
def range_balance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose balance is within a five-hundredth of a supplier's; no key, ranges of very different lengths."""
    bands = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") - F.abs("s_acctbal") / 500).alias("low"), (F.col("s_acctbal") + F.abs("s_acctbal") / 500).alias("high"))
    return joins.range_join(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), bands, "c_acctbal", "low", "high", 0.5).select("c_custkey", "s_suppkey")


@query(
    """WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate, max(l_shipdate) AS shipped FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
SELECT a.o_orderkey AS earlier, b.o_orderkey AS later FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.o_orderdate <= b.shipped AND b.o_orderdate <= a.shipped
WHERE a.o_orderdate <= a.shipped AND b.o_orderdate <= b.shipped"""
)
def overlap_open_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a customer's orders that were open at the same time, from the order to its last shipment."""
    shipped = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    spans = read(spark, sf_dir, "orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", "o_orderdate", "shipped")
    left, right = (spans.toDF("o_custkey", name, f"{name}_from", f"{name}_to") for name in ("earlier", "later"))
    pairs = joins.overlap_join(left, right, ("earlier_from", "earlier_to"), ("later_from", "later_to"), 30 * 86_400.0, ["o_custkey"])
    return pairs.where("earlier < later").select("earlier", "later")


_SIDE = "SELECT nullif(l_linestatus, 'O') AS status, l_returnflag AS flag, nullif(l_quantity, 7) AS quantity FROM lineitem WHERE l_orderkey % 3 {}"


def _side(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").where(f"l_orderkey % 3 {where}")
    return rows.select(F.expr("nullif(l_linestatus, 'O')").alias("status"), F.col("l_returnflag").alias("flag"), F.expr("nullif(l_quantity, 7)").alias("quantity"))


@query(f"{_SIDE.format('= 0')} INTERSECT ALL {_SIDE.format('> 0')}")
def multiset_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.intersect_all(_side(spark, sf_dir, "= 0"), _side(spark, sf_dir, "> 0"))


@query(f"{_SIDE.format('> 0')} EXCEPT ALL {_SIDE.format('= 0')}")
def multiset_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.except_all(_side(spark, sf_dir, "> 0"), _side(spark, sf_dir, "= 0"))


@query(
    f"""SELECT status, flag, quantity, CASE WHEN n > 0 THEN 'added' ELSE 'removed' END AS change, abs(n)::BIGINT AS times FROM (
SELECT status, flag, quantity, sum(n) AS n FROM (SELECT *, -1 AS n FROM ({_SIDE.format('= 0')}) UNION ALL SELECT *, 1 FROM ({_SIDE.format('= 1')})) GROUP BY ALL) WHERE n <> 0"""
)
def table_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.table_diff(_side(spark, sf_dir, "= 0"), _side(spark, sf_dir, "= 1"))


@query(
    """SELECT lang, source, size, grouping(lang, source, size)::INT AS "grouping", count(*) AS n_rows, count(DISTINCT n_chars) AS n_distinct
FROM (SELECT nullif(lang, 'en') AS lang, nullif(source, 'src1') AS source, length(n_chars::VARCHAR)::INT AS size, nullif(n_chars, 200) AS n_chars FROM documents) GROUP BY CUBE (lang, source, size) HAVING count(*) >= 5"""
)
def cube_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every grouping of documents by language, source and digits of length, with distinct lengths, of five rows or more; keys hold nulls."""
    size = F.length(F.col("n_chars").cast("string")).alias("size")
    docs = read(spark, sf_dir, "documents").select(F.expr("nullif(lang, 'en')").alias("lang"), F.expr("nullif(source, 'src1')").alias("source"), size, F.expr("nullif(n_chars, 200)").alias("n_chars"))
    return joins.cube_counts(docs, ["lang", "source", "size"], "n_chars", least=5)


def _bleu_sql() -> str:
    ws = f"list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '')"
    grams = lambda c: f"SELECT id, turn, n, array_to_string({c}[i:i + n - 1], ' ') AS gram, count(*) AS k FROM (SELECT *, unnest(range(1, len({c}) - n + 2)) AS i FROM p, range(1, 5) t(n)) GROUP BY ALL"
    per = ", ".join(f"coalesce(sum(m) FILTER (n = {n}), 0)::BIGINT AS matches_{n}" for n in range(1, 5)) + ", " + ", ".join(f"coalesce(sum(k) FILTER (n = {n}), 0)::BIGINT AS totals_{n}" for n in range(1, 5))
    share = " + ".join(f"ln(matches_{n} / totals_{n})" for n in range(1, 5))
    names = ", ".join(f"{c}_{n}" for c in ("matches", "totals") for n in range(1, 5))
    return f"""
WITH a AS (SELECT conv_id, turn, {ws} AS c FROM conversations WHERE role = 'assistant'),
p AS MATERIALIZED (SELECT row_number() OVER () AS id, turn, c, r FROM (SELECT turn, c, lead(c) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM a) WHERE r IS NOT NULL),
h AS ({grams("c")}), g AS ({grams("r")}),
m AS (SELECT h.turn, h.n, sum(h.k) AS k, sum(least(h.k, coalesce(g.k, 0))) AS m FROM h LEFT JOIN g ON h.id = g.id AND h.n = g.n AND h.gram = g.gram GROUP BY 1, 2),
s AS (SELECT turn, {per} FROM m GROUP BY 1),
w AS (SELECT turn, count(*) AS n_pairs, sum(len(c))::BIGINT AS candidate_words, sum(len(r))::BIGINT AS reference_words FROM p GROUP BY 1)
SELECT turn, n_pairs, candidate_words, reference_words, {names}, round(CASE WHEN candidate_words = 0 THEN NULL WHEN least(matches_1, matches_2, matches_3, matches_4) = 0 THEN 0
  ELSE exp(({share}) / 4 + CASE WHEN candidate_words < reference_words THEN 1 - reference_words / candidate_words ELSE 0 END) END, 9)::DOUBLE AS bleu FROM w LEFT JOIN s USING (turn)"""


@query(_bleu_sql())
def bleu_of_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How like an assistant's answers are to its next ones in the conversation, by turn."""
    said = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    # answers of a conversation in order; rows of one conversation are few
    answers = said.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("a"))
    next_to = F.arrays_zip(F.slice("a", F.lit(1), F.size("a") - 1).alias("c"), F.slice("a", F.lit(2), F.size("a")).alias("r"))
    pairs = answers.select(F.explode(next_to).alias("p"))
    rows = pairs.select(F.col("p.c.turn").alias("turn"), F.col("p.c.text").alias("candidate"), F.col("p.r.text").alias("reference"))
    scores = bleu.bleu(rows, "candidate", "reference", "turn")
    return scores.withColumn("bleu", F.round("bleu", 9))


_M = 1 << sketches.PRECISION


@query(
    f"""WITH v AS (SELECT event_type, md5((event_id // 3)::VARCHAR) AS h FROM events),
b AS (SELECT event_type, ('0x' || substr(h, 1, 3))::INT AS r, ('0x' || substr(h, 4, 12))::BIGINT AS rest FROM v),
r AS (SELECT event_type, r, max(CASE WHEN rest = 0 THEN 49 ELSE 49 - length(bin(rest)) END) AS k FROM b GROUP BY 1, 2),
s AS (SELECT event_type, {_M} - count(*) AS empty, {0.7213 / (1 + 1.079 / _M) * _M * _M}::DOUBLE / ({_M} - count(*) + sum(pow(2::DOUBLE, -k))) AS raw FROM r GROUP BY 1)
SELECT event_type, round(CASE WHEN raw <= {2.5 * _M} AND empty > 0 THEN {_M} * ln({_M}::DOUBLE / empty) ELSE raw END, 6)::DOUBLE AS estimate FROM s"""
)
def distinct_sketch_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct counts from sketches of thirds of the events, stored and merged."""
    events, path = read(spark, sf_dir, "events"), scratch(spark, "sketches")
    value = F.floor(F.col("event_id") / 3)
    for k in range(3):
        sketches.distinct_sketch(events.where(F.col("user_id") % 3 == k), value, "event_type").write.parquet(f"{path}/part={k}")
    merged = sketches.merge_distinct(spark.read.parquet(path), "event_type")
    return merged.select("event_type", F.round(sketches.distinct_estimate(F.col("sketch")), 6).alias("estimate"))


_BUCKET = "CASE WHEN value IS NULL THEN NULL WHEN abs(value) < 1e-9 THEN 0 ELSE sign(value) * (ceil(round(ln(abs(value) / 1e-9::DOUBLE) / {}::DOUBLE, 9)) + 1) END".format(sketches._STEP)


@query(
    f"""WITH b AS (SELECT event_type, ({_BUCKET})::INT AS b FROM events),
c AS (SELECT event_type, b, sum(count(*)) OVER (PARTITION BY event_type ORDER BY b) AS upto, sum(count(*)) OVER (PARTITION BY event_type) AS n FROM b WHERE b IS NOT NULL GROUP BY 1, 2),
q AS (SELECT event_type, share, min(b) AS b FROM c, (SELECT unnest([0.5::DOUBLE, 0.99::DOUBLE]) AS share) WHERE upto >= greatest(ceil(n * share), 1) GROUP BY 1, 2)
SELECT event_type, share, round(CASE WHEN b = 0 THEN 0 ELSE sign(b) * 2 * pow({sketches._GAMMA}::DOUBLE, abs(b) - 2) * {sketches._GAMMA}::DOUBLE / ({sketches._GAMMA}::DOUBLE + 1) * 1e-9::DOUBLE END, 6)::DOUBLE AS value FROM q"""
)
def quantile_sketch_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and 99th percentiles from sketches of thirds of the events, stored and merged."""
    events, path = read(spark, sf_dir, "events"), scratch(spark, "sketches")
    for k in range(3):
        sketches.quantile_sketch(events.where(F.col("user_id") % 3 == k), F.col("value"), "event_type").write.parquet(f"{path}/part={k}")
    merged = sketches.merge_quantiles(spark.read.parquet(path), "event_type")
    shares = [F.struct(F.lit(s).alias("share"), F.round(sketches.quantile(F.col("sketch"), s), 6).alias("value")) for s in (0.5, 0.99)]
    return merged.select("event_type", F.explode(F.array(*shares)).alias("q")).select("event_type", "q.share", "q.value")


@query(
    """SELECT epoch::INT AS epoch, (p // 16)::BIGINT AS batch, p AS position, doc_id FROM (
SELECT doc_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5('42:' || epoch || ':' || doc_id), doc_id) - 1 AS p FROM documents, range(2) t(epoch)) WHERE epoch = 0 OR p < 48"""
)
def resumed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs, each from the page that the one before has left: seven batches, the rest of the epoch, three of the next one."""
    docs, path, parts = read(spark, sf_dir, "documents").select("doc_id"), scratch(spark, "pages"), []
    for most in (7, 1 << 40, 3):
        rows, page = resume.next_batches(docs, ["doc_id"], resume.load_page(spark, path), most)
        resume.save_page(spark, page, path)
        parts.append(rows.select("epoch", "batch", "position", "doc_id"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
