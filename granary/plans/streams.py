"""Queries of streams: the events arrive in parts, each part is run through to its end, and the next one resumes from the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.plans.registry import query, read
from granary.plans.session import scratch
from granary.streaming import stateful

_KIND = "event_id long, ts timestamp, user_id long, value double, part int"
#: Days in a part; events of a later part are later.
_PART = 6


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number of their part. One in 37 of the first twelve days comes late, in a last part of its own."""
    at = F.col("ts").cast("timestamp")
    part = F.when((F.col("event_id") % 37 == 0) & (F.dayofmonth(at) <= 12), 99).otherwise(F.floor((F.dayofmonth(at) - 1) / _PART)).cast("int")
    return read(spark, sf_dir, "events").select("event_id", at.alias("ts"), "user_id", "value", part.alias("part"))


def _run(rows: DataFrame, stream: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the stream has written after all parts have come in, one after the other, each followed by a restart."""
    spark = rows.sparkSession
    path = scratch(spark, "stream")
    for (part,) in sorted(rows.select("part").distinct().collect()):
        rows.where(F.col("part") == part).write.parquet(f"{path}/in/part-{part:03d}")
        stateful.append(stream(stateful.stream_parquet(spark, f"{path}/in", _KIND, 1 << 20)), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/out")


_PARTS = f"""e AS (SELECT *, CASE WHEN event_id % 37 = 0 AND day(ts) <= 12 THEN 99 ELSE (day(ts) - 1) // {_PART} END AS part FROM events)"""


@query(
    f"""WITH {_PARTS},
g AS (SELECT *, ts - lag(ts) OVER w > INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL AS new FROM e WHERE part < 99 WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
r AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 6 HOUR AS b, count(*) AS n, sum(value) AS total FROM s GROUP BY user_id, k)
SELECT user_id, epoch_us(a) AS start, epoch_us(b) AS "end", n, round(total, 6) AS total FROM r WHERE b <= (SELECT max(ts) FROM e) - INTERVAL 2 DAY"""
)
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions that have ended, of events that came in time; the last part's rows are too late."""
    rows = _run(_parts(spark, sf_dir), lambda events: stateful.sessions(events, "ts", "6 hours", "2 days", "user_id", value="value"))
    return rows.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end"), "n", F.round("total", 6).alias("total"))


@query(
    f"""WITH {_PARTS},
w AS (SELECT part + 1 AS part, max(max(ts)) OVER (ORDER BY part) - INTERVAL 1 HOUR AS mark FROM e WHERE part < 99 GROUP BY part),
g AS (SELECT e.*, lag(ts) OVER u IS NULL OR coalesce(lag(ts) OVER u + INTERVAL 36 HOUR <= mark, false) AS new FROM e LEFT JOIN w USING (part) WHERE part < 99 WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g),
n AS (SELECT user_id, event_id, k, ts, row_number() OVER v AS number, sum(value) OVER v AS total FROM s WINDOW v AS (PARTITION BY user_id, k ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, number, round(total, 6) AS total, false AS ended FROM n
UNION ALL SELECT user_id, NULL, max(number), round(arg_max(total, number), 6), true FROM n GROUP BY user_id, k HAVING max(ts) + INTERVAL 36 HOUR <= (SELECT max(mark) FROM w)"""
)
def keyed_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events numbered over visits that end after 36 idle hours; state and timers go on over restarts."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, stateful.STATE_STORE)
    try:
        rows = _run(_parts(spark, sf_dir), lambda events: stateful.visits(events, "user_id", "event_id", "ts", "value", 36 * 3600.0, "1 hour"))
    finally:
        spark.conf.set(name, before)
    return rows.select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "number", F.round("total", 6).alias("total"), "ended")
