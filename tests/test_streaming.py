from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from granary.streaming import ingest, stateful

START = datetime(2024, 1, 1)
KIND = "u long, i long, t timestamp, v double"


def put(spark, path, k, rows):
    at = lambda s: None if s is None else START + timedelta(seconds=s)
    spark.createDataFrame([(u, i, at(s), float(i)) for u, i, s in rows], KIND).coalesce(1).write.parquet(f"{path}/in/part-{k}")


def test_sessions_close_and_late_rows_go(spark, tmp_path):
    path = str(tmp_path)
    run = lambda: stateful.append(stateful.sessions(stateful.stream_parquet(spark, f"{path}/in", KIND), "t", "10 seconds", "20 seconds", "u", value="v"), f"{path}/out", f"{path}/check").awaitTermination()
    put(spark, path, 0, [(1, 1, 0), (1, 2, 9), (1, 3, 19), (1, 12, 30), (2, 4, 5), (None, 5, 6), (1, 6, None), (3, 7, 100)])
    run()
    # the watermark is at 80 now: what ended before is out, and rows of those times are too late
    got = {(r.u, (r.start - START).seconds, (r.end - START).seconds, r.n, r.total) for r in spark.read.parquet(f"{path}/out").collect()}
    assert got == {(1, 0, 29, 3, 6.0), (1, 30, 40, 1, 12.0), (2, 5, 15, 1, 4.0), (None, 6, 16, 1, 5.0)}
    put(spark, path, 1, [(1, 8, 12), (3, 9, 105), (2, 10, 75), (4, 11, 400)])
    run()
    got = {(r.u, (r.start - START).seconds, r.n) for r in spark.read.parquet(f"{path}/out").where("start > '2024-01-01 00:00:31'").collect()}
    assert got == {(3, 100, 2), (2, 75, 1)} and spark.read.parquet(f"{path}/out").count() == 6


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, stateful.STATE_STORE)
    yield
    spark.conf.set(name, before)


def test_visits_go_on_over_restarts(spark, store, tmp_path):
    path = str(tmp_path)
    run = lambda: stateful.append(stateful.visits(stateful.stream_parquet(spark, f"{path}/in", KIND), "u", "i", "t", "v", 60.0, "10 seconds"), f"{path}/out", f"{path}/check").awaitTermination()
    put(spark, path, 0, [(1, 2, 5), (1, 1, 0), (2, 3, 6), (None, 4, 7), (1, 5, None)])
    run()
    put(spark, path, 1, [(1, 6, 50), (3, 7, 100)])
    run()  # the watermark comes to 90: the visit of 2 is over, that of 1 isn't
    put(spark, path, 2, [(2, 8, 110), (1, 9, 109), (1, 10, 3)])
    run()
    rows = spark.read.parquet(f"{path}/out").collect()
    assert sorted((r.key, r.id, r.number, r.total) for r in rows if not r.ended) == [(1, 1, 1, 1.0), (1, 2, 2, 3.0), (1, 6, 3, 9.0), (1, 9, 4, 18.0), (2, 3, 1, 3.0), (2, 8, 1, 8.0), (3, 7, 1, 7.0)]
    assert [(r.key, r.number, r.total) for r in rows if r.ended] == [(2, 1, 3.0)]
    run()  # nothing new, nothing again
    assert spark.read.parquet(f"{path}/out").count() == len(rows)


def test_stream_dedup(spark, tmp_path):
    path = str(tmp_path)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"a":1}\n{"a":2}\n{"a":1}\nnot json\n')
    (tmp_path / "in" / "b.jsonl").write_text('{"a":2}\n{"a":3}\n')
    for _ in range(2):
        lines = ingest.stream_valid(ingest.stream_lines(spark, f"{path}/in"))
        ingest.to_parquet(ingest.stream_dedup(lines, F.md5("line"), "seen_at", "1 hour"), f"{path}/out", f"{path}/check").awaitTermination()
    assert sorted(r.line for r in spark.read.parquet(f"{path}/out").collect()) == ['{"a":1}', '{"a":2}', '{"a":3}']


class Handle:
    """State and timers of one bucket, in memory."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):  # noqa: N802
        return list(self.timers)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.mark


def test_many_keys_are_handled_in_one_call():
    import pandas as pd

    handle, visits = Handle(), stateful.Visits(60.0, "bigint")
    visits.init(handle)
    frame = lambda rows: pd.DataFrame(rows, columns=["key", "id", "unnamed", "at", "value"]).assign(at=lambda d: pd.to_datetime(d["at"], unit="s"))
    big = 2**60 + 1
    out = pd.concat(visits.handleInputRows((0,), iter([frame([(k, big + k, False, 100 + k, 1.0) for k in range(50)]), frame([(7, 0, True, 90, 2.0)])]), None))
    assert len(out) == 51 and [(r.number, r.total) for r in out[out.key == 7].itertuples()] == [(1, 2.0), (2, 3.0)]
    assert out["id"].isna().sum() == 1 and out[out.key == 3]["id"].tolist() == [big + 3] and handle.timers == [160_000]
    handle.timers, handle.mark = [], 169_000
    over = pd.concat(visits.handleExpiredTimer((0,), handle, None))
    assert sorted(zip(over["key"], over["number"], over["total"], strict=True)) == [(k, 1 + (k == 7), 1.0 + 2 * (k == 7)) for k in range(10)] and handle.timers == [170_000]
    out = pd.concat(visits.handleInputRows((0,), iter([frame([(7, 1, False, 170, 4.0), (10, 2, False, 171, 5.0)])]), None))
    assert sorted(zip(out["key"], out["number"], out["total"], strict=True)) == [(7, 1, 4.0), (10, 2, 6.0)]
    handle.timers, handle.mark = [], 10**9
    assert len(pd.concat(visits.handleExpiredTimer((0,), handle, None))) == 41 and not handle.exists() and not handle.timers
