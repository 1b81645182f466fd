"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import os

import pytest

from granary.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, query, sql):
    df = query(spark, SF)
    names = sorted(df.columns)
    mine = sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)
    got = con.execute(sql)
    places = [[d[0] for d in got.description].index(n) for n in names]
    theirs = sorted((tuple(r[i] for i in places) for r in got.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name in ORACLE_SQL:
        compare(spark, duck, QUERIES[name], ORACLE_SQL[name])
    else:
        assert QUERIES[name](spark, SF).count() > 0


def test_learning_rate_of_every_event(spark, tmp_path):
    spark.range(3000).withColumnRenamed("id", "event_id").write.parquet(str(tmp_path / "events.parquet"))
    rates = {r.event_id: r.rate for r in QUERIES["learning_rate"](spark, str(tmp_path)).collect()}
    assert len(rates) == 3000 and rates[0] == 0.00004 and rates[899] == 0.001 and rates[2999] == 4e-9
