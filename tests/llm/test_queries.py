"""Every query with SQL against DuckDB, and the names that the driver asks for."""

from __future__ import annotations

import pytest

from granary.llm.queries import ORACLE_SQL, QUERIES


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = con.execute(ORACLE_SQL[name])
    places = [[d[0] for d in got.description].index(n) for n in names]
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in places) for r in got.fetchall()), key=repr)
