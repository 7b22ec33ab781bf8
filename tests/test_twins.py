"""Queries against their SQL on small tables of odd rows: equal rows, halves in the last place, zeros."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import duckdb
import pytest

from tests.test_queries import plain
from trajecta.plans import catalog

T0 = datetime(2024, 1, 1)


def same_as_sql(spark, folder, name, **tables):
    """The query's rows, which are those of its SQL over the tables of (rows, types)."""
    db = duckdb.connect()
    for table, (rows, types) in tables.items():
        spark.createDataFrame(rows, types).write.parquet(f"{folder}/{table}.parquet")
        db.sql(f"create view {table} as select * from '{folder}/{table}.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    want = db.sql(catalog.ORACLE_SQL[name])
    got = df.select(*want.columns).collect()
    assert plain(map(tuple, got)) == plain(want.fetchall())
    return got


def test_six_places_as_sql(spark):
    r = random.Random(1)
    xs = [(r.randrange(-(10**9), 10**9) + 0.5) / 1e6 for _ in range(3000)] + [0.0, -0.0, float("inf"), float("-inf"), 1e303, -4e-7]
    db = duckdb.connect()
    want = [db.execute("select round(?::double, 6) + 0.0", [x]).fetchall()[0][0] for x in xs]
    assert [row[0] for row in spark.createDataFrame([(x,) for x in xs], "x double").select(catalog.r6("x")).collect()] == want


def test_relative_over_zero(spark, tmp_path):
    rows = [(3 * i + u, T0 + timedelta(hours=7 * i), u, "view", v) for u, vs in enumerate([[0.0, 2.5, 1.0, 0.0], [0.5, -1.0, 3.0, 4.25], [-2.0, 0.0, 1.0, 5.0]]) for i, v in enumerate(vs)]
    got = same_as_sql(spark, tmp_path, "q_relative", events=(rows, "event_id long, ts timestamp, user_id long, event_type string, value double"))
    assert any(x["relative"] == float("inf") for x in got)


def test_equal_rows_are_contained(spark, tmp_path):
    lines = [(1, 1, T0 + timedelta(days=3)), (1, 1, T0 + timedelta(days=3)), (1, 2, T0 + timedelta(days=45, hours=5)), (1, 3, T0 + timedelta(days=45, hours=7)), (2, 1, T0)]
    got = same_as_sql(spark, tmp_path, "q_containing", lineitem=(lines, "l_orderkey long, l_linenumber int, l_shipdate timestamp"), orders=([(1, T0 + timedelta(hours=6)), (2, T0 + timedelta(hours=6))], "o_orderkey long, o_orderdate timestamp"))
    assert [tuple(x)[:2] for x in sorted(got)] == [(1, 1), (1, 1), (1, 2)]
