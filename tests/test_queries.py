"""Every registered query with SQL, side by side with DuckDB on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from trajecta.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return c


def plain(rows):
    def cell(v):
        if isinstance(v, float) or v.__class__.__name__ == "Decimal":
            return "nan" if math.isnan(v) else f"{float(v):.6g}"
        return v if v is None else str(v)

    return sorted((tuple(map(cell, r)) for r in rows), key=lambda r: tuple((x is None, x or "") for x in r))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    if name not in catalog.ORACLE_SQL:
        assert got
        return
    rel = db.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    assert plain(got) == plain([tuple(r[i] for i in order) for r in rel.fetchall()])
