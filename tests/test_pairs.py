"""All pairs by a grid of blocks: every pair once, and how much is dealt for it."""

from __future__ import annotations

import random
import time

import pytest

from trajecta.operators import joins


def written(spark):
    """Bytes that the shuffles of the session have written so far."""
    sc = spark.sparkContext._jsc.sc()
    time.sleep(1)
    spark.range(10).repartition(2).count()  # its end brings the figures up to date
    sc.listenerBus().waitUntilEmpty(30_000)
    return sc.statusStore().executorSummary("driver").totalShuffleWrite()


@pytest.mark.parametrize("kind,rows", [("long", 7), ("string", None), ("double", 40)])
def test_every_pair_once(spark, kind, rows):
    r = random.Random(4)
    key = {"long": int, "string": str, "double": lambda k: k / 4 if k else -0.0}[kind]
    given = [(key(r.randrange(150)), i) for i in range(200)] + [(0.0 if kind == "double" else None, 200), (None, 201)]
    got = joins.all_pairs(spark.createDataFrame(given, f"k {kind}, i int"), "k", rows) if rows else joins.all_pairs(spark.createDataFrame(given, f"k {kind}, i int"), "k")
    assert got.columns == ["k", "i", "k2", "i2"]
    known = [x for x in given if x[0] is not None]
    assert sorted(map(tuple, got.collect())) == sorted((*a, *b) for a in known for b in known if a[0] < b[0])


def test_rows_are_dealt_to_few_blocks(spark):
    df = spark.range(9000).selectExpr("id as k", "id % 7 as l")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written(spark)
        assert joins.all_pairs(df, "k").where("l = l2").count() == sum(n * (n - 1) // 2 for n in (len(range(k, 9000, 7)) for k in range(7)))
        assert written(spark) - before < 3e6  # by blocks of 250 rows a row was dealt 72 times
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
