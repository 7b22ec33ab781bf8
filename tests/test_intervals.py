"""Interval and nearest-time joins against plain loops."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from trajecta.operators import joins

T0 = datetime(2020, 1, 1)


def spans(r, n, keys=3, empty=0.1):
    """From seconds to a hundred years, some that end before they start, some without an end."""
    out = []
    for i in range(n):
        a = T0 + timedelta(seconds=r.randrange(0, 40 * 86400))
        long = r.choice([0, 1, 600, 86400, 10 * 86400, 400 * 86400, 36500 * 86400])
        out.append((r.randrange(keys), i, a, None if r.random() < empty else a + timedelta(seconds=r.randrange(-1, long + 1))))
    return out


@pytest.mark.parametrize("closed,tail", [(True, 0), (True, 48), (False, 0)])
def test_stab(spark, closed, tail):
    r = random.Random(closed + tail)
    s = spans(r, 120)
    points = [(r.randrange(4), i, r.choice([x[2] for x in s]) if i % 3 == 0 else T0 + timedelta(seconds=r.randrange(-86400, 800 * 86400))) for i in range(200)] + [(1, 900, None), (None, 901, T0)]
    want = set()
    for k, i, t in points:
        for q, j, a, b in s:
            end = (b or a) + timedelta(hours=tail)
            if k == q and t is not None and end >= a and ((a <= t <= end) if closed else (a < t < end)):
                want.add((i, j))
    got = joins.stab(spark.createDataFrame(points, "k int, i int, t timestamp"), spark.createDataFrame(s, "k int, j int, a timestamp, b timestamp"), "k", "t", "a", "b", tail, closed).collect()
    assert len(got) == len(want) > 200 and {(x["i"], x["j"]) for x in got} == want and got[0].__fields__ == ["k", "i", "t", "j", "a", "b"]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_overlap(spark, kind):
    r = random.Random(7)
    one, two = spans(r, 100, empty=0), spans(r, 110, empty=0.05)
    if kind == "date":
        one, two = ([(k, i, a.date(), b and b.date()) for k, i, a, b in s] for s in (one, two))
    want = {(i, j, max(a, c), min(b, e)) for k, i, a, b in one for q, j, c, e in two if k == q and e is not None and a <= b and c <= e and min(b, e) > max(a, c)}
    got = joins.overlap(spark.createDataFrame(one, f"k int, i int, a {kind}, b {kind}"), spark.createDataFrame(two, f"k int, j int, c {kind}, e {kind}"), "k", ("a", "b"), ("c", "e")).collect()
    assert len(got) == len(want) > 300 and {(x["i"], x["j"], x["w_start"], x["w_stop"]) for x in got} == want


def test_a_span_of_a_century_is_two_rows(spark):
    """The join reads no more rows for long spans than for short ones."""
    for years in (1, 100):
        s = spark.createDataFrame([(1, T0, T0 + timedelta(days=365 * years))], "k int, a timestamp, b timestamp")
        levelled = joins._levelled(s, "a", "b", "")
        assert levelled.selectExpr("explode(sequence(shiftright(__s, __l), shiftright(__e, __l)))").count() <= 2
    hot = spark.range(3000).selectExpr("1 as k", "id as i", "timestamp_seconds(1577836800 + id * 86400) as a", "timestamp_seconds(1577836800 + id * 86400 + 3600) as b")
    assert joins.overlap(hot, hot.selectExpr("k", "i as j", "a as c", "b as e"), "k", ("a", "b"), ("c", "e")).count() == 3000


@pytest.mark.parametrize("k", [1, 3])
def test_nearest(spark, k):
    r = random.Random(k)
    right = [(r.randrange(4), j, T0 + timedelta(hours=r.randrange(60)) if r.random() > 0.05 else None) for j in range(150)]
    left = [(r.randrange(5), i, T0 + timedelta(minutes=r.randrange(3600))) for i in range(60)] + [(0, 70, None)]
    want = []
    for q, i, t in left:
        if t is not None:
            near = sorted((abs((s - t).total_seconds()), j) for p, j, s in right if p == q and s is not None)[:k]
            want += [(i, j, n, round(d / 86400, 9)) for n, (d, j) in enumerate(near, 1)]
    got = joins.nearest(spark.createDataFrame(left, "k int, i int, t timestamp"), spark.createDataFrame(right, "k int, j int, seen timestamp"), "k", joins.F.col("t"), "seen", k, "j").collect()
    assert sorted((x["i"], x["j"], x["rank"], round(x["apart_days"], 9)) for x in got) == sorted(want)


def test_joins_of_nothing(spark):
    none = spark.createDataFrame([], "k int, a timestamp, b timestamp")
    one = spark.createDataFrame([(1, T0, T0)], "k int, c timestamp, e timestamp")
    assert joins.overlap(none, one, "k", ("a", "b"), ("c", "e")).count() == 0 and joins.stab(one, none, "k", "c", "a", "b").count() == 0
    assert joins.nearest(one, none, "k", joins.F.col("c"), "a", 2).count() == 0
