"""Quantiles and ranks of columns and groups against NumPy."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from trajecta.operators import cleaning, quantiles, tables


def rows(seed, n=400):
    r = random.Random(seed)
    kinds = [lambda: r.gauss(0, 1), lambda: float(r.randrange(3)), lambda: 10.0 ** r.uniform(-250, 250), lambda: -1e308 * r.random(), lambda: 7.0]
    out = [(r.choice(["a", "b", None, "hot", "hot", "hot"]), *(f() if r.random() > 0.1 else None for f in kinds)) for _ in range(n)]
    return out + [("empty", None, None, None, None, None), ("one", 1.0, float("nan"), float("inf"), None, 2.0)]


COLUMNS = ["normal", "few", "wide", "huge", "same"]


@pytest.mark.parametrize("buckets,few", [(65_536, 65_536), (4, 5), (2, 1)])
def test_quantiles(spark, monkeypatch, buckets, few):
    """In one sort, and by many passes over ranges, of values that lie evenly, at one point, or over 500 powers of ten."""
    monkeypatch.setattr(quantiles, "BUCKETS", buckets)
    monkeypatch.setattr(quantiles, "FEW", few)
    data = rows(buckets, 400 if buckets > 4 else 60)
    df = spark.createDataFrame(data, "`the group` string, " + ", ".join(f"{c} double" for c in COLUMNS))
    some = COLUMNS if buckets > 2 else ["normal", "few", "same"]
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r["the group"], r["column"]): (r["n"], r["q"]) for r in quantiles.quantiles(df, some, shares, ["the group"]).collect()}
    for g in {x[0] for x in data}:
        for c in some:
            v = [x[1 + COLUMNS.index(c)] for x in data if x[0] == g]
            v = [x for x in v if x is not None and math.isfinite(x)]
            n, q = got.pop((g, c))
            assert n == len(v)
            if v:
                v.sort()
                for p, x in zip(shares, q):
                    at = p * (len(v) - 1)
                    low, high = v[math.floor(at)], v[math.ceil(at)]
                    assert x == low + (high - low) * (at - math.floor(at))
            else:
                assert q is None
    assert not got


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert quantiles.quantiles(df, ["v"], [0.5], ["g"]).count() == 0
    assert [tuple(r) for r in quantiles.quantiles(df, ["v"], [0.5]).collect()] == [("v", 0, None)]
    assert quantiles.ranks(df, "v", ["g"]).count() == 0 and tables.median_iqr(df, "g", "v").count() == 0


def test_ranks(spark):
    data = [(x[0], x[1] if i % 3 else x[2]) for i, x in enumerate(rows(1))]
    got = quantiles.ranks(spark.createDataFrame(data, "g string, v double"), "v", ["g"]).collect()
    for r in got:
        mine = [v for g, v in data if g == r["g"] and v is not None and not math.isnan(v)]
        assert r["n"] == mine.count(r["value"]) and r["before"] == sum(v < r["value"] for v in mine)
    assert sum(r["n"] for r in got) == sum(v is not None and not math.isnan(v) for _, v in data)


def test_tables_and_medians(spark):
    data = [("a", 1.0, 1), ("a", 4.0, 0), ("b", None, 1), (None, 3.0, None), ("a", 2.0, 1)]
    df = spark.createDataFrame(data, "g string, v double, f int")
    got = {r["g"]: tuple(r)[1:] for r in tables.median_iqr(df, "g", "v").collect()}
    assert got == {"a": (3, 1.5, 2.0, 3.0), "b": (0, None, None, None), None: (1, 3.0, 3.0, 3.0), "Total": (4, 1.75, 2.5, 3.25)}
    long = {(r["g"], r["row"]): tuple(r)[3:] for r in tables.long_table(df, "g", ["f"], ["v"]).collect()}
    assert long["Total", "v"] == (4, 2.5, 1.75, 3.25) and long["a", "f"][:2] == (3, 2.0) and np.isclose(long["Total", "f"][2], 0.75) and long["b", "v"] == (0, None, None, None)
    assert sorted(r["v"] for r in cleaning.imputed(df, ["v"]).collect()) == [1.0, 2.0, 2.5, 3.0, 4.0]
    filled = cleaning.imputed_by(df.union(spark.createDataFrame([(None, None, 1), ("a", None, 1)], df.schema)), "g", ["v"]).collect()
    assert sorted((r["g"] or "", -1.0 if r["v"] is None else r["v"]) for r in filled) == [("", 3.0), ("", 3.0), ("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 4.0), ("b", -1.0)]
