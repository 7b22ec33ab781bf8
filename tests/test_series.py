from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from trajecta.functions import sequences, times
from trajecta.operators import series, trajectories

T0 = dt.datetime(2024, 3, 1, 7, 0)
H = lambda h: T0 + dt.timedelta(hours=h)


def points(spark, rows):
    return spark.createDataFrame([(1, H(h), float(v), i, m) for i, (h, v, m) in enumerate(rows)], "id long, ts timestamp, value double, tie int, mask int")


def test_pair_mean_stops_at_a_day(spark):
    df = points(spark, [(0, 1.0, 0), (20, 3.0, 1), (50, 9.0, 0)])
    got = sorted((r["tie"], r["ts"], r["value"], r["mask"]) for r in series.forward_mean(df, mask="mask", tie="tie").collect())
    assert got == [(0, H(10), 2.0, 1), (1, H(20), 3.0, 1), (2, H(50), 9.0, 0)]
    two = points(spark, [(0, 1.0, 0), (1, 3.0, 1)])
    assert sorted(r["value"] for r in series.forward_mean(two, tie="tie").collect()) == [1.0, 3.0]


def test_grid_fills_gaps_and_keeps_the_largest(spark):
    got = series.to_grid(points(spark, [(0, 1.0, 0), (1, 4.0, 1), (13, 8.0, 0)]), mask="mask").orderBy("bin").collect()
    assert [(r["bin"], r["value"], r["is_real"], r["on_mask"]) for r in got] == [(0, 4.0, True, True), (1, 6.0, False, True), (2, 8.0, True, True)]
    alone = series.to_grid(points(spark, [(0, 1.0, 0), (1, 4.0, 0)])).collect()
    assert [(r["bin"], r["value"]) for r in alone] == [(0, 2.5)]
    far = series.to_grid(points(spark, [(0, 1.0, 1), (60, 1.0, 0)]), mask="mask").orderBy("bin").collect()
    assert [r["on_mask"] for r in far] == [True] * 8 + [False] * 3


def test_day_numbers(spark):
    df = spark.range(0, 14).select(F.col("id").cast("int").alias("b"))
    day = series.day_number(F.col("b"), F.lit(5), F.lit(13), F.lit(True))
    assert [r[0] for r in df.select(day).collect()] == [0, -1, -1, -1, -1, 0, 0, 1, 1, 1, 1, 2, 2, 2]


@pytest.mark.parametrize("bin_,value,expected", [(7, 1.3, 0), (8, 1.3, 1), (8, 1.29, 0), (9, 1.5, 1), (9, 1.51, 1), (9, 2.0, 2), (9, 3.0, 3)])
def test_stage_edges(spark, bin_, value, expected):
    rows = [(1, b, 1.0 if b < bin_ else value, True, False, 1.0, b // 4 + 1) for b in range(bin_ + 1)]
    g = spark.createDataFrame(rows, "id int, bin int, value double, is_real boolean, on_mask boolean, base double, day int")
    assert {r["bin"]: r["stage"] for r in series.staged(g).collect()}[bin_] == expected


def stage_rows(spark, *sequences_):
    return spark.createDataFrame([(i, b, b // 4 + 1, k) for i, s in enumerate(sequences_) for b, k in enumerate(s)], "id int, bin int, day int, stage int")


def test_episodes_peaks_and_turns(spark):
    s = stage_rows(spark, [1, *[0] * 6, 1], [1, *[0] * 7, 1], [0, 0], [0, 1, 0, 2, 3], [2, 1, 1, 2, 0])
    assert {r["id"]: r["n_episodes"] for r in series.episodes(s).collect()} == {0: 1, 1: 2, 2: 0, 3: 1, 4: 1}
    got = {r["id"]: (r["n_peaks"], r["up_down"], r["down_up"]) for r in series.directions(s).collect()}
    assert got == {0: (0, 0, 1), 1: (0, 0, 1), 2: (0, 0, 0), 3: (1, 1, 1), 4: (1, 1, 1)}


def test_described_and_counts(spark):
    s = stage_rows(spark, [0, 1, 1, 1, 1, 2])
    r = trajectories.described(s).first()
    assert (r["peak"], r["first"], r["last"], r["stage1_day"], r["stage2_day"], r["only_up"], r["flat"], r["turns_down"]) == (2, 0, 2, 1, 0, 1, 0, 0)
    assert {x["template"]: x["n"] for x in trajectories.templates(s).collect()} == {"0-1-1": 1, "1-1-1": 2, "1-1-2": 1}
    assert {x["slope"]: x["n"] for x in trajectories.slopes(s).collect()} == {0: 3, 1: 2}
    assert {(x["previous"], x["current"]): x["n"] for x in trajectories.transitions(s).collect()} == {(0, 1): 1, (1, 1): 3, (1, 2): 1}


def test_dates(spark):
    texts = ["2024-01-02 03:04:05.678", "1/2/24 3:04", "1/2/69", "1/2/2024", "x", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(times.parse_timestamp(F.col("t"))).collect()]
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4), dt.datetime(1969, 1, 2), dt.datetime(2024, 1, 2), None, None]
    df = spark.createDataFrame([(dt.datetime(2024, 1, 2, 23), dt.datetime(2024, 1, 1, 1))], "a timestamp, b timestamp")
    r = df.select(times.whole_days(F.col("a"), F.col("b")), times.calendar_days(F.col("a"), F.col("b")), times.difference(F.col("a"), F.col("b"), "h"), times.midpoint(F.col("b"), F.col("a")), times.floor_to_bin(F.col("a"), 6)).first()
    assert tuple(r) == (-2, -1, -46.0, dt.datetime(2024, 1, 2, 0), dt.datetime(2024, 1, 2, 18))


def test_array_distances_and_shapes(spark):
    df = spark.createDataFrame([([0.0, 0.0], [0.0, 0.0]), ([1.0, 3.0], [2.0, 1.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    got = [tuple(r) for r in df.select(sequences.bray_curtis(a, b), F.round(sequences.norm_euclidean(a, b), 6), sequences.norm_cityblock(a, b)).collect()]
    assert got == [(0.0, 0.0, 0.0), (3 / 7, round(5**0.5 / 32**0.5, 6), 0.375)]
    v = df.where("a[0] = 1").select(sequences.class_vector(a, 1, 4), sequences.class_vector(a, 1, 4, "fill", "front"), sequences.zero_padded(a, F.lit(3)), sequences.prefix_sums(a)).first()
    assert [list(x) for x in v] == [[1, 3, 0, 0], [1, 1, 1, 3], [1, 3, 0], [0, 1, 4]]
