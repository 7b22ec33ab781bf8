from __future__ import annotations

import datetime as dt

import pytest

from trajecta.sources import readers, schemas, writers
from trajecta.streaming import series as streams


def test_ragged_rows_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, [1.0, 2.5]), (1, []), (3, [4.0])], "id long, values array<double>")
    writers.ragged(df, f"{tmp_path}/r", form="%.2f")
    back = readers.ragged(spark, f"{tmp_path}/r")
    assert sorted((r["id"], list(r["values"])) for r in back.collect()) == [(1, []), (2, [1.0, 2.5]), (3, [4.0])]
    few = readers.ragged(spark, f"{tmp_path}/r", ids=spark.createDataFrame([(2,), (9,)], "id long"), columns=[1])
    assert [(r["id"], list(r["values"])) for r in few.collect()] == [(2, [2.5])]
    assert [r["id"] for r in readers.missing_ids(spark.createDataFrame([(2,), (9,)], "id long"), back).collect()] == [9]


def test_text_sources(spark, tmp_path):
    (tmp_path / "codes").write_text("dm: 250, 250.01 - 250.03\nht: 401.1\n")
    assert sorted((r["name"], r["code"]) for r in readers.code_ranges(spark, f"{tmp_path}/codes").collect()) == [("dm", "250"), ("dm", "250.01"), ("dm", "250.02"), ("dm", "250.03"), ("ht", "401.1")]
    (tmp_path / "w.csv").write_text("Transition,Weight\n0-1,1.0\n1-2,2.5\n")
    assert readers.weights(spark, f"{tmp_path}/w.csv") == [1.0, 2.5]
    (tmp_path / "names").write_text("a\n\nb\n")
    assert readers.names(spark, f"{tmp_path}/names") == ["a", "b"]
    (tmp_path / "death.txt").write_text("KEY^DIED\n7^2020-01-01\n8^2020-01-02\n")
    (tmp_path / "map.csv").write_text("KEY,PID\n7,100\n7,101\n")
    got = readers.registry(spark, f"{tmp_path}/death.txt", f"{tmp_path}/map.csv", "KEY BIGINT, DIED STRING", "KEY BIGINT, PID BIGINT", "KEY", "DIED").collect()
    assert [tuple(r) for r in got] == [(100, "2020-01-01")]
    assert readers.Config.read('{"analysis_days": 7, "other": 1}').analysis_days == 7


def test_alignments_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, [0.0, 1.0], [0.0, 2.0]), (1, 3, [1.0], [3.0])], "id1 long, id2 long, path1 array<double>, path2 array<double>")
    writers.alignment_rows(df.coalesce(1)).write.text(f"{tmp_path}/a")
    assert sorted(tuple(r) for r in readers.alignments(spark, f"{tmp_path}/a").collect()) == sorted(tuple(r) for r in df.collect())


def test_columns_by_parts():
    assert schemas.resolved(["HD_START", "HD_STOP", "CRRT_START"], "hd", "start") == "HD_START"
    with pytest.raises(ValueError):
        schemas.resolved(["HOSP_ADMIT", "HSP_ADMSN"], ("hosp", "hsp"), ("admit", "admsn"))


def test_treatments(spark):
    raw = spark.createDataFrame([(1, "2024-01-01 00:00:00", "2024-01-02 00:00:00", None, None)], "STUDY_PATIENT_ID long, HD_START_DATE string, HD_STOP_DATE string, CRRT_START_DATE string, CRRT_STOP_DATE string")
    assert [(r["kind"], r["stop"]) for r in readers.unpivoted_treatments(raw).collect()] == [("HD", dt.datetime(2024, 1, 2))]


def test_streams(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [(1, t(0), 1.0), (1, t(1), 5.0), (1, t(20), 3.0), (1, t(200), 1.0), (2, t(300), 2.0)]
    spark.createDataFrame(rows, "id long, ts timestamp, value double").coalesce(1).write.parquet(f"{tmp_path}/in")

    def run(df, name, mode="append"):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name).collect()

    stream = streams.events(spark, f"{tmp_path}/in", "id long, ts timestamp, value double")
    bins = run(streams.binned(stream, late="1 hour"), "bins")
    assert (1, t(0), t(6), 5.0, 2) in [tuple(r) for r in bins]
    found = run(streams.gap_episodes(stream, late="1 hour"), "episodes")
    assert (1, t(0), t(20), 3) in [tuple(r) for r in found]
    means = run(streams.pair_means(stream), "means")
    assert sorted(r["value"] for r in means) == [3.0, 3.0, 4.0]


def test_settings_by_either_name():
    assert readers.Config.read('{"analysisDays": 7, "timeResolutionHrs": 3, "cohortName": "x", "window": 3}', strict=True) == readers.Config(analysis_days=7, hours=3, cohort="x", window=3)
    with pytest.raises(ValueError, match="windw"):
        readers.Config.read('{"windw": 3}', strict=True)
    with pytest.warns(UserWarning, match="windw"):
        assert readers.Config.read('{"windw": 3}') == readers.Config()


REPORT = """
 NRI(Categorical) [95% CI]: 0.2500 [ 0.1000 - 0.4000 ] ; p-value: 0.00110

 NRI(Continuous) [95% CI]: -0.5 [ -0.75 - 1e-1 ] ; p-value: 0.5
 IDI SE 0.1
 IDI [95% CI]: 0.03 [ 0.01 - 0.05 ] ; p-value: 0.002
 NRI for events = 0.11 with 95% CI 0.01 0.21
 NRI for non-events = 0.12 with 95% CI 0.22 0.02
 Area under the curve: 0.71
 95% CI: (0.61-0.81 (DeLong)
 Area under the curve: 0.75
 95% CI: 0.65-0.85 (DeLong)
"""


def test_reports(spark, tmp_path):
    (tmp_path / "a.txt").write_text(REPORT)
    (tmp_path / "b.txt").write_text("nothing here\n IDI [95% CI]: x [ 0.01 - 0.05 ] ; p-value: NA\n")
    got = {(r["report"].rsplit("/", 1)[1], r["statistic"]): (r["value"], r["low"], r["high"], r["p"]) for r in readers.reclassification_reports(spark, str(tmp_path)).collect()}
    assert got == {
        ("a.txt", "nri_categorical"): (0.25, 0.1, 0.4, 0.0011), ("a.txt", "nri_continuous"): (-0.5, -0.75, 0.1, 0.5), ("a.txt", "idi"): (0.03, 0.01, 0.05, 0.002), ("a.txt", "nri_events"): (0.11, 0.01, 0.21, None),
        ("a.txt", "nri_nonevents"): (0.12, 0.02, 0.22, None), ("a.txt", "auc_before"): (0.71, 0.61, 0.81, None), ("a.txt", "auc_after"): (0.75, 0.65, 0.85, None), ("b.txt", "idi"): (None, 0.01, 0.05, None),
    }


def test_coefficient_reports(spark, tmp_path):
    (tmp_path / "m.txt").write_text("\n" * 12 + "x1 0.5 0.1 4.0 0.001 0.3 0.7\nx2 -1 0.1 4.0 0.001 -1.5 -0.5\nx3 9 9 9 9 9 9\n")
    got = sorted(tuple(r)[1:] for r in readers.coefficient_reports(spark, str(tmp_path), 2).collect())
    assert got == [(0, "x1", 0.5, 0.3, 0.7), (1, "x2", -1.0, -1.5, -0.5)]


def test_clustered_alignments_open_few_files(spark, tmp_path):
    df = spark.range(4000).selectExpr("id div 50 as id1", "id div 50 + 1 + id % 50 as id2", "array(id * 1.0D) as path1")
    writers.clustered_alignments(df, str(tmp_path), 16)
    wanted = spark.createDataFrame([(3, 10), (31, 30), (5000, 5001)], "id1 long, id2 long")
    got = readers.clustered_alignments(spark, str(tmp_path), wanted)
    assert sorted((r["id1"], r["id2"]) for r in got.collect()) == [(3, 10), (30, 31)]
    every = spark.read.parquet(f"{tmp_path}/rows").inputFiles()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert len(every) >= 12 and "PartitionFilters: [" in plan and "part" in plan
    parts = {r[0] for r in spark.read.parquet(f"{tmp_path}/rows").join(got.select("id1", "id2"), ["id1", "id2"]).select("part").distinct().collect()}
    assert len(parts) <= 2


def test_column_groups(spark, tmp_path):
    raw = spark.createDataFrame([(1, 5.0), (2, 7.0)], "id long, v double")
    made = []

    def doubled(df, by=2):
        made.append(by)
        return df.selectExpr("id", f"v * {by} as w")

    store = writers.ColumnGroups(spark, str(tmp_path / "static"))
    for _ in range(2):  # the second time nothing is made
        store.group("a", lambda: doubled(raw), raw)
        store.group("b", lambda: doubled(raw, 3), raw, version="3")
    assert made == [2, 3]
    ids = spark.createDataFrame([(1,), (3,)], "id long")
    assert sorted(map(tuple, store.table(ids).collect())) == [(1, 10.0, 15.0), (3, None, None)] and store.table(ids).columns == ["id", "w", "b_w"]
    store.group("a", lambda: doubled(raw), raw.orderBy("v", ascending=False).repartition(3))  # the same rows in another order
    assert made == [2, 3]
    more = raw.union(spark.createDataFrame([(3, 1.0)], raw.schema))
    store.group("a", lambda: doubled(more), more)
    assert made == [2, 3, 2] and sorted(r["w"] for r in store.table(ids).collect()) == [2.0, 10.0]
    broken = store.groups["a"]
    (tmp_path / "static" / "a" / broken.rsplit("/", 1)[1] / "_SUCCESS").unlink()
    store.group("a", lambda: doubled(more), more)
    assert made == [2, 3, 2, 2] and store.table(ids).count() == 2
    with pytest.raises(ValueError, match="share"):
        store.group("c", lambda: raw.union(raw), raw)
