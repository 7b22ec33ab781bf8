from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajecta.operators import alignment, cleaning, cohort, evaluation, extracts, joins, outcomes, scores, tables, trajectories
from trajecta.plans import catalog

D = lambda d, h=0: dt.datetime(2024, 1, 1) + dt.timedelta(days=d, hours=h)


def frame(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


def test_stays(spark):
    s = frame(spark, "id int, admit timestamp, disch timestamp, place int", (1, D(0), D(5), 0), (1, D(3), D(4), 1), (1, D(6), D(8), 2), (1, D(11), D(12), 3))
    got = sorted((r["admit"], r["disch"]) for r in cohort.merged_stays(s).collect())
    assert got == [(D(0), D(8)), (D(11), D(12))]
    r = cohort.folded_stays(s).first()
    assert (r["admit"], r["disch"]) == (D(0), D(12))
    assert cohort.length_of_stay(s).first()["days"] == 8.0


def test_dialysis_tail(spark):
    v = frame(spark, "id int, row int, ts timestamp", (1, 0, D(0)), (1, 1, D(4)), (1, 2, D(4, 1)), (2, 3, D(0)))
    t = frame(spark, "id int, kind string, start timestamp, stop timestamp", (1, "HD", D(0), D(2)), (1, "CRRT", D(1), D(2)))
    assert {r["row"]: r["mask"] for r in cohort.dialysis_mask(v, t).collect()} == {0: 1, 1: 3, 2: 0, 3: 0}
    assert {r["row"]: r["mask"] for r in cohort.dialysis_mask(v, t, closed=False).collect()} == {0: 0, 1: 0, 2: 0, 3: 0}


def test_baselines(spark):
    p = frame(spark, "id int, admit timestamp, male int, black int, age double", *((i, D(400), 1, 0, 50.0) for i in range(1, 6)))
    v = frame(spark, "id int, ts timestamp, value double, kind string", (1, D(390), 1.0, "OUTPATIENT"), (1, D(390), 2.0, "OUTPATIENT"), (1, D(399, 12), 9.0, "OUTPATIENT"), (2, D(399), 3.0, "OUTPATIENT"), (2, D(380), 4.0, "INPATIENT"), (3, D(396), 5.0, "INPATIENT"), (3, D(30), 6.0, "OUTPATIENT"), (5, D(398), 7.0, "outpatient"))
    got = {r["id"]: (r["kind"], r["base"]) for r in cohort.baselines(v, p).collect()}
    assert got[1] == ("OUTPATIENT", 1.5)
    assert got[2] == ("INPATIENT", 4.0)  # exactly a day before is not more than a day
    assert got[3][0] == got[4][0] == "mdrd" and got[4][1] == pytest.approx((75 / (175 * 50**-0.203)) ** (1 / -1.154))
    assert got[5] == ("OUTPATIENT", 7.0)


def test_exclusions(spark):
    ok = dict(male=1, black=0, birth=D(-9000), age=50.0, admit=D(0), base=1.0, death=None, esrd_status=0, esrd_registry=0, esrd_review=None)
    people = [ok | {"id": 1}, ok | {"id": 2, "base": 4.0}, ok | {"id": 3, "age": 17.0}, ok | {"id": 4, "death": D(3, 20)}, ok | {"id": 5, "esrd_status": 1, "esrd_review": 0}, ok | {"id": 6, "esrd_status": 1}, ok | {"id": 7}, ok | {"id": 8}]
    ddl = "id int, male int, black int, birth timestamp, age double, admit timestamp, base double, death timestamp, esrd_status int, esrd_registry int, esrd_review int"
    p = spark.createDataFrame([tuple(x[c.split()[0]] for c in ddl.split(", ")) for x in people], ddl)
    v = frame(spark, "id int, ts timestamp", *((i, D(d)) for i in range(1, 9) for d in ((0, 1) if i != 7 else (0,))))
    s = frame(spark, "id int, day int, stage int", *((i, 1, 1) for i in range(1, 9)))
    dx = frame(spark, "id int, text string, code string", (8, "Kidney transplant status", None), (1, "Renal failure", "584.9"))
    got = {r["id"]: (r["reason"], r["kept"]) for r in cohort.exclusions(p, v, s, dx, frame(spark, "id int, text string")).collect()}
    assert got == {1: (None, True), 2: ("high_base", False), 3: ("minor", False), 4: ("early_death", False), 5: (None, True), 6: ("esrd", False), 7: ("one_value", False), 8: ("transplant", False)}


def test_sofa(spark):
    ddl = "id int, po2 double, fio2 double, ventilated int, gcs double, map double, dopamine int, epinephrine int, bilirubin double, platelets double, creatinine double"
    p = frame(spark, ddl, (1, 60.0, 0.8, 1, 5.0, 60.0, 0, 0, 13.0, 10.0, 6.0), (2, None, None, 1, None, 80.0, 0, 1, None, None, None), (3, 90.0, 0.3, 0, 14.0, 60.0, 1, 0, 2.0, 150.0, 1.2))
    got = {r["id"]: tuple(r)[1:] for r in scores.sofa(p).collect()}
    assert got == {1: (4, 4, 1, 4, 4, 4, 21), 2: (4, 4, 3, 0, 0, 0, 11), 3: (1, 1, 2, 1, 0, 0, 5)}


def test_apache(spark):
    names = [f"{n}_{s}" for n in ("temp", "map", "hr", "rr", "ph", "na", "k", "hct", "wbc") for s in ("low", "high")] + ["fio2", "po2", "pco2", "creatinine", "gcs", "age"]
    good = dict(zip(names, (36.5, 37.5, 75, 100, 75, 100, 14, 20, 7.35, 7.45, 135, 145, 4, 5, 35, 45, 5, 12, 0.3, 90, 40, 1.0, 15, 30)))
    rows = [good, good | {"temp_high": 41, "age": 80}, good | {"fio2": 0.9, "po2": 60, "gcs": 8}, dict.fromkeys(names)]
    df = spark.createDataFrame([(i, *(None if r[n] is None else float(r[n]) for n in names)) for i, r in enumerate(rows)], "id int, " + ", ".join(f"{n} double" for n in names))
    assert [r["apache"] for r in scores.apache(df).orderBy("id").collect()] == [0, 10, 11, 0]


def test_kidney_outcomes(spark):
    base = dict(icu_admit=D(0), icu_disch=D(10), hosp_disch=D(12), died_inp=0, death=None, male=1, black=0, age=50.0, baseline_gfr=100.0)
    people = [base | {"id": 1}, base | {"id": 2, "death": D(60)}, base | {"id": 3}, base | {"id": 4}]
    ddl = "id int, icu_admit timestamp, icu_disch timestamp, hosp_disch timestamp, died_inp int, death timestamp, male int, black int, age double, baseline_gfr double"
    p = spark.createDataFrame([tuple(x[c.split()[0]] for c in ddl.split(", ")) for x in people], ddl)
    v = frame(spark, "id int, ts timestamp, creatinine double", (1, D(14), 9.0), (1, D(95), 2.0), (1, D(60), 1.0), (2, D(95), 9.0), (3, D(95), 9.0))
    on = frame(spark, "id int, start timestamp, stop timestamp", (3, D(5), D(11)), (4, D(5), D(9)))
    none = frame(spark, "id int, during int, rrt_dependent int")
    status, registry = frame(spark, "id int, during string", (4, "Y")), frame(spark, "id int, failed_on timestamp")
    got = {r["id"]: r for r in outcomes.kidney_outcomes(p, v, on, none, status, registry).collect()}
    assert (got[1]["drop_50"], got[1]["d50"], got[1]["n_used"]) == (1, 1, 1)
    assert (got[2]["died_90"], got[2]["drop_25"], got[2]["d25"]) == (1, 0, 1)
    assert (got[3]["dialysis"], got[3]["drop_50"], got[3]["d50"]) == (1, 0, 1)
    assert (got[4]["esrd_status"], got[4]["dialysis"], got[4]["d25"]) == (1, 0, 1)
    two = {r["id"]: r for r in outcomes.kidney_outcomes(p, v, on, none, status, registry, count=2).collect()}
    assert two[1]["n_used"] == 1  # the second value is more than 30 days from the first


def test_extracts(spark):
    ids = frame(spark, "id int, admit timestamp, disch timestamp, died_inp int", (1, D(0), D(10), 0), (2, D(0), D(10), 1))
    vit = frame(spark, "id int, place int, ART_MEAN_D1_LOW_VALUE double, ART_MEAN_D1_HIGH_VALUE double, CUFF_MEAN_D1_LOW_VALUE double, CUFF_MEAN_D1_HIGH_VALUE double, TEMPERATURE_D1_LOW_VALUE double, TEMPERATURE_D1_HIGH_VALUE double, HEART_RATE_D1_LOW_VALUE double, HEART_RATE_D1_HIGH_VALUE double", (1, 0, None, 90.0, 60.0, 80.0, 97.0, 99.0, 60.0, 90.0), (1, 1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0))
    r = extracts.vitals(ids, vit).where("id = 1").first()
    assert (r["map"]["low"], r["map"]["high"], r["temperature"]["high"]) == (60.0, 80.0, 99.0)
    med = frame(
        spark, "id int, ORDER_ENTERED_DATE timestamp, MEDICATION_NAME string, MEDICATION_TYPE string, DAYS_ON_MEDICATION double",
        (1, D(-1), "NOREPINEPHRINE drip", "NSAID", 2.0), (2, D(1), "dopamine", "x", 1.0), (2, D(-1), "dopamine", "x", None), (3, D(-1), "other", "Inotrope", 3.0), (4, D(-9), "other", "ARB", 2.0), (5, D(-9), "epinephrine", None, 20.0),
    )
    more = ids.union(frame(spark, "id int, admit timestamp, disch timestamp, died_inp int", *((i, D(0), D(10), 0) for i in (3, 4, 5))))
    got = {r["id"]: (r["nephrotoxic"], r["vasoactive"], r["norepinephrine"], r["epinephrine"]) for r in extracts.medications(more, med).collect()}
    assert got == {1: (1, 1, 1, 0), 2: (0, 0, 0, 0), 3: (0, 1, 0, 0), 4: (1, 0, 0, 0), 5: (0, 1, 0, 1)}  # the fourth ended before admission, but began on a day that counts
    io = frame(spark, "id int, place int, IO_TOTALS_D0_INVALUE double, IO_TOTALS_D0_OUTVALUE double, IO_TOTALS_D1_INVALUE double, IO_TOTALS_D1_OUTVALUE double", (1, 0, 3000.0, 1000.0, 500.0, 0.0))
    f = extracts.fluids(ids, io, frame(spark, "id int, weight double", (1, 80.0))).where("id = 1").first()
    assert (f["net"], f["gross"], f["overload"]) == (2.0, 4.0, 2.5)
    dev = frame(spark, "id int, kind string, start timestamp, stop timestamp", (1, "vent", D(-1), D(2)), (2, "ecmo", D(5), D(6)))
    o = {r["id"]: r for r in extracts.organ_support(ids, dev).collect()}
    assert (o[1]["vent_used"], o[1]["vent_days"], o[1]["vent_free_days"], o[2]["mhs"], o[2]["vent_free_days"]) == (1, 2.0, 12.0, 0, 0.0)
    rrt = frame(spark, "id int, kind string, start timestamp, stop timestamp, place int", (1, "HD", D(1), D(2), 0), (1, "CRRT", D(2), D(9), 1))
    t = {r["id"]: (r["kind"], r["days"]) for r in extracts.treatment_flags(ids, rrt).collect()}
    assert t == {1: (2, 2), 2: (0, 0)}
    assert extracts.treatment_flags(ids, rrt, total=True).where("id = 1").first()["days"] == 4
    assert extracts.treatment_free_days(ids, rrt).where("id = 1").first()["free_7"] == 1
    dx = frame(spark, "id int, DIAGNOSIS_DESC string", (1, "SEPSIS"), (1, "Type 2 Diabetes"))
    assert tuple(extracts.diagnoses(ids, dx).where("id = 1").first())[1:] == (1, 1, 0)
    eav = frame(spark, "id int, place int, DAY_NO string, TERM_GRP_NAME string, D_MIN_VAL double, D_MAX_VAL double", (1, 0, "D0", "Na", 130.0, 140.0), (1, 1, "D0", "Na", 1.0, 1.0), (1, 2, "D1", "K", 3.0, 4.0))
    w = extracts.eav_wide(ids, eav, ["Na", "K"], ["D0", "D1"]).where("id = 1").first()
    assert (w["Na_D0_min"], w["Na_D0_max"], w["K_D1_max"], w["K_D0_min"]) == (130.0, 140.0, 4.0, None)
    m = extracts.mortality(more, frame(spark, "id int, DISCHARGE_DISPOSITION string", (1, "Home"), (2, "EXPIRED"), (3, "died"), (4, None)), frame(spark, "id int, DECEASED_DATE timestamp", (1, D(50)), (3, D(200)), (4, D(10))))
    got = {r["id"]: (r["died_inp"], r["died_90_admit"], r["died_120_disch"], r["death"]) for r in m.collect()}
    assert got == {1: (0, 1, 1, D(50)), 2: (1, 1, 1, D(10)), 3: (1, 0, 1, D(200)), 4: (1, 1, 1, D(10)), 5: (0, 0, 0, None)}
    cc, ex = ", ".join(f"CC_GRP_{i} int" for i in range(1, 15)), ", ".join(f"ELX_GRP_{i} int" for i in range(1, 32))
    smokes = frame(spark, "id int, place int, SMOKING_HISTORY_STATUS string, SMOKING_CURRENT_STATUS string", (1, 0, "FORMER SMOKER", "NO"), (2, 0, "YES", None), (3, 0, None, "YES"), (4, 0, "NEVER", "NO"))
    none = (frame(spark, f"id int, place int, CHARLSON_INDEX int, {cc}", (1, 0, 2, *[1] * 14)), frame(spark, f"id int, place int, {ex}", (1, 0, *[1] * 31)))
    c = {r["id"]: r for r in extracts.comorbidities(more, *none, smokes, [1.0] * 31).collect()}
    assert [c[i]["smoker"] for i in (1, 2, 3, 4, 5)] == [1, 0, 1, 0, 0] and (c[1]["charlson"], c[1]["elixhauser"]) == (2, 31.0)
    s = extracts.planned(ids, frame(spark, "id int, SURGERY_PERFORMED_DATE timestamp", (1, D(0, 20))))
    assert {r["id"]: r["planned"] for r in s.collect()} == {1: 0, 2: 1}


def test_codes_and_tables(spark):
    ids = frame(spark, "id int", (1,), (2,))
    got = joins.has_codes(ids, frame(spark, "id int, code string", (1, "250.01"), (2, "401")), frame(spark, "name string, pattern string", ("dm", "250.x"), ("ht", "401")), "id", "code", "name", "pattern", ["dm", "ht"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1, 0), (2, 0, 1)]
    t = frame(spark, "t string", ("EXPIRED - LESS THAN 48",), ("EXPIRED",), ("alive",), ("TRANSFER",), (" ",), ("left AMA",), ("home",))
    assert [r[0] for r in t.select(tables.disposition(F.col("t"))).collect()] == ["expired_early", None, "alive", "transferred", "blank", "against_advice", "other"]
    nan = cleaning.nan_to_null(frame(spark, "x double", (float("nan"),), (1.0,)))
    assert sorted((r[0] is None for r in nan.collect())) == [False, True]
    with pytest.raises(ValueError):
        cleaning.columns_named(["a"], ["b"])


def test_dtw_pairs_are_all_pairs(spark, monkeypatch):
    """Numbers with gaps, against the kernel pair by pair."""
    series = {1: [0.0, 1.0, 2.0], 2: [3.0], 10: [0.0, 0.0, 3.0, 1.0], 50: [2.0, 2.0], 51: [1.0, 3.0, 1.0]}
    monkeypatch.setattr(catalog, "_stage_arrays", lambda spark, d: spark.createDataFrame(list(series.items()), "id long, values array<double>"))
    got = {(r["id"], r["id2"]): r["distance"] for r in catalog.q_dtw_pairs(spark, "").collect()}
    costs = alignment.Costs.of_weights([1.0, 1.2, 1.5, 1.3], 0.35)
    expected = {(i, j): alignment.warp([np.array(series[i])], [np.array(series[j])], costs).distance[0] for i in series for j in series if i < j}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-6 for k in expected)


def weights_of(n):
    """Weights of the Shapiro-Wilk statistic by the published steps, on whole arrays."""
    from statistics import NormalDist

    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    q, u = (m**2).sum(), 1 / np.sqrt(n)
    a = m / np.sqrt(q)
    if n == 3:
        return np.array([-(0.5**0.5), 0, 0.5**0.5])
    a[-1] += sum(c * u**k for k, c in enumerate(evaluation.WEIGHTS[0], 1))
    outer = 1
    if n > 5:
        a[-2] += sum(c * u**k for k, c in enumerate(evaluation.WEIGHTS[1], 1))
        outer = 2
    rest = (q - 2 * (m[-outer:] ** 2).sum()) / (1 - 2 * (a[-outer:] ** 2).sum())
    a[outer:-outer] = m[outer:-outer] / np.sqrt(rest)
    a[:outer] = -a[-outer:][::-1]
    return a


def test_shapiro_by_whole_arrays(spark):
    """Groups of all sizes around the changes of the rule, with ties; p at published points: W = 0.9 of 10 and of 20 values."""
    r = np.random.default_rng(2)
    data = {f"n{n}": np.round(r.normal(size=n) if n % 2 else r.exponential(size=n), 1 if n > 20 else 4) for n in (3, 4, 5, 6, 11, 12, 50, 200)}
    data |= {"two": np.array([1.0, 2.0]), "same": np.full(9, 3.0), None: r.normal(size=30)}
    rows = [(g, float(x)) for g, v in data.items() for x in v] + [("n5", None), ("n6", float("nan"))]
    got = {x["g"]: x for x in evaluation.shapiro(spark.createDataFrame(rows, "g string, v double"), "v", "g").collect()}
    assert set(got) == set(data)
    for g, v in data.items():
        assert got[g]["n"] == len(v)
        if len(v) < 3:
            assert got[g]["w"] is None and got[g]["p"] is None
        elif g == "same":
            assert (got[g]["w"], got[g]["p"]) == (1.0, 1.0)
        else:
            w = (weights_of(len(v)) @ np.sort(v)) ** 2 / ((v - v.mean()) ** 2).sum()
            assert abs(got[g]["w"] - w) < 1e-9 and 0 <= got[g]["p"] <= 1
    assert got["n200"]["p"] < 1e-6 < 0.01 < got["n11"]["p"]


def test_chosen_by_normality(spark):
    r = np.random.default_rng(4)
    normal, skewed = r.normal(5, 1, 80), r.exponential(2, 80)
    for v, kind in ((normal, "median"), (skewed, "mean")):
        df = spark.createDataFrame([("a" if i % 2 else "b", float(x) + (3 if i % 2 else 0)) for i, x in enumerate(v)], "g string, v double") if kind == "mean" else spark.createDataFrame([("a" if i % 2 else "b", float(x)) for i, x in enumerate(v)], "g string, v double")
        got = {x["g"]: x for x in tables.chosen(df, "g", "v").collect()}
        assert {x["kind"] for x in got.values()} == {kind} and got["a"]["p"] is None and got["b"]["p"] is not None
        assert (got["b"]["mark"] == "**") == (kind == "mean")
    few = tables.chosen(spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 4.0)], "g string, v double"), "g", "v").collect()
    assert {x["g"]: x["p"] for x in few} == {"a": None, "b": 1.0, "Total": None}
    three = tables.chosen(spark.createDataFrame([(g, float(i)) for i, g in enumerate("abcabc")], "g string, v double"), "g", "v").collect()
    assert {x["p"] for x in three} == {None} and len(three) == 4


def test_places_of_ragged_arrays(spark):
    df = spark.createDataFrame([("x", [1.0, 2.0, 3.0]), ("x", [3.0, None]), ("x", []), ("x", None), ("y", [5.0])], "g string, v array<double>")
    got = {(r["g"], r["place"]): (r["n"], r["mean"], r["sd"], r["half"]) for r in trajectories.position_statistics(df, "v", "g").collect()}
    assert got["x", 0][:3] == (2, 2.0, 1.0) and abs(got["x", 0][3] - 12.7062047) < 1e-6
    assert got["x", 1] == (1, 2.0, 0.0, None) and got["x", 2] == (1, 3.0, 0.0, None) and got["y", 0] == (1, 5.0, 0.0, None) and len(got) == 4
    assert {r["g"]: list(r["v"]) for r in trajectories.position_means(df, "v", "g", 2).collect()} == {"x": [2.0, 2.0], "y": [5.0]}


def test_flow_sheet(spark):
    raw = [(1, p, t, d, lo, hi, su) for p, (t, d, lo, hi, su) in enumerate([
        ("HEIGHT", "D5", 60.0, None, None), ("HEIGHT", "D1", None, None, None), ("HEIGHT", "D3", 78.74, None, None), ("HEIGHT", "D0", 10.0, None, None), ("WEIGHT", "D0", 80.0, None, None),
        ("MAP", "D0", 60.0, 90.0, None), ("MAP", "D0", 1.0, 2.0, None), ("UOP", "D1", None, None, 1920.0), ("IN", "D0", None, None, 500.0), ("Out", "D0", None, None, 200.0), ("IN", "D1", None, None, 100.0), ("IN", "D1", None, None, 100.0),
        ("Out", "D1", None, None, 50.0), ("IN", "D3", None, None, 700.0), ("Out", "D3", None, None, 100.0)])]
    raw += [(2, 20, "IN", "D0", None, None, -500.0), (2, 21, "Out", "D0", None, None, 100.0)]
    ids = spark.createDataFrame([(1, dt.datetime(2020, 1, 1, 6), dt.datetime(2020, 1, 3, 12)), (2, dt.datetime(2020, 1, 1, 6), dt.datetime(2020, 1, 1, 18)), (3, dt.datetime(2020, 1, 1), dt.datetime(2020, 2, 1))], "id int, admit timestamp, disch timestamp")
    got = {r["id"]: r for r in extracts.flow_sheet(ids, spark.createDataFrame(raw, "id int, place int, TERM_GRP_NAME string, DAY_NO string, D_MIN_VAL double, D_MAX_VAL double, D_SUM_VAL double")).collect()}
    one, two, three = got[1], got[2], got[3]
    assert (one["height"], one["weight"], one["bmi"]) == (2.0, 80.0, 20.0) and tuple(one["map"][0]) == (60.0, 90.0) and one["map"][1]["low"] is None
    assert one["urine"] == [None, 1920.0, None] and one["urine_flow"] == [None, 1.0, None]
    assert (one["net"], one["gross"], one["balance"]) == (450.0, 700.0, 900.0) and abs(one["overload"] - 900 / 80 / (18 + 24 + 12) * 100) < 1e-9
    assert (two["net"], two["gross"], two["balance"], two["overload"]) == (None, None, -600.0, None)
    assert (three["height"], three["net"], three["gross"], three["balance"]) == (None, None, 0.0, 0.0)


@pytest.mark.parametrize("count", [1, 3])
def test_paired_values(spark, count):
    """By loops: values near each other are one, a value too far before uses up a turn."""
    r = np.random.default_rng(count)
    ref = dt.datetime(2024, 1, 1)
    rows = [(i, ref + dt.timedelta(minutes=int(m)), round(float(c), 2)) for i in range(30) for m, c in zip(np.round(r.choice([86, 87, 88, 90, 91, 40, 20, 3, 95], 7) * 1440 + r.integers(0, 200, 7)), r.uniform(0.5, 4, 7))]
    want = {}
    for i in range(30):
        v = sorted((abs(90 - d), d, c) for k, t, c in rows for d in [(t - ref).total_seconds() / 86400] if k == i and 7 < d < 94)
        if not v:
            continue
        taken, j, turns = [], 0, 0
        while j < len(v) and turns < count:
            if turns == 0 or v[0][1] - v[j][1] < 30:
                if j + 1 < len(v) and abs(v[j][1] - v[j + 1][1]) * 24 <= 2:
                    taken.append((v[j][2] + v[j + 1][2]) / 2)
                    j += 1
                else:
                    taken.append(v[j][2])
            j += 1
            turns += 1
        want[i] = (round(sum(taken) / len(taken), 9), len(taken))
    patients = spark.createDataFrame([(i, ref, 1, 0, 50) for i in range(30)], "id int, ref timestamp, male int, black int, age int")
    got = outcomes.paired_gfr(patients, spark.createDataFrame(rows, "id int, ts timestamp, creatinine double"), 4, count).collect()
    assert {x["id"]: (round(x["creatinine90"], 9), x["n_used"]) for x in got} == want and len({n for _, n in want.values()}) == count


def test_located_values(spark):
    v = frame(spark, "row int, id int, ts timestamp", (1, 1, D(1)), (2, 1, D(5)), (3, 1, D(9)), (4, 2, D(1)), (5, 1, None))
    icu = frame(spark, "id int, start timestamp, stop timestamp", (1, D(4), D(6)), (1, D(4), D(7)), (2, D(0), None))
    hospital = frame(spark, "id int, start timestamp, stop timestamp", (1, D(0), D(8)))
    on = frame(spark, "id int, kind string, start timestamp, stop timestamp", (1, "HD", D(0), D(0)), (1, "PD", D(4), D(5)), (1, "CRRT", D(3), None))
    got = {r["row"]: (r["place"], r["on_hd"], r["on_crrt"], r["on_pd"], r["on_any"]) for r in cohort.located_values(v, icu, hospital, on).collect()}
    assert got == {1: (1, 1, 0, 0, 1), 2: (2, 0, 1, 1, 1), 3: (0, 0, 0, 0, 0), 4: (0, 0, 0, 0, 0), 5: (0, 0, 0, 0, 0)}
