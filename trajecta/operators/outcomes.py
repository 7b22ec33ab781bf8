"""Adverse kidney outcomes within 90 days: death, kidney failure, dialysis at discharge, loss of filtration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajecta.functions.renal import gfr_mdrd
from trajecta.functions.times import seconds_between

DAYS = 90


def _days(a: Column, b: Column) -> Column:
    return seconds_between(a, b) / 86400


def late_gfr(patients: DataFrame, values: DataFrame, buffer: int, count: int, min_day: int, key: str = "id", whole_days: bool = True) -> DataFrame:
    """(key, gfr90, n_used, nearest): mean filtration of up to `count` values nearest to day 90, fewer while they span over 30 days.

    patients: id, ref, male, black, age. values: id, ts, creatinine. Only values more than min_day days (whole days, or
    exact ones) after the reference and before day 90 + buffer count.
    """
    f = values.join(patients.select(key, "ref", "male", "black", "age"), key)
    after = _days(F.col("ref"), F.col("ts"))
    f = f.where((after > 0) & (after < DAYS + buffer) & ((F.floor(after) if whole_days else after) > min_day))
    f = f.withColumn("gfr", gfr_mdrd(F.col("creatinine"), F.col("male"), F.col("black"), F.col("age"))).withColumn("off", F.floor(DAYS - after).cast("int"))
    near = W.partitionBy(key).orderBy(F.abs("off"), "ts", "creatinine")
    f = f.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= count)
    run = near.rowsBetween(W.unboundedPreceding, 0)
    f = f.withColumn("span", F.max("off").over(run) - F.min("off").over(run)).withColumn("mean", F.avg("gfr").over(run))
    # the largest number of nearest values whose span is at most 30 days; one value always is
    return f.where((F.col("span") <= 30) | (F.col("rank") == 1)).groupBy(key).agg(F.max_by("mean", "rank").alias("gfr90"), F.max("rank").alias("n_used"), F.min_by("off", "rank").alias("nearest"))


def kidney_outcomes(
    patients: DataFrame, values: DataFrame, dialysis: DataFrame, review: DataFrame, status: DataFrame, registry: DataFrame,
    key: str = "id", reference: str = "discharge", buffer: int = 0, count: int = 1, min_day: int = 7, evaluate_all: bool = False, whole_days: bool = True,
) -> DataFrame:
    """The components and composites (d25, d30, d50) of each patient.

    patients: id, icu_admit, icu_disch, hosp_disch, died_inp, death, male, black, age, baseline_gfr. dialysis: id, start,
    stop. review: id, during, rrt_dependent. status: id, during ('Y'). registry: id, failed_on. All components but death count only for
    those not dead within 90 days, and the loss only for those not on dialysis at discharge, unless evaluate_all.
    """
    p = patients.withColumn("ref", F.col("icu_disch") if reference == "discharge" else F.col("icu_admit"))
    until = _days(F.col("ref"), F.col("death"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    p = p.withColumns({"died_inp": flag(F.col("died_inp") > 0), "died_90": flag(until < DAYS), "died_window": flag(until < DAYS + buffer)})
    reviewed = review.groupBy(key).agg(F.max(flag(F.col("during") == 1)).alias("esrd_review"), F.max(flag(F.col("rrt_dependent") == 1)).alias("dialysis_review"))
    known = status.groupBy(key).agg(F.max(flag(F.col("during") == "Y")).alias("esrd_status"))
    listed = registry.groupBy(key).agg(F.min("failed_on").alias("failed_on"))
    ends = dialysis.where("start is not null").join(p.select(key, "hosp_disch", "ref"), key).where(F.col("hosp_disch") < F.col("ref") + F.expr(f"interval {DAYS + buffer} days"))
    last = F.col("hosp_disch") - F.expr("interval 2 days")
    on = ((F.col("start") < last) & (F.col("stop") > last)) | ((F.col("start") >= last) & (F.col("start") < F.col("hosp_disch")))
    dependent = ends.groupBy(key).agg(F.max(flag(on)).alias("dialysis"))
    gfr = late_gfr(p, values, buffer, count, min_day, key, whole_days)
    for right in (reviewed, known, listed, dependent, gfr):
        p = p.join(right, key, "left")
    after = _days(F.col("ref"), F.col("failed_on"))
    alive = F.lit(True) if evaluate_all else F.col("died_90") == 0
    off = F.lit(True) if evaluate_all else F.coalesce("dialysis", F.lit(0)) == 0
    kept = lambda c: F.when(alive, F.coalesce(c, F.lit(0))).otherwise(0)
    share = F.try_divide(F.col("gfr90"), F.col("baseline_gfr")) * 100
    parts = {
        "esrd_review": kept(F.col("esrd_review")), "dialysis_review": kept(F.col("dialysis_review")), "esrd_status": kept(F.col("esrd_status")),
        "esrd_90": kept(flag((after > 0) & (after < DAYS))), "esrd_window": kept(flag((after > 0) & (after < DAYS + buffer))), "dialysis": kept(F.col("dialysis")),
        **{f"drop_{k}": F.when(off, kept(flag(share < 100 - k))).otherwise(0) for k in (25, 30, 50)},
    }
    p = p.withColumns(parts)
    every = ["died_inp", "died_90", "died_window", "esrd_review", "esrd_status", "esrd_90", "esrd_window", "dialysis_review", "dialysis"]
    return p.select(key, *every, "drop_25", "drop_30", "drop_50", "n_used", "nearest", *(F.greatest(*every, f"drop_{k}").alias(f"d{k}") for k in (25, 30, 50)))


def cross_table(make: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """(setting, n, share of each composite) of outcome tables under several settings."""
    out = None
    for name, df in make:
        one = df.agg(F.lit(name).alias("setting"), F.count("*").alias("n"), *(F.avg(c).alias(c) for c in ("d25", "d30", "d50")))
        out = one if out is None else out.unionByName(one)
    return out


def free_days(stay_days: Column, died: Column, span: int = 28) -> Column:
    """Days of the span outside; 0 if the patient died or stayed longer."""
    return F.when(died == 1, 0.0).otherwise(F.greatest(F.lit(0.0), span - stay_days))


def paired_gfr(patients: DataFrame, values: DataFrame, buffer: int = 0, count: int = 1, min_day: float = 7, key: str = "id", hours: float = 2.0) -> DataFrame:
    """(key, creatinine90, gfr90, n_used): the second cohort's rule, by values in order of their distance from day 90.

    The nearest value counts, and up to `count` in all of those that lie less than 30 days before it or at any time after it; one that doesn't
    uses up its turn. A value and the next one in that order are one, their mean, if they are at most `hours` apart. The filtration is that of the
    values' mean. patients: id, ref, male, black, age; values: id, ts, creatinine. Patients without a value have no row.
    """
    f = values.join(patients.select(key, "ref", "male", "black", "age"), key).withColumn("day", _days(F.col("ref"), F.col("ts")))
    f = f.where((F.col("day") > min_day) & (F.col("day") < DAYS + buffer))
    listed = F.array_sort(F.collect_list(F.struct(F.abs(DAYS - F.col("day")).alias("off"), F.col("ts").alias("ts"), F.col("creatinine").cast("double").alias("v"), F.col("day").alias("day"))))  # a patient's values of some months
    g = f.groupBy(key).agg(listed.alias("l"), *(F.first(c).alias(c) for c in ("male", "black", "age")))
    g = g.withColumn("l", F.transform("l", lambda x, i: F.struct(x["v"].alias("v"), x["day"].alias("day"), F.get("l", i + 1)["v"].alias("next"), F.coalesce(F.abs(x["day"] - F.get("l", i + 1)["day"]) * 24 <= hours, F.lit(False)).alias("paired"))))

    def step(s: Column, x: Column) -> Column:
        value = F.when(x["paired"], (x["v"] + x["next"]) / 2).otherwise(x["v"])
        first = s["turns"] == 0
        turn = ~s["skip"] & (s["turns"] < count)
        taken = turn & (first | (s["day"] - x["day"] < 30))
        return F.struct(
            (taken & x["paired"]).alias("skip"), (s["turns"] + turn.cast("int")).alias("turns"), (s["n"] + taken.cast("int")).alias("n"), F.when(taken, s["total"] + value).otherwise(s["total"]).alias("total"), F.when(first, x["day"]).otherwise(s["day"]).alias("day"),
        )

    start = F.struct(F.lit(False).alias("skip"), F.lit(0).alias("turns"), F.lit(0).alias("n"), F.lit(0.0).alias("total"), F.lit(0.0).alias("day"))
    g = g.withColumn("s", F.aggregate("l", start, step)).withColumn("creatinine90", F.col("s.total") / F.col("s.n"))
    return g.select(key, "creatinine90", gfr_mdrd(F.col("creatinine90"), F.col("male"), F.col("black"), F.col("age")).alias("gfr90"), F.col("s.n").alias("n_used"))
