"""Stays, treatments, baselines and exclusions of a patient cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajecta.functions.renal import creatinine_at_gfr_mdrd, gfr_mdrd
from trajecta.functions.times import calendar_days, seconds_between
from trajecta.operators.joins import stab

#: Bits of the dialysis mask.
HD, CRRT, PD = 1, 2, 4


def merged_stays(stays: DataFrame, key: str = "id", start: str = "admit", stop: str = "disch", gap_days: float = 2.0) -> DataFrame:
    """(key, admit, disch) of stays joined while the next begins less than gap_days after the latest end so far."""
    order = W.partitionBy(key).orderBy(start, stop)
    s = stays.where(F.col(start).isNotNull() & F.col(stop).isNotNull())
    s = s.withColumn("__end", F.max(stop).over(order.rowsBetween(W.unboundedPreceding, -1)))
    new = F.col("__end").isNull() | (seconds_between(F.col("__end"), F.col(start)) >= gap_days * 86400)
    s = s.withColumn("__n", F.sum(new.cast("int")).over(order))
    return s.groupBy(key, "__n").agg(F.min(start).alias(start), F.max(stop).alias(stop)).drop("__n")


def folded_stays(stays: DataFrame, key: str = "id", start: str = "admit", stop: str = "disch", place: str = "place") -> DataFrame:
    """The literal fold of the source scripts, in file order: a later start widens to the hull, an earlier one counts only if it overlaps, an equal one never."""
    rows = stays.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(start).alias("a"), F.col(stop).alias("b")))).alias("__s"))
    first = F.get("__s", F.lit(0))

    def step(s: Column, x: Column) -> Column:
        later, earlier = x["a"] > s["a"], (x["a"] < s["a"]) & (x["b"] >= s["a"])
        return F.struct(F.when(earlier, x["a"]).otherwise(s["a"]).alias("a"), F.when(later | earlier, F.greatest(s["b"], x["b"])).otherwise(s["b"]).alias("b"))

    hull = F.aggregate(F.slice("__s", F.lit(2), F.greatest(F.size("__s") - 1, F.lit(0))), F.struct(first["a"].alias("a"), first["b"].alias("b")), step)
    return rows.select(key, hull["a"].alias(start), hull["b"].alias(stop))


def length_of_stay(stays: DataFrame, key: str = "id", start: str = "admit", stop: str = "disch") -> DataFrame:
    """(key, days) inside any stay, overlaps once."""
    m = merged_stays(stays, key, start, stop, 0.0)
    return m.groupBy(key).agg((F.sum(seconds_between(F.col(start), F.col(stop))) / 86400).alias("days"))


def dialysis_mask(values: DataFrame, treatments: DataFrame, key: str = "id", at: str = "ts", row: str = "row", closed: bool = True) -> DataFrame:
    """values with mask, the bits of the treatments (id, kind 'HD'/'CRRT'/'PD', start, stop) that run at the time or ended within 48 hours. row tells values apart."""
    met = stab(values.select(key, row, at), treatments.select(key, "kind", "start", "stop"), key, at, "start", "stop", 48, closed)
    bit = F.when(F.col("kind") == "HD", HD).when(F.col("kind") == "CRRT", CRRT).when(F.col("kind") == "PD", PD).otherwise(0)
    bits = met.groupBy(row).agg(F.bit_or(bit).alias("mask"))
    return values.join(bits, row, "left").withColumn("mask", F.coalesce("mask", F.lit(0)))


def located_values(values: DataFrame, icu: DataFrame, hospital: DataFrame, treatments: DataFrame, key: str = "id", at: str = "ts", row: str = "row", closed: bool = True) -> DataFrame:
    """values with place (2 in intensive care, 1 elsewhere in hospital, 0 outside), on_hd, on_crrt, on_pd and on_any (0/1).

    icu, hospital: (key, start, stop), one window a key or several. treatments as in `dialysis_mask`. Windows and treatments are met by
    `joins.stab`, each in a join of its own, and summed by row, so values are never multiplied; a null time is outside and on nothing.
    """
    inside = [stab(values.select(key, row, at), w.where(F.col("stop").isNotNull()).select(key, "start", "stop"), key, at, "start", "stop", 0).select(row, F.lit(k).alias("place")) for w, k in ((icu, 2), (hospital, 1))]
    place = inside[0].unionByName(inside[1]).groupBy(row).agg(F.max("place").alias("place"))
    out = dialysis_mask(values, treatments, key, at, row, closed).join(place, row, "left").withColumn("place", F.coalesce("place", F.lit(0)))
    on = {f"on_{n}": (F.col("mask").bitwiseAND(bit) > 0).cast("int") for n, bit in (("hd", HD), ("crrt", CRRT), ("pd", PD))}
    return out.withColumns(on).withColumn("on_any", (F.col("mask") > 0).cast("int")).drop("mask")


def baselines(values: DataFrame, patients: DataFrame, key: str = "id", outpatient: tuple[float, float] = (1, 365), inpatient: tuple[float, float] = (7, 365)) -> DataFrame:
    """(key, base, kind, base_at): creatinine before admission.

    values: id, ts, value, kind (text with 'inpatient' or not). patients: id, admit, male, black, age. The latest outpatient
    value at least a day before counts if it is between the limits (both open); else the latest inpatient one, at least 7 days before; else the
    creatinine at a filtration of 75. Two values at one time count as their mean.
    """
    v = values.join(patients.select(key, "admit"), key).where("value is not null")
    v = v.withColumn("age_days", seconds_between(F.col("ts"), F.col("admit")) / 86400).withColumn("inside", F.lower(F.coalesce("kind", F.lit(""))).contains("inpatient"))
    out = patients
    for name, (least, most), inside in (("OUTPATIENT", outpatient, False), ("INPATIENT", inpatient, True)):
        c = v.where((F.col("inside") == inside) & (F.col("age_days") >= least)).groupBy(key, "ts").agg(F.avg("value").alias("value"), F.min("age_days").alias("age_days"))
        c = c.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(F.col("ts").desc()))).where("__rn = 1")
        c = c.where((F.col("age_days") > least) & (F.col("age_days") < most)).select(key, F.col("value").alias(f"v_{name}"), F.col("ts").alias(f"t_{name}"))
        out = out.join(c, key, "left")
    solved = creatinine_at_gfr_mdrd(F.lit(75.0), F.col("male"), F.col("black"), F.col("age"))
    kind = F.when(F.col("v_OUTPATIENT").isNotNull(), "OUTPATIENT").when(F.col("v_INPATIENT").isNotNull(), "INPATIENT").otherwise("mdrd")
    return out.select(key, F.coalesce("v_OUTPATIENT", "v_INPATIENT", solved).alias("base"), kind.alias("kind"), F.coalesce("t_OUTPATIENT", "t_INPATIENT").alias("base_at"))


EXCLUSIONS = ("no_values", "one_value", "short_span", "no_sex_or_race", "no_birth_date", "no_admission_or_base", "high_base", "minor", "early_death", "esrd", "low_gfr", "transplant", "no_injury")


def exclusions(patients: DataFrame, values: DataFrame, stages: DataFrame, diagnoses: DataFrame, surgeries: DataFrame, key: str = "id", injury_day: int = 3) -> DataFrame:
    """(key, thirteen 0/1 flags, reason, kept).

    patients: id, male, black, birth, age, admit, base, death, esrd_status, esrd_registry, esrd_review (0/1 or null).
    values: id, ts. stages: id, day, stage. diagnoses: id, text, code. surgeries: id, text. Where status and registry differ the review decides; without one, either counts.
    """
    from trajecta.operators.cleaning import first_reason, none_set

    v = values.groupBy(key).agg(F.count("ts").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    injured = stages.where(F.col("day") <= injury_day).groupBy(key).agg(F.max("stage").alias("worst"))
    text = lambda c: F.upper(F.coalesce(F.col(c), F.lit("")))
    graft = lambda c: text(c).contains("TRANS") & (text(c).contains("KID") | text(c).contains("RENA"))
    d = diagnoses.groupBy(key).agg(F.max((graft("text") | text("code").isin("V42.0", "Z94.0")).cast("int")).alias("t1"))
    s = surgeries.groupBy(key).agg(F.max(graft("text").cast("int")).alias("t2"))
    p = patients
    for right in (v, injured, d, s):
        p = p.join(right, key, "left")
    n = F.coalesce("n", F.lit(0))
    differ = F.coalesce("esrd_status", F.lit(0)) != F.coalesce("esrd_registry", F.lit(0))
    esrd = F.when(differ & F.col("esrd_review").isNotNull(), F.col("esrd_review")).otherwise(F.greatest(F.coalesce("esrd_status", F.lit(0)), F.coalesce("esrd_registry", F.lit(0)))) == 1
    gfr = gfr_mdrd(F.col("base"), F.col("male"), F.col("black"), F.col("age"))
    tests = [
        n == 0, n == 1, (n > 1) & (seconds_between(F.col("first"), F.col("last")) < 6 * 3600), F.col("male").isNull() | F.col("black").isNull(), F.col("birth").isNull(), F.col("admit").isNull() | F.col("base").isNull(),
        F.col("base") >= 4, F.col("age") < 18, calendar_days(F.col("admit"), F.col("death")) <= 3, esrd, gfr < 15, (F.coalesce("t1", F.lit(0)) + F.coalesce("t2", F.lit(0))) > 0, F.coalesce("worst", F.lit(0)) == 0,
    ]
    flags = [(name, F.coalesce(c, F.lit(False))) for name, c in zip(EXCLUSIONS, tests)]
    out = p.select(key, *(c.cast("int").alias(name) for name, c in flags))
    return out.withColumn("reason", first_reason([(name, F.col(name) == 1) for name in EXCLUSIONS])).withColumn("kept", none_set(list(EXCLUSIONS)))


def esrd_flags(patients: DataFrame, status: DataFrame, registry: DataFrame, review: DataFrame, key: str = "id") -> DataFrame:
    """(key, before, at_admission, during by the status table; before, during by registry; before, during by review)."""
    yes = lambda c: F.coalesce(F.max((F.col(c) == "Y").cast("int")), F.lit(0))
    s = status.groupBy(key).agg(yes("before").alias("status_before"), yes("at_admission").alias("status_admission"), yes("during").alias("status_during"))
    r = registry.groupBy(key).agg(F.min("failed_on").alias("f"))
    m = review.groupBy(key).agg(F.max("before").alias("review_before"), F.max("during").alias("review_during"))
    out = patients.select(key, "admit", "disch").join(s, key, "left").join(r, key, "left").join(m, key, "left")
    out = out.withColumns({"registry_before": (F.col("f") < F.col("admit")).cast("int"), "registry_during": F.col("f").between(F.col("admit"), F.col("disch")).cast("int")})
    names = ["status_before", "status_admission", "status_during", "registry_before", "registry_during", "review_before", "review_during"]
    return out.select(key, *(F.coalesce(n, F.lit(0)).alias(n) for n in names))
