"""Static patient features from raw clinical tables. Each returns one row for each id of `ids` (id, admit, disch where windows matter).

The raw tables have the columns of trajecta.sources.schemas, with the patient column renamed to id; file order is the column `place`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.functions.times import calendar_days, seconds_between
from trajecta.operators.joins import first_match_left, overlap
from trajecta.operators.scores import weighted_flags

#: Fixed names that mark a vasoactive drug; the first that fits counts (norepinephrine before epinephrine).
VASOACTIVE = ("dopamine", "dobutamine", "milrinone", "norepinephrine", "epinephrine", "phenylephrine", "vasopressin")

#: Fixed names of types of medication.
NEPHROTOXIC_TYPES = ("acei", "ace inhibitors", "angiotensin receptor blockers", "arb", "aminoglycosides", "nsaids")
VASOACTIVE_TYPES = ("presor", "inotrope", "presor or inotrope")


def low_high(name: str, low: Column, high: Column) -> Column:
    return F.struct(low.cast("double").alias("low"), high.cast("double").alias("high")).alias(name)


def vitals(ids: DataFrame, raw: DataFrame) -> DataFrame:
    """Temperature, mean pressure and heart rate of day 1; the arterial pressure, or the cuff's where its low is missing."""
    f = first_match_left(ids.select("id"), raw, "id", "place")
    cuff = F.col("ART_MEAN_D1_LOW_VALUE").isNull()
    pick = lambda s: F.when(cuff, F.col(f"CUFF_MEAN_D1_{s}_VALUE")).otherwise(F.col(f"ART_MEAN_D1_{s}_VALUE"))
    return f.select("id", low_high("temperature", F.col("TEMPERATURE_D1_LOW_VALUE"), F.col("TEMPERATURE_D1_HIGH_VALUE")), low_high("map", pick("LOW"), pick("HIGH")), low_high("heart_rate", F.col("HEART_RATE_D1_LOW_VALUE"), F.col("HEART_RATE_D1_HIGH_VALUE")))


def urine(ids: DataFrame, raw: DataFrame, weights: DataFrame, max_day: int = 3) -> DataFrame:
    """(id, per_hour, per_kg_hour): catheter and voided volumes of days 0 to max_day over the hours of the stay they cover.

    A stay that ends within max_day days counts to its end.
    """
    f = first_match_left(ids, raw, "id", "place").join(weights, "id", "left")
    cols = [f"U0_{k}_D{j}_VALUE" for j in range(max_day + 1) for k in ("INDWELLING_URETHRAL_CATHTER", "VOIDED_ML") if f"U0_{k}_D{j}_VALUE" in raw.columns]
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
    end = F.date_trunc("DAY", F.col("admit")) + F.expr(f"interval {max_day + 1} days")
    hours = seconds_between(F.col("admit"), F.least(end, F.col("disch"))) / 3600
    rate = F.try_divide(total, hours)
    return f.select("id", rate.alias("per_hour"), F.try_divide(rate, F.col("weight")).alias("per_kg_hour"))


def medications(ids: DataFrame, raw: DataFrame, max_day: int = 1) -> DataFrame:
    """(id, nephrotoxic, vasoactive, one 0/1 column a vasoactive drug).

    Orders with a known duration, entered by admission, count if they reach beyond it or begin on at most max_day days after. The type
    decides for nephrotoxic; the type or the name for vasoactive; of a name with several drugs the first of VASOACTIVE counts.
    """
    met = ids.select("id", "admit").join(raw, "id").where((F.col("ORDER_ENTERED_DATE") <= F.col("admit")) & F.col("DAYS_ON_MEDICATION").isNotNull() & ~F.isnan(F.col("DAYS_ON_MEDICATION").cast("double")))
    stop = F.col("ORDER_ENTERED_DATE").cast("timestamp") + F.make_dt_interval(secs=F.col("DAYS_ON_MEDICATION").cast("double") * 86400)
    met = met.where((stop > F.col("admit").cast("timestamp")) | (F.datediff("ORDER_ENTERED_DATE", "admit") <= max_day))
    name = F.lower(F.coalesce("MEDICATION_NAME", F.lit("")))
    drug = F.lit(None).cast("string")
    for d in reversed(VASOACTIVE):
        drug = F.when(name.contains(d), d).otherwise(drug)
    kind = F.lower("MEDICATION_TYPE")
    within = lambda names: sum((F.lit(n).contains(kind).cast("int") for n in names), F.lit(0)) > 0  # noqa: E731  a type that is part of a name counts too
    vaso = F.coalesce(within(VASOACTIVE_TYPES), F.lit(False)) | drug.isNotNull()
    sums = met.groupBy("id").agg(F.max(F.coalesce(within(NEPHROTOXIC_TYPES), F.lit(False)).cast("int")).alias("nephrotoxic"), F.max(vaso.cast("int")).alias("vasoactive"), *(F.max((drug == d).cast("int")).alias(d) for d in VASOACTIVE))
    return ids.select("id").join(sums, "id", "left").fillna(0)


def mortality(ids: DataFrame, admissions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(id, died_inp, died_90_admit, died_120_admit, died_90_disch, died_120_disch, death, days).

    A disposition of death is one in hospital and within 90 and 120 days of discharge, whatever date is recorded. The recorded date,
    else the discharge after such a disposition, is the death; one on or before the day of discharge is in hospital.
    """
    said = admissions.groupBy("id").agg(F.max(F.upper("DISCHARGE_DISPOSITION").rlike("EXPIRED|DIED").cast("int")).alias("said"))
    on = outcomes.groupBy("id").agg(F.max("DECEASED_DATE").alias("recorded"))
    f = ids.join(said, "id", "left").join(on, "id", "left")
    f = f.withColumn("death", F.coalesce(F.col("recorded"), F.when(F.col("said") == 1, F.col("disch"))))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    named = F.coalesce(F.col("said") == 1, F.lit(False))
    out: dict[str, Column] = {"died_inp": F.greatest(named.cast("int"), flag(F.to_date("death") <= F.to_date("disch")))}
    for n in (90, 120):
        out[f"died_{n}_admit"] = flag(seconds_between(F.col("admit"), F.col("death")) < n * 86400)
        out[f"died_{n}_disch"] = F.greatest(named.cast("int"), flag(seconds_between(F.col("disch"), F.col("death")) < n * 86400))
    return f.select("id", *(c.alias(n) for n, c in out.items()), "death", (seconds_between(F.col("admit"), F.col("death")) / 86400).alias("days"))


def comorbidities(ids: DataFrame, charlson: DataFrame, elixhauser: DataFrame, smoking: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Charlson index (null if not above 0), weighted Elixhauser sum, the component arrays, diabetes and hypertension components, smoker."""
    c = first_match_left(ids.select("id"), charlson, "id", "place")
    cc = [F.col(f"CC_GRP_{i}") for i in range(1, 15)]
    ex = [F.col(f"ELX_GRP_{i}") for i in range(1, 32)]
    c = c.select("id", F.when(F.col("CHARLSON_INDEX") > 0, F.col("CHARLSON_INDEX")).alias("charlson"), F.array(*cc).alias("charlson_parts"))
    e = first_match_left(ids.select("id"), elixhauser, "id", "place")
    e = e.select("id", weighted_flags(ex, weights).alias("elixhauser"), F.array(*ex).alias("elixhauser_parts"), F.greatest(ex[9], ex[10]).alias("diabetic"), F.greatest(ex[4], ex[5]).alias("hypertensive"))
    smokes = (F.col("SMOKING_HISTORY_STATUS") == "FORMER SMOKER") | (F.col("SMOKING_CURRENT_STATUS") == "YES")
    s = first_match_left(ids.select("id"), smoking, "id", "place").select("id", F.coalesce(smokes, F.col("SMOKING_CURRENT_STATUS") == "YES", F.col("SMOKING_HISTORY_STATUS") == "FORMER SMOKER", F.lit(False)).cast("int").alias("smoker"))
    return c.join(e, "id").join(s, "id")


def fluids(ids: DataFrame, raw: DataFrame, weights: DataFrame, max_day: int = 1) -> DataFrame:
    """(id, net, gross, overload, balance): mean litres a day over days 0 to max_day that have both volumes above 0; overload is net by weight in percent."""
    f = first_match_left(ids.select("id"), raw, "id", "place")
    days = F.array(*(F.struct(F.col(f"IO_TOTALS_D{j}_INVALUE").alias("i"), F.col(f"IO_TOTALS_D{j}_OUTVALUE").alias("o")) for j in range(max_day + 1)))
    f = f.select("id", F.explode(days).alias("d")).where("d.i > 0 and d.o > 0")
    g = f.groupBy("id").agg((F.avg(F.col("d.i") - F.col("d.o")) / 1000).alias("net"), (F.avg(F.col("d.i") + F.col("d.o")) / 1000).alias("gross"), (F.sum(F.col("d.i") - F.col("d.o")) / 1000).alias("balance"))
    return ids.select("id").join(g, "id", "left").join(weights, "id", "left").select("id", "net", "gross", (F.try_divide(F.col("net"), F.col("weight")) * 100).alias("overload"), "balance")


def organ_support(ids: DataFrame, devices: DataFrame, max_day: int = 1, span: int = 14) -> DataFrame:
    """Per kind of device (vent, ecmo, vad, iabp): used within max_day calendar days of admission, days in the span, free days. devices: id, kind, start, stop.

    mhs is any of the three circulatory devices. A patient who died has no free days.
    """
    stays = ids.select("id", "admit", F.least(F.col("disch"), F.col("admit") + F.expr(f"interval {span} days")).alias("until"))
    met = overlap(stays, devices, "id", ("admit", "until"), ("start", "stop"))
    g = met.groupBy("id", "kind").agg(F.max((calendar_days(F.col("admit"), F.col("start")) <= max_day).cast("int")).alias("used"), (F.sum(seconds_between(F.col("w_start"), F.col("w_stop"))) / 86400).alias("days"))
    wide = g.groupBy("id").pivot("kind", ["vent", "ecmo", "vad", "iabp"]).agg(F.first("used").alias("used"), F.first("days").alias("days"))
    out = ids.select("id", "died_inp").join(wide, "id", "left").fillna(0)
    free = F.when(F.col("died_inp") == 1, 0.0).otherwise(F.greatest(F.lit(0.0), span - F.col("vent_days")))
    return out.withColumn("vent_free_days", free).withColumn("mhs", F.greatest("ecmo_used", "vad_used", "iabp_used")).drop("died_inp")


def body(ids: DataFrame, raw: DataFrame) -> DataFrame:
    """Height in metres, weight (0 is missing), body mass index, FiO2, respiration, and the two values of a coma scale text 'a-b'."""
    f = first_match_left(ids.select("id"), raw, "id", "place")
    height, weight = F.col("HEIGHT_CM_VALUE") / 100, F.nullif(F.col("INITIAL_WEIGHT_KG"), F.lit(0.0))
    gcs = lambda i: F.expr(f"try_cast(split_part(GLASGOW_SCORE_D1_LOW_VALUE, '-', {i}) as double)")
    return f.select("id", height.alias("height"), weight.alias("weight"), F.try_divide(weight, height * height).alias("bmi"), low_high("fio2", F.col("FI02_D1_LOW_VALUE"), F.col("FI02_D1_HIGH_VALUE")), low_high("respiration", F.col("RESP_RATE_D1_LOW_VALUE"), F.col("RESP_RATE_D1_HIGH_VALUE")), low_high("gcs", gcs(1), gcs(2)))


def planned(ids: DataFrame, surgeries: DataFrame) -> DataFrame:
    """(id, planned): 0 with a surgery within a day of admission, else 1."""
    near = surgeries.join(ids.select("id", "admit"), "id").where(F.abs(seconds_between(F.col("admit"), F.col("SURGERY_PERFORMED_DATE"))) <= 86400).select("id").distinct()
    return ids.select("id").join(near.withColumn("__near", F.lit(True)), "id", "left").select("id", F.when(F.col("__near"), 0).otherwise(1).alias("planned"))


def demographics(ids: DataFrame, raw: DataFrame, births: DataFrame) -> DataFrame:
    """(id, male, race, age): race 0 white, 1 black, 2 other; age in years of 365 days at admission."""
    f = first_match_left(first_match_left(ids, raw, "id", "place"), births.withColumnRenamed("place", "place_b") if "place" in births.columns else births, "id", *(["place_b"] if "place" in births.columns else ["DOB"]))
    race = F.upper(F.coalesce("RACE", F.lit("")))
    return f.select("id", F.when(F.upper("GENDER").startswith("M"), 1).when(F.upper("GENDER").startswith("F"), 0).alias("male"), F.when(race.contains("WHITE"), 0).when(race.contains("BLACK"), 1).otherwise(2).alias("race"), (seconds_between(F.col("DOB").cast("timestamp"), F.col("admit")) / (365 * 86400)).alias("age"))


def treatment_flags(ids: DataFrame, treatments: DataFrame, end_day: int = 3, total: bool = False) -> DataFrame:
    """(id, kind, days) of dialysis that touches the calendar days of admission to end_day: kind 0 none, 1 HD, 2 CRRT; days, ends included.

    Days of a patient's last row count, or with `total` the sum over rows clipped to the window.
    """
    met = treatments.where("start is not null").join(ids.select("id", "admit", "disch"), "id")
    first, last = F.to_date("admit"), F.date_add(F.to_date("admit"), end_day)
    a, b = F.greatest(F.to_date("start"), first), F.least(F.to_date(F.coalesce("stop", "start")), last)
    met = met.withColumn("n", F.date_diff(b, a) + 1).where("n > 0")
    days = F.sum("n") if total else F.max_by("n", "place")
    g = met.groupBy("id").agg(F.max(F.when(F.col("kind") == "CRRT", 2).when(F.col("kind") == "HD", 1).otherwise(0)).alias("kind"), days.alias("days"))
    return ids.select("id").join(g, "id", "left").fillna(0)


def treatment_days(ids: DataFrame, treatments: DataFrame, span: int = 7) -> DataFrame:
    """(id, kind, days, free_days, n): fractional days of each kind within the stay's first `span` days, overlaps of rows counted apart; null without any."""
    stays = ids.select("id", "died_inp", "admit", F.least(F.col("disch"), F.col("admit") + F.expr(f"interval {span} days")).alias("until"))
    met = overlap(stays, treatments, "id", ("admit", "until"), ("start", "stop"))
    g = met.groupBy("id", "kind").agg((F.sum(seconds_between(F.col("w_start"), F.col("w_stop"))) / 86400).alias("days"), F.count("*").alias("n"), F.max("died_inp").alias("d"))
    return g.select("id", "kind", "days", F.when(F.col("d") == 1, 0.0).otherwise(F.greatest(F.lit(0.0), span - F.col("days"))).alias("free_days"), "n")


def treatment_free_days(ids: DataFrame, treatments: DataFrame, spans: Sequence[int] = (7, 28)) -> DataFrame:
    """(id, free_s for each span): calendar days from admission on without dialysis."""
    most = max(spans)
    met = treatments.where("start is not null").join(ids.select("id", "admit"), "id")
    days = F.sequence(F.to_date("start"), F.greatest(F.to_date(F.coalesce("stop", "start")), F.to_date("start")))
    met = met.withColumn("d", F.explode(days)).select("id", F.date_diff("d", F.to_date("admit")).alias("day"))
    used = met.where((F.col("day") >= 0) & (F.col("day") < most)).distinct().groupBy("id").agg(*(F.count(F.when(F.col("day") < s, 1)).alias(f"used_{s}") for s in spans))
    return ids.select("id").join(used, "id", "left").select("id", *((F.lit(s) - F.coalesce(f"used_{s}", F.lit(0))).alias(f"free_{s}") for s in spans))


def diagnoses(ids: DataFrame, raw: DataFrame, text: str = "DIAGNOSIS_DESC") -> DataFrame:
    """(id, septic, diabetic, hypertensive) by words in any diagnosis."""
    t = F.lower(F.coalesce(text, F.lit("")))
    g = raw.groupBy("id").agg(*(F.max(t.contains(w).cast("int")).alias(n) for n, w in (("septic", "sep"), ("diabetic", "diabe"), ("hypertensive", "hypert"))))
    return ids.select("id").join(g, "id", "left").fillna(0)


def eav_wide(ids: DataFrame, raw: DataFrame, terms: Sequence[str], days: Sequence[str], values: Sequence[str] = ("D_MIN_VAL", "D_MAX_VAL")) -> DataFrame:
    """One (min, max) pair of columns for each term and day of an entity-attribute-value table; the first row of a cell counts."""
    cells = [f"{t}_{d}" for t in terms for d in days]
    f = raw.where(F.col("TERM_GRP_NAME").isin(list(terms)) & F.col("DAY_NO").isin(list(days))).withColumn("__cell", F.concat_ws("_", "TERM_GRP_NAME", "DAY_NO"))
    wide = f.groupBy("id").pivot("__cell", cells).agg(*(F.min_by(v, "place").alias(n) for v, n in zip(values, ("min", "max"))))
    return ids.select("id").join(wide, "id", "left")


def flow_cube(raw: DataFrame, terms: Sequence[str], days: Sequence[str]) -> DataFrame:
    """(id, term, day, low, high, total, n): the first row of each patient, term and day of an entity-attribute-value table and how many rows it has, in one sum.

    Terms and days that aren't wanted don't reach the shuffle; a cell without rows has no row here.
    """
    cells = raw.where(F.col("TERM_GRP_NAME").isin(list(terms)) & F.col("DAY_NO").isin(list(days)))
    first = F.min_by(F.struct("D_MIN_VAL", "D_MAX_VAL", "D_SUM_VAL"), "place")
    by = cells.groupBy("id", F.col("TERM_GRP_NAME").alias("term"), F.col("DAY_NO").alias("day")).agg(first.alias("f"), F.count("*").alias("n"))
    return by.select("id", "term", "day", F.col("f.D_MIN_VAL").alias("low"), F.col("f.D_MAX_VAL").alias("high"), F.col("f.D_SUM_VAL").alias("total"), "n")


#: Fixed names of the flow sheet's terms, and inches to a metre as the source divides.
VITALS = {"temperature": "TEMPERATURE", "map": "MAP", "heart_rate": "HEART RATE", "glasgow": "GLASGOW SCORE", "respiration": "RESPIRATORY RATE"}
HEIGHT, WEIGHT, URINE, TAKEN, GIVEN_OFF = "HEIGHT", "WEIGHT", "UOP", "IN", "Out"
INCHES = 39.37


def flow_sheet(ids: DataFrame, raw: DataFrame, max_day: int = 3) -> DataFrame:
    """(id, height, weight, bmi, VITALS, urine, urine_flow, net, gross, balance, overload). ids: (id, admit, disch).

    height (m) and weight are the first known of the days 0 to `max_day`, in the table's order. Each vital sign is an array of (low, high)
    by day, and urine and its flow (by weight and hour) arrays by day, for days 0 to 2; what is missing is null. Fluids of a day count only if
    it has one row of intake and one of output: net is the mean over days of in less out, balance its sum (0 without a day), gross the sum of in and
    out over days 0 to 2 (0 without one); a negative gross makes net and gross null. overload: balance by weight and hours within the stay's first days, in percent.
    """
    days = [f"D{k}" for k in range(max_day + 1)]
    sized = raw.where(F.col("DAY_NO").isin(days) & F.col("D_MIN_VAL").isNotNull() & ~F.isnan(F.col("D_MIN_VAL").cast("double")))
    size = sized.groupBy("id").agg(*(F.min_by(F.when(F.col("TERM_GRP_NAME") == t, F.col("D_MIN_VAL").cast("double")), F.when(F.col("TERM_GRP_NAME") == t, F.col("place"))).alias(n) for n, t in (("inches", HEIGHT), ("weight", WEIGHT))))
    cube = flow_cube(raw, [*VITALS.values(), URINE, TAKEN, GIVEN_OFF], days)
    cells = cube.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("@", "term", "day"), F.struct("low", "high", "total", "n")))).alias("m"))  # one entry a term and day

    def cell(term: str, day: str) -> Column:
        return F.try_element_at("m", F.lit(f"{term}@{day}"))

    def total(term: str, day: str) -> Column:
        return F.when(cell(term, day)["n"] == 1, cell(term, day)["total"].cast("double"))

    def over(parts: list[Column]) -> Column:
        return sum((F.coalesce(x, F.lit(0.0)) for x in parts), F.lit(0.0))

    f = ids.select("id", "admit", "disch").join(size, "id", "left").join(cells, "id", "left")
    height = F.col("inches") / INCHES
    nets, sums = [total(TAKEN, d) - total(GIVEN_OFF, d) for d in days], [total(TAKEN, d) + total(GIVEN_OFF, d) for d in days[:3]]
    n_days = sum((x.isNotNull().cast("int") for x in nets), F.lit(0))
    apart = F.datediff("disch", "admit")
    first = 24 - F.hour("admit")
    hours = F.when(apart == 0, F.timestamp_diff("MICROSECOND", F.col("admit"), F.col("disch")) / 3.6e9).when(apart > max_day, first + max_day * 24).otherwise(first + (apart - 1) * 24 + F.hour("disch"))
    wrong = over(sums) < 0
    urine = [cell(URINE, d)["total"].cast("double") for d in days[:3]]
    return f.select(
        "id", height.alias("height"), "weight", F.try_divide(F.col("weight"), height * height).alias("bmi"),
        *(F.array(*(F.struct(cell(t, d)["low"].cast("double").alias("low"), cell(t, d)["high"].cast("double").alias("high")) for d in days[:3])).alias(n) for n, t in VITALS.items()),
        F.array(*urine).alias("urine"), F.array(*(F.try_divide(u, F.col("weight")) / 24 for u in urine)).alias("urine_flow"),
        F.when(~wrong, F.try_divide(over(nets), n_days)).alias("net"), F.when(~wrong, over(sums)).alias("gross"), over(nets).alias("balance"), (F.try_divide(F.try_divide(over(nets), F.col("weight")), hours) * 100).alias("overload"),
    )


def class_flags(ids: DataFrame, raw: DataFrame, classes: Sequence[str]) -> DataFrame:
    """(id, each class column's largest value, 0 if none)."""
    return ids.select("id").join(raw.groupBy("id").agg(*(F.max(c).alias(c) for c in classes)), "id", "left").fillna(0, list(classes))


def death_date(ids: DataFrame, raw: DataFrame, columns: Sequence[str], registry: DataFrame | None = None, last: bool = False) -> DataFrame:
    """(id, death): the first (or last) date column that is known; a registry's date before it."""
    order = list(reversed(columns)) if last else list(columns)
    g = first_match_left(ids.select("id"), raw, "id", "place").select("id", F.coalesce(*order).alias("own"))
    if registry is None:
        return g.select("id", F.col("own").alias("death"))
    r = registry.groupBy("id").agg(F.max("DIED").alias("listed"))
    return g.join(r, "id", "left").select("id", F.coalesce("listed", "own").alias("death"))


def latest_date(raw: DataFrame, column: str) -> DataFrame:
    return raw.groupBy("id").agg(F.max(column).alias(column))


def static_table(ids: DataFrame, *parts: DataFrame) -> DataFrame:
    """One wide row for each id: all parts joined by id."""
    out = ids.select("id")
    for p in parts:
        out = out.join(p, "id", "left")
    return out


#: Laboratory pairs of day 1 in the first cohort's tables, by name: (table, column stem).
LABS = {
    "hematocrit": "HEMATOCRIT", "hemoglobin": "HEMOGLOBIN", "sodium": "SODIUM", "potassium": "POTASSIUM", "wbc": "WBC", "bicarbonate": "CO2", "ph": "PH", "po2": "PO2", "pco2": "PCO2",
}


def labs(ids: DataFrame, males: DataFrame, first: DataFrame, second: DataFrame, gases: DataFrame, max_day: int = 1, male_limit: float = 13.0) -> DataFrame:
    """Low and high of LABS, single values (bilirubin, platelets, albumin, lactate, urea up to max_day) and three grades of anemia on the day-1 lows. The cohorts differ in the men's hemoglobin limit of the first (13 or 18)."""
    f = first_match_left(ids.select("id").join(males, "id", "left"), first, "id", "place").drop("place")
    f = first_match_left(f, second, "id", "place").drop("place")
    f = first_match_left(f, gases, "id", "place")
    pairs = [low_high(n, F.col(f"{s}_D1_LOW_VALUE"), F.col(f"{s}_D1_HIGH_VALUE")) for n, s in LABS.items()]
    urea = [F.col(f"BUN_D{j}_HIGH_VALUE") for j in range(max_day + 1) if f"BUN_D{j}_HIGH_VALUE" in f.columns]
    single = {"bilirubin": F.col("BILIRUBIN_D1_HIGH_VALUE"), "platelets": F.col("PLATELETS_D1_LOW_VALUE"), "albumin": F.col("ALBUMIN_VALUE"), "lactate": F.col("LACTATE_SYRINGE_ION_VALUE"), "bun": F.greatest(*urea, F.lit(None)) if urea else F.lit(None).cast("double")}
    hemoglobin, hematocrit = F.col("HEMOGLOBIN_D1_LOW_VALUE"), F.col("HEMATOCRIT_D1_LOW_VALUE")
    grades = {
        "anemia_a": (hematocrit < F.when(F.col("male") == 1, 39).otherwise(36)) | (hemoglobin < F.when(F.col("male") == 1, male_limit).otherwise(12.0)),
        "anemia_b": (hematocrit < 30) | (hemoglobin < 10),
        "anemia_c": (hematocrit < 27) | (hemoglobin < 9),
    }
    return f.select("id", *pairs, *(c.alias(n) for n, c in single.items()), *(F.coalesce(c, F.lit(False)).cast("int").alias(n) for n, c in grades.items()))
