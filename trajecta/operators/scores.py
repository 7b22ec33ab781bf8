"""Composite severity scores from one wide row a patient. Every part is a first-match list of thresholds; null comparisons don't match.

Temperatures in °C and FiO2 as a fraction (convert first). Missing inputs give 0 points.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.operators.cleaning import imputed_by


def points(*cases: tuple[int, Column]) -> Column:
    """Points of the first case that holds, else 0."""
    out = F.lit(0)
    for n, condition in reversed(cases):
        out = F.when(condition, n).otherwise(out)
    return out


def _under(c: Column, *limits: tuple[int, float]) -> Column:
    return points(*((n, c < x) for n, x in limits))


def _over(c: Column, *limits: tuple[int, float]) -> Column:
    return points(*((n, c > x) for n, x in limits))


def first_day_creatinine(grid: DataFrame, key: str = "id", day: str = "day", value: str = "value") -> DataFrame:
    """(key, creatinine): the largest value of day 0, or of day 1 where there is no day 0."""
    by = grid.groupBy(key).agg(F.max(F.when(F.col(day) == 0, F.col(value))).alias("d0"), F.max(F.when(F.col(day) == 1, F.col(value))).alias("d1"))
    return by.select(key, F.coalesce("d0", "d1").alias("creatinine"))


SOFA_PARTS = ("respiration", "coma", "circulation", "liver", "coagulation", "kidney")


def sofa(patients: DataFrame, key: str = "id") -> DataFrame:
    """(key, six parts 0-4, sofa). patients: po2, fio2, ventilated (0/1), gcs, map, dopamine, epinephrine (0/1), bilirubin, platelets, creatinine.

    Missing po2, fio2 and gcs take the median of patients with the same ventilation.
    """
    p = imputed_by(patients, "ventilated", ["po2", "fio2", "gcs"])
    ratio = F.try_divide(F.col("po2"), F.nullif(F.col("fio2"), F.lit(0)))
    vent = F.col("ventilated") == 1
    parts = [
        points((4, vent & (ratio < 100)), (3, vent & (ratio < 200)), (2, ~F.coalesce(vent, F.lit(False)) & (ratio < 300)), (1, ~F.coalesce(vent, F.lit(False)) & (ratio < 400))),
        _under(F.col("gcs"), (4, 6), (3, 10), (2, 13), (1, 15)),
        points((3, F.col("epinephrine") == 1), (2, F.col("dopamine") == 1), (1, F.col("map") < 70)),
        _over(F.col("bilirubin"), (4, 12.0), (3, 6.0), (2, 2.0), (1, 1.2)),
        _under(F.col("platelets"), (4, 20), (3, 50), (2, 100), (1, 150)),
        _over(F.col("creatinine"), (4, 5.0), (3, 3.5), (2, 2.0), (1, 1.2)),
    ]
    out = p.select(key, *(c.alias(n) for n, c in zip(SOFA_PARTS, parts)))
    return out.withColumn("sofa", sum((F.col(n) for n in SOFA_PARTS), F.lit(0)))


APACHE_PARTS = ("temperature", "pressure", "heart", "respiration", "oxygen", "acidity", "sodium", "potassium", "kidney", "hematocrit", "leukocytes", "coma", "age_points")


def apache(patients: DataFrame, key: str = "id", potassium_quirk: bool = False) -> DataFrame:
    """(key, thirteen parts, apache). patients: {temp, map, hr, rr, ph, na, k, hct, wbc}_{low,high}, fio2, po2, pco2, creatinine, gcs, age.

    potassium_quirk: the last potassium rule looks at sodium, as one of the two cohorts' source scripts did.
    """
    lo = lambda n: F.col(f"{n}_low")
    hi = lambda n: F.col(f"{n}_high")
    gradient = F.col("fio2") * 713 - F.col("pco2") / 0.8 - F.col("po2")
    rich = F.coalesce(F.col("fio2") >= 0.5, F.lit(False))
    pressure = lambda n: points((4, (lo(n) < 49) | (hi(n) > 160)), (3, hi(n) > 130), (2, (lo(n) < 70) | (hi(n) > 110)))
    last_k = hi("na") if potassium_quirk else hi("k")
    parts = [
        points((4, (lo("temp") < 30) | (hi("temp") > 40)), (3, (lo("temp") < 32) | (hi("temp") > 39)), (2, lo("temp") < 34), (1, (lo("temp") < 36) | (hi("temp") > 38.5))),
        pressure("map"),
        pressure("hr"),
        points((4, (lo("rr") <= 5) | (hi("rr") >= 50)), (3, hi("rr") >= 35), (2, lo("rr") <= 10), (1, (lo("rr") < 12) | (hi("rr") >= 25))),
        points((4, rich & (gradient >= 500)), (3, rich & (gradient > 350)), (2, rich & (gradient > 200)), (4, ~rich & (F.col("po2") < 55)), (3, ~rich & (F.col("po2") < 60)), (1, ~rich & (F.col("po2") < 70))),
        points((4, (lo("ph") <= 7.15) | (hi("ph") >= 7.7)), (3, (lo("ph") < 7.25) | (hi("ph") >= 7.6)), (2, lo("ph") < 7.33), (1, hi("ph") >= 7.5)),
        points((4, (lo("na") <= 110) | (hi("na") >= 180)), (3, (lo("na") < 120) | (hi("na") >= 160)), (2, (lo("na") < 130) | (hi("na") >= 155)), (1, hi("na") >= 150)),
        points((4, (lo("k") < 2.5) | (hi("k") >= 7)), (3, hi("k") >= 6), (2, lo("k") < 3), (1, (lo("k") < 3.5) | (last_k >= 5.5))),
        points((4, F.col("creatinine") >= 3.5), (3, F.col("creatinine") >= 2), (2, (F.col("creatinine") >= 1.5) | (F.col("creatinine") < 0.6))),
        points((4, (lo("hct") < 20) | (hi("hct") >= 60)), (2, (lo("hct") < 30) | (hi("hct") >= 50)), (1, hi("hct") >= 46)),
        points((4, (lo("wbc") < 1) | (hi("wbc") >= 40)), (2, (lo("wbc") < 3) | (hi("wbc") >= 20)), (1, hi("wbc") >= 15)),
        F.coalesce((15 - F.col("gcs")).cast("int"), F.lit(0)),
        points((6, F.col("age") >= 75), (5, F.col("age") >= 65), (3, F.col("age") >= 55), (2, F.col("age") >= 45)),
    ]
    out = patients.select(key, *(c.alias(n) for n, c in zip(APACHE_PARTS, parts)))
    return out.withColumn("apache", sum((F.col(n) for n in APACHE_PARTS), F.lit(0)))


def charlson(components: Column) -> Column:
    """The index, null if not above 0."""
    return F.when(components > 0, components)


def weighted_flags(flags: Sequence[Column], weights: Sequence[float]) -> Column:
    """Sum of the weights of the set flags; null if any flag is missing."""
    return sum((f * F.lit(float(w)) for f, w in zip(flags, weights)), F.lit(0.0))


def anemia(hemoglobin_low: Column, male: Column, male_limit: float = 13.0, female_limit: float = 12.0) -> Column:
    return (hemoglobin_low < F.when(male == 1, male_limit).otherwise(female_limit)).cast("int")
