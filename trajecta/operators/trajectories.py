"""Features of stage trajectories (key, bin, day, stage)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajecta.operators.evaluation import t_half_width_at
from trajecta.operators.series import moves, turns


def described(stages: DataFrame, key: str = "id", hours: int = 6, day_limit: int | None = None) -> DataFrame:
    """The 17 descriptive features of each trajectory, up to day_limit if given, in one pass: all windows are of one order, all sums of one key."""
    if day_limit is not None:
        stages = stages.where(F.col("day") <= day_limit)
    before = W.partitionBy(key).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bad = F.when(F.col("stage") > 0, F.col("bin"))
    stages = moves(stages, key).withColumn("__gap", bad - F.last(bad, ignorenulls=True).over(before))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    total = lambda c: F.sum(F.when(c, 1).otherwise(0))
    k, d = F.col("stage"), F.col("__s")
    long_at = [flag(total(k == s) >= 24 / hours).alias(f"stage{s}_day") for s in (1, 2, 3, 4)]
    return stages.groupBy(key).agg(
        F.max("stage").cast("long").alias("peak"), F.min_by("stage", "bin").cast("long").alias("first"), F.max_by("stage", "bin").cast("long").alias("last"), F.min("stage").cast("long").alias("least"),
        F.coalesce(F.max(F.when(F.col("day") <= 3, k)), F.lit(0)).cast("long").alias("peak_to_day3"), F.coalesce(F.max(F.when(F.col("day") > 3, k)), F.lit(0)).cast("long").alias("peak_after_day3"),
        *long_at, flag(F.max("stage") == F.min("stage")).alias("flat"), flag((total(d > 0) > 0) & (total(d < 0) == 0)).alias("only_up"), flag((total(d < 0) > 0) & (total(d > 0) == 0)).alias("only_down"),
        F.when(F.max("stage") > 0, total(F.col("__gap") >= 24 / hours) + 1).otherwise(0).cast("long").alias("n_episodes"), *turns(("n_peaks", "turns_down", "turns_up")),
    )


def transitions(stages: DataFrame, key: str = "id") -> DataFrame:
    """(key, previous, current, n) of each pair of consecutive stages."""
    before = stages.withColumn("previous", F.lag("stage").over(W.partitionBy(key).orderBy("bin"))).where("previous is not null")
    return before.groupBy(key, "previous", F.col("stage").alias("current")).agg(F.count("*").alias("n"))


def transition_weights(counts: DataFrame) -> DataFrame:
    """(step, weight): log10 of all steps between neighbour stages over those between step and step + 1, the least as 1."""
    steps = counts.where(F.abs(F.col("previous") - F.col("current")) == 1).groupBy(F.least("previous", "current").alias("step")).agg(F.sum("n").alias("n"))
    every = W.partitionBy()
    raw = steps.withColumn("w", F.log10(F.sum("n").over(every) / F.col("n")))  # at most four rows
    return raw.select("step", (F.col("w") / F.min("w").over(every)).alias("weight"))


def templates(stages: DataFrame, key: str = "id", points: int = 3, gap: int = 0, stride: int = 1) -> DataFrame:
    """(key, template, n): how often each sequence of `points` stages, gap bins between them, occurs at every stride-th start. Windows that fit count."""
    order = W.partitionBy(key).orderBy("bin")
    f = stages.withColumn("__i", F.row_number().over(order) - 1)
    for j in range(1, points):
        f = f.withColumn(f"__k{j}", F.lead("stage", j * (gap + 1)).over(order))
    f = f.where(F.col(f"__k{points - 1}").isNotNull() & (F.col("__i") % stride == 0))
    return f.groupBy(key, F.concat_ws("-", "stage", *(f"__k{j}" for j in range(1, points))).alias("template")).agg(F.count("*").alias("n"))


def slopes(stages: DataFrame, key: str = "id", gap: int = 0, stride: int = 1, ratios: bool = False) -> DataFrame:
    """(key, slope, n): counts of stage differences over gap + 1 bins, or their shares."""
    order = W.partitionBy(key).orderBy("bin")
    f = stages.withColumn("__i", F.row_number().over(order) - 1).withColumn("slope", F.lead("stage", gap + 1).over(order) - F.col("stage"))
    f = f.where(F.col("slope").isNotNull() & (F.col("__i") % stride == 0)).groupBy(key, "slope").agg(F.count("*").alias("n"))
    return f.withColumn("n", F.col("n") / F.sum("n").over(W.partitionBy(key))) if ratios else f


def pivoted(counts: DataFrame, key: str, name: str, values: list, prefix: str) -> DataFrame:
    """One column for each value, 0 where a key lacks it."""
    wide = counts.groupBy(key).pivot(name, values).agg(F.sum("n")).fillna(0)
    return wide.select(key, *(F.col(f"`{v}`").alias(f"{prefix}{v}") for v in values))


def position_statistics(series: DataFrame, values: str, *by: str, confidence: float = 0.95) -> DataFrame:
    """(by, place, n, mean, sd, half): of the values at each place (from 0) of ragged arrays the mean, the population deviation and half the width of the mean's t interval.

    Arrays are laid out by place and summed by (by, place); a null value doesn't count, and one value has no width.
    """
    tall = series.select(*by, F.posexplode(values).alias("place", "v")).where("v is not null")
    g = tall.groupBy(*by, "place").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), (F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("sem"))
    half = t_half_width_at(F.coalesce("sem", F.lit(float("nan"))), (F.col("n") - 1).cast("double"), F.lit(confidence))
    return g.withColumn("half", F.nanvl(half, F.lit(None).cast("double"))).select(*by, "place", "n", "mean", "sd", "half")


def position_means(series: DataFrame, values: str, by: str, most: int | None = None) -> DataFrame:
    """(by, values): arrays of the means by place, at most `most` long, as seeds of barycenters."""
    means = position_statistics(series, values, by)
    if most is not None:
        means = means.where(F.col("place") < most)
    return means.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "mean"))), lambda x: x["mean"]).alias(values))
