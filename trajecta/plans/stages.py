"""From measurements to severity stages: pair mean, grid, days, stages. One job of windows over a key; one join by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajecta.operators.series import day_number, forward_mean, staged, to_grid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as measurements of users: (id, ts, value, tie, mask), errors masked."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "ts", "value", F.col("event_id").alias("tie"), (F.col("event_type") == "error").cast("int").alias("mask"))


def baselines(series: DataFrame) -> DataFrame:
    """(id, base, admit): the first value, and an admission a day after it."""
    return series.groupBy("id").agg(F.min_by("value", F.struct("ts", "tie")).alias("base"), (F.min("ts") + F.expr("interval 1 day")).alias("admit"))


def stages_of(series: DataFrame, hours: int = 6) -> DataFrame:
    """(id, bin, value, is_real, on_mask, base, day, stage) of series of (id, ts, value, tie, mask)."""
    grid = to_grid(forward_mean(series, mask="mask", tie="tie"), mask="mask", hours=hours)
    grid = grid.join(baselines(series), "id")
    admit_bin = F.floor(F.timestamp_diff("MICROSECOND", "anchor", F.col("admit")) / F.lit(hours * 3_600_000_000)).cast("int")
    day = day_number(F.col("bin"), admit_bin, F.hour("admit"), F.col("anchor") < F.col("admit"), hours)
    grid = staged(grid.withColumn("day", day), hours=hours)
    return grid.select("id", "bin", "value", "is_real", "on_mask", "base", "day", "stage")


def peak_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest stage of each user and the bins spent at each."""
    stages = stages_of(measurements(spark, sf_dir))
    at = [F.sum(F.when(F.col("stage") == k, 1).otherwise(0)).alias(f"bins_{k}") for k in range(5)]
    return stages.groupBy("id").agg(F.max("stage").alias("peak"), F.count("*").alias("bins"), *at)
