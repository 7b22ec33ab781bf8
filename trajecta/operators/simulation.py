"""Labelled stage sequences made from shapes, by seed: a start, a rise to peaks, a fall to a stop, with stretched segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def simulated(spark: SparkSession, n: int, days: int = 14, per_day: int = 4, seed: int = 1, parts: int = 8) -> DataFrame:
    """(id, label, values): n sequences of each shape (start, peaks, peak, stop), each label its own random stretches."""
    shapes = [(s, p, k, e) for s in range(3) for p in (1, 2) for k in (2, 3, 4) for e in range(3) if k > max(s, e)]
    length = days * per_day
    kinds = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(p).alias("p"), F.lit(k).alias("k"), F.lit(e).alias("e")) for s, p, k, e in shapes))
    ids = spark.range(0, n * len(shapes), 1, parts).withColumn("shape", F.get(kinds, F.pmod("id", F.lit(len(shapes))).cast("int")))
    u = [F.rand(seed + i) for i in range(3)]
    ids = ids.withColumns({f"u{i}": x for i, x in enumerate(u)})
    label = F.concat_ws("-", "shape.s", "shape.p", "shape.k", "shape.e")
    long_start, long_stop = F.floor(F.col("u0") * length / 3).cast("int"), F.floor(F.col("u1") * length / 3).cast("int")
    middle = length - long_start - long_stop

    def value(i):
        x = (i - long_start) / F.greatest(middle, F.lit(1)).cast("double") * F.col("shape.p")
        tooth = 1 - F.abs(2 * (x - F.floor(x)) - 1)
        base = F.when(x < 0.5, F.col("shape.s")).when(x > F.col("shape.p") - 0.5, F.col("shape.e")).otherwise(F.lit(1))
        inside = F.round(base + (F.col("shape.k") - base) * tooth)
        return F.when(i < long_start, F.col("shape.s")).when(i >= length - long_stop, F.col("shape.e")).otherwise(inside).cast("double")

    return ids.select("id", label.alias("label"), F.transform(F.sequence(F.lit(0), F.lit(length - 1)), value).alias("values"))


def subsets(sequences: DataFrame, chosen: list[str], n: int, seed: int = 1) -> DataFrame:
    """n sequences of each chosen label, in the order of a hash with the seed."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("label").orderBy(F.xxhash64("id", F.lit(seed))))
    return sequences.where(F.col("label").isin(chosen)).withColumn("__r", rank).where(F.col("__r") <= n).drop("__r")
