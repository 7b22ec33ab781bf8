"""Exact quantiles and ranks of columns and groups, without a task that holds all values of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajecta.sources.steps import Steps

#: Buckets of a range in a pass, rows of a range that are sorted as they are, and ranges that are broadcast to the rows at most.
BUCKETS, FEW, SENT = 65_536, 65_536, 200_000


def _plain(name: str) -> Column:
    return F.col(f"`{name}`")


def group_key(by: Sequence[str]) -> Column:
    """A text that tells groups apart; null is a value like others."""
    return F.to_json(F.struct(*(_plain(c).alias(f"k{i}") for i, c in enumerate(by)))) if by else F.lit("{}")


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float], by: Sequence[str] = (), steps: Steps | None = None) -> DataFrame:
    """(by, column, n, q): for each group and column the number of values and the array of their exact quantiles, between values in proportion.

    All columns and groups go through the passes together. A pass counts the rows of each range that a wanted rank lies in by BUCKETS parts
    of it and narrows the range to the least and largest value of the part that has the rank; ranges of FEW rows are sorted.
    So what is shuffled are counts, and the number of passes follows from how unevenly the values lie, not from the rows.

    Null groups are groups. Null, NaN and infinite values are left out; a group without values has n = 0 and null. A table without rows
    has no group, or where nothing is grouped by, n = 0.
    """
    steps = steps or Steps(df.sparkSession, "quantiles")
    names = [f"v{i}" for i in range(len(columns))]
    number = [_plain(c).cast("double") for c in columns]
    finite = [F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x).alias(n) for x, n in zip(number, names)]
    wide = steps.table(df.select(group_key(by).alias("g"), *(_plain(c).alias(f"k{i}") for i, c in enumerate(by)), *finite))
    first = [F.first(f"k{i}").alias(f"k{i}") for i in range(len(by))]
    each = F.array(*(F.struct(F.lit(i).alias("c"), F.count(n).alias("n"), F.min(n).alias("lo"), F.max(n).alias("hi")) for i, n in enumerate(names)))
    grouped = wide.groupBy("g").agg(*first, each.alias("e")) if by else wide.agg(F.lit("{}").alias("g"), each.alias("e"))
    groups = steps.table(grouped.withColumn("e", F.explode("e")).select("*", "e.*").drop("e"))

    wanted = []
    for i, p in enumerate(shares):
        at = F.lit(float(p)) * (F.col("n") - 1)
        wanted += [F.struct(F.lit(i).alias("i"), F.lit(s).alias("s"), f(at).cast("long").alias("r")) for s, f in enumerate((F.floor, F.ceil))]
    wanted = F.explode(F.array(*wanted))
    targets = groups.where("n > 0").withColumn("w", wanted).select("g", "c", "w.*", "lo", "hi", F.lit(0).cast("long").alias("skip"), F.col("n").alias("here"))
    tall = wide.select("g", F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(n).alias("v")) for i, n in enumerate(names)))).alias("e")).select("g", "e.c", "e.v").where("v is not null")

    def within(ranges: DataFrame, n: int) -> DataFrame:
        return tall.join(F.broadcast(ranges) if n <= SENT else ranges, ["g", "c"]).where("v >= lo and v <= hi")

    while True:
        targets = steps.table(targets)
        wide_ranges = targets.where(f"lo < hi and here > {FEW}").select("g", "c", "lo", "hi").distinct()
        n_wide = wide_ranges.count()
        if not n_wide:
            break
        part = F.expr(f"cast(least({BUCKETS - 1}, floor((v * 0.5D - lo * 0.5D) / (hi * 0.5D - lo * 0.5D) * {BUCKETS})) as int)")
        parts = within(wide_ranges, n_wide).groupBy("g", "c", "lo", "hi", part.alias("part")).agg(F.count("*").alias("m"), F.min("v").alias("a"), F.max("v").alias("b"))
        before = F.coalesce(F.sum("m").over(W.partitionBy("g", "c", "lo", "hi").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # BUCKETS rows at most
        parts = parts.withColumn("before", before)
        narrowed = targets.join(parts, ["g", "c", "lo", "hi"]).where("r >= skip + before and r < skip + before + m")
        rest = targets.where(f"not (lo < hi and here > {FEW})")
        targets = narrowed.select("g", "c", "i", "s", "r", F.col("a").alias("lo"), F.col("b").alias("hi"), (F.col("skip") + F.col("before")).alias("skip"), F.col("m").alias("here")).unionByName(rest)

    few = targets.where("lo < hi").select("g", "c", "lo", "hi").distinct()
    listed = within(few, few.count()).groupBy("g", "c", "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("l"))  # FEW values at most
    found = targets.join(listed, ["g", "c", "lo", "hi"], "left").select("g", "c", "i", "s", F.coalesce(F.get("l", (F.col("r") - F.col("skip")).cast("int")), F.col("lo")).alias("v"))
    low, high = (F.map_from_entries(F.collect_list(F.when(F.col("s") == s, F.struct("i", "v")))).alias(n) for s, n in ((0, "low"), (1, "high")))
    met = groups.join(found.groupBy("g", "c").agg(low, high), ["g", "c"], "left")
    q = []
    for i, p in enumerate(shares):
        at = F.lit(float(p)) * (F.col("n") - 1)
        a, b = (F.try_element_at(side, F.lit(i)) for side in ("low", "high"))
        q.append(a + (b - a) * (at - F.floor(at)))
    named = F.array(*(F.lit(c) for c in columns))
    return met.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(by)), F.get(named, F.col("c")).alias("column"), "n", F.when(F.col("n") > 0, F.array(*q)).alias("q"))


def ranks(df: DataFrame, value: str, by: Sequence[str] = (), steps: Steps | None = None) -> DataFrame:
    """(by, value, n, before): the distinct values of each group, how many rows have each, and how many rows of the group have a smaller one.

    Values are counted, dealt to ranges of (group, value) and summed range by range; of the ranges before only their sums are known. Null and NaN are left out.
    """
    steps = steps or Steps(df.sparkSession, "ranks")
    x = _plain(value).cast("double")
    keys = [f"k{i}" for i in range(len(by))]
    counted = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(group_key(by).alias("g"), *(_plain(c).alias(k) for c, k in zip(by, keys)), x.alias("value")).agg(F.count("*").alias("n"))
    dealt = steps.table(counted.repartitionByRange("g", "value").withColumn("part", F.spark_partition_id()))
    sums = dealt.groupBy("g", "part").agg(F.sum("n").alias("m"))
    before = sums.select("g", "part", F.coalesce(F.sum("m").over(W.partitionBy("g").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("b"))  # one row a range
    own = F.coalesce(F.sum("n").over(W.partitionBy("g", "part").orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.withColumn("own", own).join(before, ["g", "part"])
    return placed.select(*(F.col(k).alias(c) for c, k in zip(by, keys)), "value", "n", (F.col("own") + F.col("b")).alias("before"))
