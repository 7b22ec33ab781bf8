"""Measurement series in long form: pair means, a fixed grid, severity stages, episodes. Time order is (ts, tie)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajecta.functions.times import floor_to_bin


def forward_mean(df: DataFrame, key: str = "id", ts: str = "ts", value: str = "value", mask: str | None = None, tie: str | None = None, window: int = 2, max_hours: int = 24) -> DataFrame:
    """Each point averaged with those of the next window - 1 that are at most max_hours later.

    The time moves by the mean offset, the mask is the largest; a series of at most `window` points stays as it is.
    """
    order = W.partitionBy(key).orderBy(ts, *([tie] if tie else []))
    n = F.count("*").over(W.partitionBy(key))
    df = df.withColumn("__n", n)
    for k in range(1, window):
        df = df.withColumn(f"__t{k}", F.lead(ts, k).over(order)).withColumn(f"__v{k}", F.lead(value, k).over(order))
        df = df.withColumn(f"__o{k}", F.timestamp_diff("MICROSECOND", F.col(ts), F.col(f"__t{k}")))
        if mask:
            df = df.withColumn(f"__m{k}", F.lead(mask, k).over(order))
    near = [F.when(F.col(f"__o{k}") <= max_hours * 3_600_000_000, 1).otherwise(0) for k in range(1, window)]
    df = df.withColumn("__ct", reduce(lambda a, b: a + b, near))
    use = [F.col("__ct") >= k for k in range(1, window)]
    total = reduce(lambda a, b: a + b, [F.when(u, F.col(f"__v{k}")).otherwise(0.0) for k, u in enumerate(use, 1)], F.col(value).cast("double"))
    offset = reduce(lambda a, b: a + b, [F.when(c == 1, F.col(f"__o{k}")).otherwise(0) for k, c in enumerate(near, 1)])
    count = F.col("__ct") + 1
    keep = F.col("__n") <= window
    moved = F.col(ts) + F.make_dt_interval(secs=(F.floor(offset / count) / F.lit(1e6)).cast("decimal(18,6)"))
    out = {value: F.when(keep, F.col(value)).otherwise(total / count), ts: F.when(keep, F.col(ts)).otherwise(moved)}
    if mask:
        out[mask] = F.when(keep, F.col(mask)).otherwise(reduce(F.greatest, [F.when(u, F.col(f"__m{k}")) for k, u in enumerate(use, 1)], F.col(mask)))
    return df.withColumns(out).drop(*(c for c in df.columns if c.startswith("__")))


def to_grid(df: DataFrame, key: str = "id", ts: str = "ts", value: str = "value", mask: str | None = None, hours: int = 6) -> DataFrame:
    """(key, bin, anchor, value, is_real, on_mask): a dense grid of `hours`-hour bins from the bin of the first point.

    A bin has its largest value; empty bins lie on the line between their neighbours; a series within one bin has its
    mean. on_mask: a masked point in this bin or in the two days before. Gaps are filled by exploding each filled bin up to the next, so
    nothing is joined.
    """
    per_day = 24 // hours
    by_key = W.partitionBy(key)
    df = df.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).withColumn("anchor", floor_to_bin(F.min(ts).over(by_key), hours))
    df = df.withColumn("bin", F.floor(F.timestamp_diff("MICROSECOND", "anchor", F.col(ts)) / F.lit(hours * 3_600_000_000)).cast("int"))
    on = F.max(F.col(mask).cast("int")) if mask else F.lit(0)
    bins = df.groupBy(key, "anchor", "bin").agg(F.max(value).cast("double").alias("top"), F.avg(value).alias("mean"), on.alias("on"))
    order = by_key.orderBy("bin")
    bins = bins.withColumns({"next": F.lead("bin").over(order), "next_top": F.lead("top").over(order), "n_bins": F.count("*").over(by_key)})
    bins = bins.withColumn("at", F.explode(F.sequence("bin", F.coalesce(F.col("next") - 1, F.col("bin")))))
    line = F.col("top") + (F.col("next_top") - F.col("top")) * (F.col("at") - F.col("bin")) / (F.col("next") - F.col("bin"))
    grid = bins.select(
        key, F.col("at").alias("bin"), "anchor",
        F.when(F.col("n_bins") == 1, F.col("mean")).when(F.col("at") == F.col("bin"), F.col("top")).otherwise(line).alias("value"),
        (F.col("at") == F.col("bin")).alias("is_real"), F.when(F.col("at") == F.col("bin"), F.col("on")).otherwise(0).alias("__on"),
    )
    tail = by_key.orderBy("bin").rowsBetween(-(2 * per_day - 1), 0)
    return grid.withColumn("on_mask", F.max("__on").over(tail) > 0).drop("__on")


def day_number(bin_: Column, admit_bin: Column, admit_hour: Column, before: Column, hours: int = 6) -> Column:
    """Day of stay of a grid bin: 1 from the end of the admission day on, 0 before it, -1, -2, ... before the admission's bin.

    before: whether the grid begins before the admission. The first bin stays 0 if a block of days would begin with it.
    """
    per_day = 24 // hours
    start = admit_bin + F.floor(admit_hour / hours).cast("int")
    back = -(F.floor((admit_bin - 1 - bin_) / per_day).cast("int") + 1)
    alone = (bin_ == 0) & (F.pmod(admit_bin - 1, F.lit(per_day)) == 0)
    return F.when(bin_ >= start, F.floor((bin_ - start) / per_day).cast("int") + 1).when(before & (bin_ < admit_bin) & ~alone, back).otherwise(0)


def staged(grid: DataFrame, key: str = "id", value: str = "value", base: str = "base", day: str = "day", hours: int = 6) -> DataFrame:
    """Adds stage: 4 on the mask; 0 to 3 by multiples of the base; 1 also for a rise of 0.3 within two days, from the ninth bin on.

    The rise is over the least real value of earlier bins whose day is at least this day less 2; a day has at most 24 / hours
    bins, so a bounded row window holds all of them.
    """
    per_day = 24 // hours
    behind = W.partitionBy(key).orderBy("bin").rowsBetween(-4 * per_day, -1)
    past = F.collect_list(F.when(F.col("is_real"), F.struct(F.col(day).alias("d"), F.col(value).alias("v")))).over(behind)
    grid = grid.withColumn("__past", past)
    least = F.array_min(F.transform(F.filter("__past", lambda p: p["d"] >= F.col(day) - 2), lambda p: p["v"]))
    v, b = F.col(value), F.col(base)
    rise = (F.col("bin") > 7) & (v >= least + 0.3)
    stage = F.when(F.col("on_mask"), 4).when(v <= 1.5 * b, F.when(rise, 1).otherwise(0)).when(v < 2 * b, 1).when(v < 3 * b, 2).when(v.isNotNull() & b.isNotNull(), 3)
    return grid.withColumn("stage", stage).drop("__past")


def episodes(stages: DataFrame, key: str = "id", stage: str = "stage", gap_hours: int = 48, hours: int = 6) -> DataFrame:
    """(key, n_episodes): runs of stages above 0; two are apart if their bins differ by gap_hours / hours or more."""
    order = W.partitionBy(key).orderBy("bin")
    bad = stages.where(F.col(stage) > 0).withColumn("__gap", F.col("bin") - F.lag("bin").over(order))
    found = bad.groupBy(key).agg((F.sum(F.when(F.col("__gap") >= gap_hours / hours, 1).otherwise(0)) + 1).alias("n"))
    return stages.select(key).distinct().join(found, key, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n_episodes"))


def directions(stages: DataFrame, key: str = "id", stage: str = "stage") -> DataFrame:
    """(key, n_peaks, up_down, down_up): rises after a fall or the start, less one that is still going on at the end; and turns."""
    return moves(stages, key, stage).groupBy(key).agg(*turns())


def moves(stages: DataFrame, key: str = "id", stage: str = "stage") -> DataFrame:
    """Adds __s, 1 for a rise and -1 for a fall (else null), and __p, the last such before."""
    order = W.partitionBy(key).orderBy("bin")
    f = stages.withColumn("__s", F.signum(F.col(stage) - F.lag(stage).over(order)).cast("int"))
    f = f.withColumn("__s", F.when(F.col("__s") != 0, F.col("__s")))
    return f.withColumn("__p", F.last("__s", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))


def turns(names: tuple[str, str, str] = ("n_peaks", "up_down", "down_up")) -> list[Column]:
    """Aggregates of `moves`: peaks, turns from up to down, turns from down to up."""
    s, p = F.col("__s"), F.col("__p")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    last = F.max_by("__s", F.when(s.isNotNull(), F.col("bin")))
    found = one((s == 1) & (F.coalesce(p, F.lit(0)) < 1)) - F.when(last == 1, 1).otherwise(0), one((s == -1) & (p == 1)), one((s == 1) & (p == -1))
    return [c.alias(n) for c, n in zip(found, names)]


def relative_change(df: DataFrame, value: str = "value", base: str = "base") -> DataFrame:
    """Adds value / base, over a base of zero an infinity or NaN as of doubles, and value - base."""
    v, b = F.col(value).cast("double"), F.col(base).cast("double")
    return df.withColumns({"relative": F.when(b == 0, v * F.pow(b, F.lit(-1.0))).otherwise(F.try_divide(v, b)), "change": F.col(value) - F.col(base)})


def masked(df: DataFrame, mask: str, chosen: int | list[int] = 1) -> DataFrame:
    """Rows whose mask is one of the chosen values."""
    return df.where(F.col(mask).isin(chosen if isinstance(chosen, list) else [chosen]))


def location(at: Column, icu: tuple[Column, Column], hospital: tuple[Column, Column]) -> Column:
    """2 in intensive care, 1 elsewhere in hospital, 0 outside."""
    return F.when(at.between(*icu), 2).when(at.between(*hospital), 1).otherwise(0)


def extremes(df: DataFrame, starts: DataFrame, key: str = "id", ts: str = "ts", value: str = "value", start: str = "start", max_days: int = 3) -> DataFrame:
    """(key, first, last, most, least) of the values from start to max_days later, ends included; nulls where there are none."""
    inside = df.join(starts.select(key, start), key).where((F.col(ts) >= F.col(start)) & (F.col(ts) <= F.col(start) + F.make_dt_interval(days=F.lit(max_days))))
    g = inside.groupBy(key).agg(F.min_by(value, ts).alias("first"), F.max_by(value, ts).alias("last"), F.max(value).alias("most"), F.min(value).alias("least"))
    return starts.select(key).distinct().join(g, key, "left")
