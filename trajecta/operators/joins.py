"""Joins on a patient or entity key with an order, an interval or a nearest time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.operators.blocks import ROWS, TASKS, blocks_of


def first_rows(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of each key. Null keys are one key."""
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__rn = 1").drop("__rn")


def first_match_left(left: DataFrame, right: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """Every left row with the first right row of its key, if any."""
    return left.join(first_rows(right, key, *order), key, "left")


def fold_all(left: DataFrame, right: DataFrame, key: str, *folds: Column) -> DataFrame:
    """Every left row with aggregates over all right rows of its key; the right side is summed before the join."""
    return left.join(right.groupBy(key).agg(*folds), key, "left")


def within(df: DataFrame, windows: DataFrame, key: str, at: str, start: str, stop: str, before_days: int = 0) -> DataFrame:
    """Rows whose time lies in a window of their key, ends included, the window begun `before_days` days earlier."""
    return df.join(windows, key).where((F.col(at) >= F.col(start) - F.make_dt_interval(days=F.lit(before_days))) & (F.col(at) <= F.col(stop)))


def _slot(df: DataFrame, at: str) -> Column:
    """The 4096 seconds that a time lies in: of a timestamp's instant, or of the wall clock where there is no zone."""
    kind = df.schema[at].dataType
    if isinstance(kind, T.TimestampNTZType):
        seconds = F.unix_date(F.to_date(at)).cast("long") * 86400 + F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at)
    elif isinstance(kind, T.DateType):
        seconds = F.unix_date(at).cast("long") * 86400
    else:
        seconds = F.unix_seconds(F.col(at).cast("timestamp"))
    return F.shiftright(seconds, 12)


def _levelled(spans: DataFrame, start: str, stop: str, mark: str) -> DataFrame:
    """Spans with their first and last slot and the level, the least of which two nodes of 2^level slots hold the span (columns __s, __e, __l and the mark)."""
    slots = spans.withColumns({f"__s{mark}": _slot(spans, start), f"__e{mark}": _slot(spans, stop)})
    return slots.withColumn(f"__l{mark}", F.ceil(F.log2(F.greatest(F.expr(f"__e{mark} - __s{mark}"), F.lit(1)))).cast("int"))


def _levels(spans: DataFrame, key: str, mark: str) -> DataFrame:
    """(key, __levels): those that the key's spans have."""
    return spans.groupBy(key).agg(F.collect_set(f"__l{mark}").alias("__levels"))


def stab(df: DataFrame, spans: DataFrame, key: str, at: str, start: str, stop: str, tail_hours: int = 48, closed: bool = True) -> DataFrame:
    """Pairs of rows and spans of the same key with at in [start, stop + tail].

    Time is parted at levels, in nodes of 2^level slots. A span is dealt to the one or two nodes that it touches at the level of its
    length, and a row to its node at each level that its key's spans have; so the join is on (key, level, node), a span of
    a century is two rows like one of an hour, and a key with many rows and many spans is not compared all with all. Null ends mean the start.
    """
    ends = F.coalesce(F.col(stop), F.col(start)) + F.make_dt_interval(hours=F.lit(tail_hours))
    lasting = spans.where(F.col(start).isNotNull()).withColumn("__end", ends)
    lasting = _levelled(lasting.where(F.col("__end") >= F.col(start)), start, "__end", "")
    dealt = lasting.withColumn("__n", F.explode(F.expr("sequence(shiftright(__s, __l), shiftright(__e, __l))")))
    rows = df.withColumn("__at", _slot(df, at)).join(_levels(lasting, key, ""), key).withColumn("__l", F.explode("__levels")).withColumn("__n", F.expr("shiftright(__at, __l)"))
    found = rows.drop("__at", "__levels").join(dealt.drop("__s", "__e"), [key, "__l", "__n"])
    inside = (F.col(at) >= F.col(start)) & (F.col(at) <= F.col("__end")) if closed else (F.col(at) > F.col(start)) & (F.col(at) < F.col("__end"))
    return found.where(inside).drop("__l", "__n", "__end")


def overlap(left: DataFrame, right: DataFrame, key: str, a: tuple[str, str], b: tuple[str, str], out: tuple[str, str] = ("w_start", "w_stop")) -> DataFrame:
    """Pairs of the same key whose intervals overlap for more than an instant, with the common part.

    Intervals are dealt to nodes as the spans of `stab` are, at their own level and at the longer ones that the other side has in the key. A
    pair meets at the level of its longer interval, in the node where the later of them starts.
    """
    one, two = (_levelled(df.where(F.col(ends[0]) <= F.col(ends[1])), *ends, mark) for df, ends, mark in ((left, a, "a"), (right, b, "b")))

    def dealt(df: DataFrame, mark: str, others: DataFrame) -> DataFrame:
        levels = F.expr(f"array_union(filter(__levels, x -> x > __l{mark}), if(array_min(__levels) <= __l{mark}, array(__l{mark}), array()))")
        return df.join(others, key).withColumn("__l", F.explode(levels)).drop("__levels").withColumn("__n", F.explode(F.expr(f"sequence(shiftright(__s{mark}, __l), shiftright(__e{mark}, __l))")))

    met = dealt(one, "a", _levels(two, key, "b")).join(dealt(two, "b", _levels(one, key, "a")), [key, "__l", "__n"])
    both = met.where("__l = greatest(__la, __lb) and __n = shiftright(greatest(__sa, __sb), __l)").drop("__l", "__n", *(f"__{x}{mark}" for x in "sel" for mark in "ab"))
    both = both.withColumn(out[0], F.greatest(a[0], b[0])).withColumn(out[1], F.least(a[1], b[1]))
    return both.where(F.col(out[1]) > F.col(out[0]))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, seen: str, least_days: float = 0.0, most_days: float | None = None, tie: str | None = None) -> DataFrame:
    """Each left row with the latest right row at least `least_days` before it; no match if that one is `most_days` old or more.

    Of right rows at one time the largest `tie` counts. Both sides stand in one line by time, the left rows `least_days`
    early, and each left row takes the last right row before it, so the work of a key is one sort and no pairs are made.
    """
    rest = [c for c in right.columns if c != key]
    known = right.where(F.col(key).isNotNull() & F.col(seen).isNotNull())
    known = known.select(key, F.col(seen).alias("__t"), F.lit(0).alias("__side"), (F.col(tie) if tie else F.lit(0)).alias("__tie"), F.struct(*rest).alias("__seen"))
    asked = left.select(key, (F.col(at) - F.make_dt_interval(secs=F.lit(least_days * 86400.0))).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"))
    line = W.partitionBy(key).orderBy(F.col("__t").asc_nulls_first(), "__side", "__tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    met = known.unionByName(asked, allowMissingColumns=True).withColumn("__seen", F.last("__seen", True).over(line)).where("__side = 1")
    fits = F.col("__seen").isNotNull()
    if most_days is not None:
        fits &= F.timestamp_diff("MICROSECOND", F.col(f"__seen.{seen}"), F.col(f"__left.{at}")) / F.lit(86400e6) < most_days
    return met.select("__left.*", *(F.when(fits, F.col(f"__seen.{c}")).alias(c) for c in rest))


def nearest(left: DataFrame, right: DataFrame, key: str, at: Column, seen: str, k: int, *ties: str) -> DataFrame:
    """For each left row the k right rows of its key nearest to a time, of equally near ones the least `ties`, with apart_days and rank.

    The right rows of a key are numbered by time. A left row's place among them comes from one line of both sides, and it is joined with
    the k numbers before and the k after that place, so no other pair is made. Rows without a time match nothing.
    """
    known = right.where(F.col(seen).isNotNull())
    by = W.partitionBy(key)
    numbered = known.withColumn("__after", F.row_number().over(by.orderBy(F.col(seen).asc(), *(F.col(c).asc() for c in ties)))).withColumn("__before", F.row_number().over(by.orderBy(F.col(seen).asc(), *(F.col(c).desc() for c in ties))))
    names = left.columns
    line = known.select(key, F.col(seen).alias("__t"), F.lit(0).alias("__side")).unionByName(left.select(key, at.alias("__t"), F.lit(1).alias("__side"), F.struct(*names).alias("__left")), allowMissingColumns=True)
    upto = F.count_if(F.col("__side") == 0).over(by.orderBy("__t", "__side").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = line.withColumn("__c", upto.cast("int")).where("__side = 1 and __t is not null").select("__left.*", "__t", "__c")
    before = placed.withColumn("__before", F.explode(F.sequence(F.col("__c") - (k - 1), F.col("__c")))).join(numbered.drop("__after"), [key, "__before"]).drop("__before")
    after = placed.withColumn("__after", F.explode(F.sequence(F.col("__c") + 1, F.col("__c") + k))).join(numbered.drop("__before"), [key, "__after"]).drop("__after")
    both = before.unionByName(after).withColumn("apart_days", F.abs(F.timestamp_diff("MICROSECOND", F.col("__t"), F.col(seen)) / F.lit(86400e6))).drop("__t", "__c")
    return both.withColumn("rank", F.row_number().over(W.partitionBy(*names).orderBy("apart_days", *ties))).where(F.col("rank") <= k)


def all_pairs(df: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """Every pair key < key2 once, with the other columns twice (suffix 2), dealt by a grid of blocks of about `rows` rows, fewer if those hold arrays or text.

    A task holds the left and the right block of a cell of the upper triangle. A row is a left one in the cells from its own block on
    and a right one in those up to it, so n rows are n * n / `rows` of the shuffle, and no pair is made that isn't one of the result but those of a
    block with itself.
    """
    wide = any(isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType, T.StringType, T.BinaryType)) for f in df.schema)
    known = df.where(F.col(key).isNotNull())
    blocks = blocks_of(known.count(), rows or (ROWS if wide else 8 * ROWS))
    marked = known.withColumn("__b", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))
    tasks = min(blocks * (blocks + 1) // 2, TASKS)

    def dealt(first: Column, last: Column, other: str, own: str, mark: str) -> DataFrame:
        return marked.withColumn(other, F.explode(F.sequence(first, last))).select(F.col("__b").alias(own), other, *(F.col(c).alias(f"{c}{mark}") for c in df.columns)).repartition(tasks, "__x", "__y")

    left, right = dealt(F.col("__b"), F.lit(blocks - 1), "__y", "__x", ""), dealt(F.lit(0), F.col("__b"), "__x", "__y", "2")
    one, two = F.col(key), F.col(f"{key}2")
    met = left.join(right, ["__x", "__y"]).where((one < two) | ((F.col("__x") < F.col("__y")) & (one > two)))
    return met.select(*(F.when(one < two, F.col(c)).otherwise(F.col(f"{c}2")).alias(c) for c in df.columns), *(F.when(one < two, F.col(f"{c}2")).otherwise(F.col(c)).alias(f"{c}2") for c in df.columns))


def tagged_full_outer(left: DataFrame, right: DataFrame, key: str, value: str, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """Keys of either side with the left side's value before the right's, and the source: left's name, right's name or both."""
    a = left.select(key, F.col(value).alias("__a"), F.lit(True).alias("__in_a"))
    b = right.select(key, F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    source = F.when(F.col("__in_a") & F.col("__in_b"), "both").when(F.col("__in_a"), names[0]).otherwise(names[1])
    return a.join(b, key, "full_outer").select(key, F.when(F.col("__in_a"), F.col("__a")).otherwise(F.col("__b")).alias(value), source.alias("source"))


def containing(inner: DataFrame, outer: DataFrame, key: str, at: str, start: str, stop: str) -> DataFrame:
    """Each inner row with the earliest-starting outer span of its key that its time lies in. Equal inner rows are rows of their own."""
    numbered = inner.withColumn("__copy", F.row_number().over(W.partitionBy(*inner.columns).orderBy(F.lit(0))))
    met = stab(numbered, outer.where(F.col(stop).isNotNull()), key, at, start, stop, 0)
    return met.withColumn("__rn", F.row_number().over(W.partitionBy(*inner.columns, "__copy").orderBy(start, stop))).where("__rn = 1").drop("__rn", "__copy")


def has_codes(ids: DataFrame, diagnoses: DataFrame, codes: DataFrame, key: str, code: str, name: str, pattern: str, groups: Sequence[str]) -> DataFrame:
    """One 0/1 column for each group: whether a code of the key contains a pattern of it (a final x stands for anything)."""
    wanted = codes.withColumn("__like", F.regexp_replace(pattern, "x$", ""))
    met = diagnoses.join(F.broadcast(wanted), F.contains(F.col(code), F.col("__like")))  # a code list of a clinical classification
    flags = met.groupBy(key).pivot(name, list(groups)).agg(F.max(F.lit(1)))
    return ids.join(flags, key, "left").fillna(0, list(groups))


def misses(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of the left side that the right side lacks."""
    return left.join(right.select(key).distinct(), key, "left_anti")
