"""Dates: several formats, differences in units, calendar days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Formats in the order in which they are tried.
FORMATS = ("yyyy-MM-dd HH:mm:ss", "M/d/yy H:mm", "M/d/yy", "M/d/yyyy")
UNIT_SECONDS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "y": 365 * 86400}


def parse_timestamp(text: Column) -> Column:
    """The first format that fits, fractions of seconds dropped; null if none does. Two-digit years from 69 on are of the last century."""
    whole = F.split_part(F.trim(text), F.lit("."), F.lit(1))
    tried = []
    for pattern in FORMATS:
        t = F.try_to_timestamp(whole, F.lit(pattern))
        if "/yy" in pattern and "yyyy" not in pattern:
            t = F.when(F.year(t) >= 2069, t - F.expr("interval 100 years")).otherwise(t)
        tried.append(t)
    return F.coalesce(*tried)


def parse_timestamps(texts: Column) -> Column:
    return F.transform(texts, parse_timestamp)


def seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds, with microseconds."""
    return F.timestamp_diff("MICROSECOND", a, b) / F.lit(1_000_000.0)


def difference(a: Column, b: Column, unit: str = "s") -> Column:
    """b - a in seconds, minutes, hours, days or years of 365 days."""
    return seconds_between(a, b) / F.lit(float(UNIT_SECONDS[unit]))


def calendar_days(a: Column, b: Column) -> Column:
    """Difference of the dates, whatever the time of day."""
    return F.date_diff(F.to_date(b), F.to_date(a))


def whole_days(a: Column, b: Column) -> Column:
    """Whole days from a to b, rounded down also below zero."""
    return F.floor(seconds_between(a, b) / F.lit(86400.0))


def floor_to_bin(t: Column, hours: int) -> Column:
    """Start of the `hours`-hour bin of the day that t is in."""
    return F.date_trunc("DAY", t) + F.make_dt_interval(hours=(F.floor(F.hour(t) / hours) * hours).cast("int"))


def midpoint(a: Column, b: Column) -> Column:
    return a + F.make_dt_interval(secs=(F.floor(F.timestamp_diff("MICROSECOND", a, b) / 2) / F.lit(1e6)).cast("decimal(18,6)"))
