"""Valid ranges, outlier trimming, imputation, scaling. Statistics are one aggregate pass, read back as one row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajecta.operators.quantiles import quantiles

#: Fixed valid ranges of the measurements (low, high); None is open.
VALID = {
    "bicarbonate": (5, 50), "bun": (5, None), "fio2": (21, 100), "heart_rate": (25, None), "pco2": (0, 125),
    "respiration": (5, 70), "temperature": (86, 113), "weight": (30, 200), "map": (0, None),
}
#: Columns of which the far low or high values are removed.
TRIM_LOW = ("map_low", "height")
TRIM_HIGH = ("urine_out", "wbc_low", "wbc_high", "map_high", "height", "potassium_high", "potassium_low")
TRIM_SD = 1.96


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN as null in all floating columns: NaN compares as the largest value, null as unknown."""
    kinds = {"double", "float"}
    return df.select(*(F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if t in kinds else F.col(f"`{c}`") for c, t in df.dtypes))


def clamped(df: DataFrame, ranges: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """Values outside their column's range become null."""
    out = {}
    for c, (low, high) in ranges.items():
        inside = F.lit(True)
        if low is not None:
            inside = inside & (F.col(c) >= low)
        if high is not None:
            inside = inside & (F.col(c) <= high)
        out[c] = F.when(inside, F.col(c))
    return df.withColumns(out)


def _one_row(df: DataFrame, statistics: DataFrame) -> DataFrame:
    return df.join(F.broadcast(statistics), F.lit(True))  # an aggregate without groups: one row


def trimmed(df: DataFrame, low: Sequence[str] = (), high: Sequence[str] = (), sd: float = TRIM_SD) -> DataFrame:
    """Values more than `sd` population deviations under (low) or over (high) the mean become null; a column of both is trimmed low first, then by what is left."""
    for side, columns in (("low", low), ("high", high)):
        if not columns:
            continue
        stats = df.agg(*(x for c in columns for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))))
        joined = _one_row(df, stats)
        edge = {c: F.col(f"__m_{c}") + (1 if side == "high" else -1) * sd * F.col(f"__s_{c}") for c in columns}
        kept = {c: F.when(F.col(c) <= edge[c] if side == "high" else F.col(c) >= edge[c], F.col(c)) for c in columns}
        df = joined.withColumns(kept).drop(*(f"__{x}_{c}" for c in columns for x in "ms"))
    return df


def _medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, __m_column for each column)."""
    at = [F.max(F.when(F.col("column") == c, F.get("q", F.lit(0)))).alias(f"__m_{c}") for c in columns]
    return quantiles(df, columns, [0.5], by).groupBy(*by).agg(*at)


def imputed(df: DataFrame, columns: Sequence[str], zero_if: Sequence[str] = ("crrt", "hd", "mv")) -> DataFrame:
    """Nulls become the column's exact median, or 0 where the name contains one of `zero_if`."""
    zero = [c for c in columns if any(z in c for z in zero_if)]
    rest = [c for c in columns if c not in zero]
    out = df.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in zero})
    if not rest:
        return out
    stats = _medians(df, rest)
    return _one_row(out, stats).withColumns({c: F.coalesce(F.col(c), F.col(f"__m_{c}")) for c in rest}).drop(*(f"__m_{c}" for c in rest))


def imputed_by(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Nulls become the median of the row's group; a null group is a group."""
    stats = _medians(df, columns, [group]).withColumnRenamed(group, "__g")
    joined = df.join(stats, F.col(group).eqNullSafe(F.col("__g")), "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"__m_{c}")) for c in columns}).drop("__g", *(f"__m_{c}" for c in columns))


def scaled(df: DataFrame, columns: Sequence[str], reference: DataFrame | None = None) -> DataFrame:
    """(x - min) / (max - min), of the reference cohort if given; a constant column is 0."""
    stats = (reference if reference is not None else df).agg(*(x for c in columns for x in (F.min(c).alias(f"__lo_{c}"), F.max(c).alias(f"__hi_{c}"))))
    span = lambda c: F.col(f"__hi_{c}") - F.col(f"__lo_{c}")
    out = {c: F.when(span(c) == 0, F.when(F.col(c).isNotNull(), 0.0)).otherwise((F.col(c) - F.col(f"__lo_{c}")) / F.nullif(span(c), F.lit(0)).cast("double")) for c in columns}
    return _one_row(df, stats).withColumns(out).drop(*(f"__{x}_{c}" for c in columns for x in ("lo", "hi")))


def recoded(value: Column, mapping: Mapping[object, object]) -> Column:
    out = value
    for old, new in mapping.items():
        out = F.when(value == F.lit(old), F.lit(new)).otherwise(out)
    return out


def first_reason(flags: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first flag that is set."""
    return F.coalesce(*(F.when(c, F.lit(n)) for n, c in flags))


def none_set(flags: Sequence[str]) -> Column:
    """No exclusion flag is set; a null flag counts as not set."""
    return F.greatest(*(F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in flags), F.lit(0)) == 0


def celsius(fahrenheit: Column) -> Column:
    return (fahrenheit - 32) * 5 / 9


def body_mass_index(weight_kg: Column, height_m: Column) -> Column:
    return F.try_divide(weight_kg, height_m * height_m)


def columns_named(names: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """The wanted columns in the table's order; an error for those it lacks."""
    missing = [w for w in wanted if w not in names]
    if missing:
        raise ValueError(f"no such columns: {missing}")
    return [n for n in names if n in wanted]


def feature_columns(df: DataFrame, wanted: Sequence[str]) -> list[Column]:
    """Columns for feature names whatever their case; name_low and name_high take the fields of a pair column."""
    by_name = {c.lower(): c for c in df.columns}
    out = []
    for name in wanted:
        low = name.lower()
        stem, _, end = low.rpartition("_")
        if low in by_name:
            out.append(F.col(f"`{by_name[low]}`").alias(name))
        elif end in ("low", "high") and stem in by_name:
            out.append(F.col(f"`{by_name[stem]}`.{end}").alias(name))
        else:
            raise ValueError(f"no feature {name}")
    return out
