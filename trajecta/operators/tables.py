"""Grouped summary tables: counts, shares, means and quartiles by label and in total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajecta.operators import evaluation
from trajecta.operators.quantiles import quantiles

TOTAL = "Total"


def _by_label(df: DataFrame, label: str, *sums: Column) -> DataFrame:
    rolled = df.rollup(label).agg(F.grouping(label).alias("__all"), *sums)
    return rolled.withColumn(label, F.when(F.col("__all") == 1, TOTAL).otherwise(F.col(label).cast("string"))).drop("__all")


def counts(df: DataFrame, label: str, flags: Sequence[str]) -> DataFrame:
    """(label, n, and for each flag its count and share), each label and the total."""
    return _by_label(df, label, F.count("*").alias("n"), *(x for f in flags for x in (F.sum(F.coalesce(F.col(f).cast("int"), F.lit(0))).alias(f"n_{f}"), F.avg(F.coalesce(F.col(f).cast("int"), F.lit(0))).alias(f"share_{f}"))))


def row_shares(df: DataFrame, label: str, flag: str) -> DataFrame:
    """(label, n, share of all rows with the flag)."""
    by = df.groupBy(label).agg(F.sum(F.col(flag).cast("int")).alias("n"))
    whole = by.agg(F.sum("n").alias("__whole"))
    return by.join(F.broadcast(whole), F.lit(True)).select(label, "n", F.try_divide(F.col("n"), F.col("__whole")).alias("share"))


def mean_sd(df: DataFrame, label: str, value: str) -> DataFrame:
    return _by_label(df, label, F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"))


def median_iqr(df: DataFrame, label: str, value: str) -> DataFrame:
    """(label, n, q1, median, q3), each label and the total."""
    both = df.select(F.explode(F.array(F.col(label).cast("string"), F.lit(TOTAL))).alias(label), F.col(value).alias(value))
    return quantiles(both, [value], (0.25, 0.5, 0.75), [label]).select(label, "n", *(F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("q1", "median", "q3"))))


def long_table(df: DataFrame, label: str, flags: Sequence[str], values: Sequence[str]) -> DataFrame:
    """(label, row, kind, n, a, b, c) of all flags (count, share) and values (median, quartiles): the data of a formatted table.

    All flags are summed in one pass and the quantiles of all values narrowed together, whatever the table's length.
    """
    both = df.withColumn(label, F.explode(F.array(F.col(label).cast("string"), F.lit(TOTAL))))
    rows = [F.struct(F.lit(f).alias("row"), F.count(f).alias("n"), F.sum(F.col(f).cast("double")).alias("a"), F.avg(F.col(f).cast("double")).alias("b")) for f in flags]
    out = []
    if flags:
        out.append(both.groupBy(label).agg(F.array(*rows).alias("e")).withColumn("e", F.explode("e")).select(label, "e.row", F.lit("count").alias("kind"), "e.n", "e.a", "e.b", F.lit(None).cast("double").alias("c")))
    if values:
        q = quantiles(both, values, (0.5, 0.25, 0.75), [label])
        out.append(q.select(label, F.col("column").alias("row"), F.lit("median").alias("kind"), "n", *(F.get("q", F.lit(i)).alias(c) for i, c in enumerate("abc"))))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def chosen(df: DataFrame, label: str, value: str) -> DataFrame:
    """(label, n, kind, a, b, c, p, mark) of each label and the total: mean and population deviation, or median and quartiles.

    As the tables of the study have it, the mean is given where the Shapiro-Wilk test of all values rejects normality (p under 0.05), the median else.
    Of two labels, p is that of the Kruskal-Wallis test if either's values fail D'Agostino's test, else of the t-test; 1 where a label has under 8
    values. It stands in the second label's row with its mark (** under 0.01, * under 0.05); for other numbers of labels it is null.
    """
    known = df.where(F.col(label).isNotNull())
    w = evaluation.shapiro(df, value).first()
    if w is not None and w["p"] is not None and w["p"] < 0.05:
        out = mean_sd(known, label, value).select(label, "n", F.lit("mean").alias("kind"), F.col("mean").alias("a"), F.col("sd").alias("b"), F.lit(None).cast("double").alias("c"))
    else:
        out = median_iqr(known, label, value).select(label, "n", F.lit("median").alias("kind"), F.col("median").alias("a"), F.col("q1").alias("b"), F.col("q3").alias("c"))
    names = [r[0] for r in known.select(F.col(label).cast("string")).distinct().orderBy(label).limit(3).collect()]
    p = None
    if len(names) == 2:
        tests = evaluation.moment_normality(known, value, label).collect()
        if len(tests) < 2 or min(r["n"] for r in tests) < 8:
            p = 1.0
        elif any(r["p"] is not None and r["p"] < 0.05 for r in tests):
            p = evaluation.kruskal(known, label, value).first()["p"]
        else:
            p = evaluation.pooled_t(known, label, value).first()["p"]
    at = F.col(label) == (names[1] if p is not None else F.lit(None))
    mark = "" if p is None or not p < 0.05 else "**" if p < 0.01 else "*"
    return out.withColumns({"p": F.when(at, F.lit(p).cast("double")), "mark": F.when(at, mark)})


def label_order(df: DataFrame, label: str, flag: str) -> DataFrame:
    """(label, rate, place): labels by the share of rows with the flag, the lowest first (place 1), of equal ones the first by name."""
    rates = df.groupBy(label).agg(F.avg(F.coalesce(F.col(flag).cast("double"), F.lit(0.0))).alias("rate"))
    return rates.withColumn("place", F.row_number().over(W.orderBy("rate", label)))  # one row a label


def feature_pairs(df: DataFrame, label: str, flag: str, features: Sequence[str]) -> DataFrame:
    """(feature, label1, label2, mean1, mean2, t, p): for each feature and each pair of labels, in order of their rates of the flag, the means and the t-test with one variance.

    Features are unpivoted once and summed by (feature, label); the tests are of these sums. Null and NaN are left out; a label without a value of the feature has no pair of it.
    """
    values = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias("v")) for f in features)))
    sums = df.select(F.col(label).alias("label"), values.alias("e")).select("label", "e.*").where("v is not null").groupBy("feature", "label").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.coalesce(F.var_samp("v"), F.lit(0.0)).alias("s"))
    sums = sums.join(label_order(df, label, flag).select(F.col(label).alias("label"), "place"), "label")  # one row a feature and label
    one, two = (sums.select("feature", *(F.col(c).alias(f"{c}{k}") for c in ("label", "n", "m", "s", "place"))) for k in (1, 2))
    pairs = one.join(two, "feature").where("place1 < place2").withColumn("df", (F.col("n1") + F.col("n2") - 2).cast("double"))
    pooled = F.try_divide((F.col("n1") - 1) * F.col("s1") + (F.col("n2") - 1) * F.col("s2"), F.col("df"))
    pairs = pairs.withColumn("t", F.try_divide(F.col("m1") - F.col("m2"), F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))))
    p = F.nanvl(evaluation.t_p_value(F.coalesce("t", F.lit(float("nan"))), "df"), F.lit(None).cast("double"))
    return pairs.select("feature", "label1", "label2", F.col("m1").alias("mean1"), F.col("m2").alias("mean2"), "t", p.alias("p"))


def rate_spread(df: DataFrame, label: str, flag: str) -> DataFrame:
    """(max_spread, min_spread, mean_spread) of the absolute differences between the labels' rates of the flag."""
    rates = df.groupBy(label).agg(F.avg(F.col(flag).cast("double")).alias("r"))
    pairs = rates.alias("x").join(rates.alias("y"), F.col(f"x.{label}") < F.col(f"y.{label}")).select(F.abs(F.col("x.r") - F.col("y.r")).alias("d"))  # one row a label
    return pairs.agg(F.max("d").alias("max_spread"), F.min("d").alias("min_spread"), F.avg("d").alias("mean_spread"))


def disposition(text: Column) -> Column:
    """Kind of a discharge text, the first that fits; expired with neither LESS nor MORE is of no kind."""
    up = F.upper(text)
    return (
        F.when(up.rlike("EXP"), F.when(up.rlike("LESS"), "expired_early").when(up.rlike("MORE"), "expired_late"))
        .when(up.rlike("ALIVE"), "alive").when(up.rlike("XFER|TRANS"), "transferred").when(up.rlike("AMA"), "against_advice")
        .when(F.trim(up) == "", "blank").otherwise("other")
    )
