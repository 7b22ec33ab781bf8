"""Classification and reclassification statistics of (y, p) or (y, p1, p2) tables."""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.operators.quantiles import group_key, ranks

#: The deviate that a normal variable stays within with a chance of 95 %.
NORMAL_95 = NormalDist().inv_cdf(0.975)
#: Risk classes of the categorical net reclassification.
CUTOFFS = (0.0, 0.05, 0.1, 0.2, 1.0)


def confusion(df: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    hit = F.col(p) > threshold
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return df.agg(one((F.col(y) == 1) & hit).alias("tp"), one((F.col(y) == 0) & hit).alias("fp"), one((F.col(y) == 0) & ~hit).alias("tn"), one((F.col(y) == 1) & ~hit).alias("fn"))


def rates(df: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """Accuracy, sensitivity, specificity, predictive values and F1; null where the denominator is 0."""
    d = lambda a, b: F.try_divide(a, b)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return confusion(df, y, p, threshold).select(
        "tp", "fp", "tn", "fn", d(tp + tn, tp + fp + tn + fn).alias("accuracy"), d(tp, tp + fn).alias("sensitivity"), d(tn, tn + fp).alias("specificity"), d(tp, tp + fp).alias("ppv"), d(tn, tn + fn).alias("npv"), d(2 * tp, 2 * tp + fp + fn).alias("f1")
    )


def _value_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.where(F.col(p).isNotNull()).groupBy(F.col(p).alias("p")).agg(F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 0, 1).otherwise(0)).alias("neg"))


def below(df: DataFrame, order: str, sums: Sequence[str], parts: int = 64) -> DataFrame:
    """Adds before_x, the sum of x over all rows of smaller order (numbers, all different), without one global sort task.

    Rows are dealt to ranges between approximate quantiles; a range's own sums run by a window, and the ranges before it are added from a
    table of one row a range.
    """
    cuts = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000)).first()[0] or []
    bounds = F.array(*(F.lit(float(x)) for x in sorted(set(cuts)))).cast("array<double>")
    dealt = df.withColumn("__part", F.size(F.filter(bounds, lambda x: x < F.col(order))))
    by = dealt.groupBy("__part").agg(*(F.sum(x).alias(f"__t_{x}") for x in sums))
    run = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = by.select("__part", *(F.coalesce(F.sum(f"__t_{x}").over(run), F.lit(0)).alias(f"__b_{x}") for x in sums))
    own = W.partitionBy("__part").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(before), "__part")
    return out.withColumns({f"before_{x}": F.coalesce(F.sum(x).over(own), F.lit(0)) + F.col(f"__b_{x}") for x in sums}).drop("__part", *(f"__b_{x}" for x in sums))


def auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(auc, n_pos, n_neg): the share of pairs of a positive and a negative that p orders rightly, ties as a half."""
    ranked = below(_value_counts(df, y, p), "p", ["neg"])
    return ranked.agg(F.try_divide(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def _placed(df: DataFrame, y: str, p: str, out: str) -> DataFrame:
    """Placement value of each row: for a positive the share of negatives under it, for a negative the share of positives over it."""
    c = below(_value_counts(df, y, p), "p", ["neg", "pos"])
    whole = c.agg(F.sum("neg").alias("__n"), F.sum("pos").alias("__p"))
    c = c.join(F.broadcast(whole), F.lit(True))
    c = c.select(F.col("p").alias(p), (F.try_divide(F.col("before_neg") + F.col("neg") / 2, F.col("__n"))).alias("__up"), (1 - F.try_divide(F.col("before_pos") + F.col("pos") / 2, F.col("__p"))).alias("__down"))
    return df.join(c, p).withColumn(out, F.when(F.col(y) == 1, F.col("__up")).otherwise(F.col("__down"))).drop("__up", "__down")


def delong(df: DataFrame, y: str = "y", p1: str = "p1", p2: str = "p2") -> DataFrame:
    """(auc1, low1, high1, auc2, low2, high2, difference, low, high, variance, z, p) of two scores of the same rows: 95 % intervals of each area and of their difference."""
    v = _placed(_placed(df, y, p1, "__v1"), y, p2, "__v2")
    spread = {"s": F.col("__v1") - F.col("__v2"), "s1": F.col("__v1"), "s2": F.col("__v2")}
    g = v.groupBy(F.col(y).alias("y")).agg(F.count("*").alias("n"), F.avg("__v1").alias("m1"), F.avg("__v2").alias("m2"), *(F.var_samp(c).alias(k) for k, c in spread.items()))
    of = lambda c: F.max(F.when(F.col("y") == 1, F.col(c)))
    one = g.agg(of("m1").alias("auc1"), of("m2").alias("auc2"), *(F.sum(F.col(k) / F.col("n")).alias(n) for k, n in (("s", "variance"), ("s1", "__1"), ("s2", "__2"))))
    one = one.withColumn("difference", F.col("auc1") - F.col("auc2")).withColumn("z", F.try_divide(F.col("difference"), F.sqrt("variance")))
    ends = {f"{side}{k}": F.col(c) + sign * NORMAL_95 * F.sqrt(v) for k, c, v in (("", "difference", "variance"), ("1", "auc1", "__1"), ("2", "auc2", "__2")) for side, sign in (("low", -1), ("high", 1))}
    both = 2 * normal_above(F.abs(F.coalesce("z", F.lit(float("nan")))))
    return one.withColumns(ends).withColumn("p", F.nanvl(both, F.lit(None).cast("double"))).select("auc1", "low1", "high1", "auc2", "low2", "high2", "difference", "low", "high", "variance", "z", "p")


def fold_slope(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(slope, intercept): mean score of the positives less that of the negatives, and the latter."""
    one, zero = F.avg(F.when(F.col(y) == 1, F.col(p))), F.avg(F.when(F.col(y) == 0, F.col(p)))
    return df.agg((one - zero).alias("slope"), zero.alias("intercept"))


def _net(df: DataFrame, y: str, up: Column, down: Column) -> list[Column]:
    share = lambda c, k: F.avg(F.when(F.col(y) == k, F.when(c, 1.0).otherwise(0.0)))
    return [(share(up, 1) - share(down, 1)).alias("events"), (share(down, 0) - share(up, 0)).alias("nonevents")]


def reclassification(df: DataFrame, y: str = "y", p1: str = "p1", p2: str = "p2", cutoffs: Sequence[float] = CUTOFFS) -> DataFrame:
    """(events, nonevents, nri): net share of rows that p2 moves to the right side of p1's risk class."""
    level = lambda c: sum(((F.col(c) >= F.lit(x)).cast("int") for x in cutoffs[1:-1]), F.lit(0))
    return df.agg(*_net(df, y, level(p2) > level(p1), level(p2) < level(p1))).withColumn("nri", F.col("events") + F.col("nonevents"))


def continuous_reclassification(df: DataFrame, y: str = "y", p1: str = "p1", p2: str = "p2") -> DataFrame:
    """(events, nonevents, nri, idi): any rise or fall counts; idi is the difference of the two slopes."""
    d = F.col(p2) - F.col(p1)
    idi = F.avg(F.when(F.col(y) == 1, d)) - F.avg(F.when(F.col(y) == 0, d))
    return df.agg(*_net(df, y, d > 0, d < 0), idi.alias("idi")).withColumn("nri", F.col("events") + F.col("nonevents"))


def roc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(p, tpr, fpr) at every value of p as the threshold: the data of a ROC plot."""
    c = below(_value_counts(df, y, p), "p", ["pos", "neg"])
    whole = c.agg(F.sum("pos").alias("__p"), F.sum("neg").alias("__n"))
    return c.join(F.broadcast(whole), F.lit(True)).select("p", (1 - F.try_divide(F.col("before_pos"), F.col("__p"))).alias("tpr"), (1 - F.try_divide(F.col("before_neg"), F.col("__n"))).alias("fpr"))


def _continued_fraction(a: float, b: float, x: float) -> float:
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            c = 1 + k / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    if x < (a + 1) / (a + b + 2):
        return front * _continued_fraction(a, b, x) / a
    return 1 - front * _continued_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| > |t|)."""
    return beta_share(df / 2, 0.5, df / (df + t * t))


def t_quantile(confidence: float, df: float) -> float:
    """t with P(|T| <= t) = confidence."""
    low, high = 0.0, 1e3
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) < confidence else (low, mid)
    return (low + high) / 2


def chi2_above(x: float, df: float) -> float:
    """P(X > x) for chi-squared: the regularised upper incomplete gamma function."""
    from math import exp, lgamma, log

    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return 1 - total * exp(-x + a * log(x) - lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return exp(-x + a * log(x) - lgamma(a)) * h


@F.pandas_udf(T.DoubleType())
def t_p_value(t, df):
    """Two-sided p of t statistics: one value a group, not a row."""
    return t.combine(df, lambda a, b: float("nan") if np.isnan(a) or not b > 0 else t_two_sided(a, b))


@F.pandas_udf(T.DoubleType())
def chi2_p_value(x, df):
    return x.combine(df, lambda a, b: float("nan") if np.isnan(a) or not b > 0 else chi2_above(a, b))


@F.pandas_udf(T.DoubleType())
def t_half_width(sem, df):
    """Half the width of a 95 % interval."""
    return sem.combine(df, lambda s, n: float("nan") if np.isnan(s) or not n > 0 else s * t_quantile(0.95, n))


@F.pandas_udf(T.DoubleType())
def t_half_width_at(sem: pd.Series, df: pd.Series, confidence: pd.Series) -> pd.Series:
    """Half the width of an interval of this confidence: one value a group."""
    return pd.Series([float("nan") if np.isnan(s) or not n > 0 else s * t_quantile(c, n) for s, n, c in zip(sem, df, confidence)], dtype=float)


def mean_interval(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, n, mean, low, high): 95 % t interval of the mean; no width for one value."""
    g = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = F.coalesce(t_half_width(F.coalesce(F.col("sd") / F.sqrt("n"), F.lit(float("nan"))), (F.col("n") - 1).cast("double")), F.lit(None))
    return g.withColumn("h", half).select(*by, "n", "mean", (F.col("mean") - F.col("h")).alias("low"), (F.col("mean") + F.col("h")).alias("high"))


def welch(df: DataFrame, label: str, value: str) -> DataFrame:
    """(label1, label2, t, df, p) for each pair of labels: t-test of the means with unequal variances."""
    m = df.where(F.col(value).isNotNull()).groupBy(F.col(label).alias("l")).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    b = m.select(*(F.col(c).alias(f"{c}2") for c in m.columns))
    pairs = m.join(b, F.col("l") < F.col("l2")).withColumn("a", F.col("v") / F.col("n")).withColumn("c", F.col("v2") / F.col("n2"))  # one row a label
    pairs = pairs.withColumn("t", F.try_divide(F.col("m") - F.col("m2"), F.sqrt(F.col("a") + F.col("c"))))
    pairs = pairs.withColumn("df", F.try_divide(F.pow(F.col("a") + F.col("c"), F.lit(2.0)), F.col("a") * F.col("a") / (F.col("n") - 1) + F.col("c") * F.col("c") / (F.col("n2") - 1)))
    return pairs.select(F.col("l").alias("label1"), F.col("l2").alias("label2"), "t", "df", t_p_value(F.coalesce("t", F.lit(float("nan"))), F.coalesce("df", F.lit(0.0))).alias("p"))


def kruskal(df: DataFrame, label: str, value: str) -> DataFrame:
    """(h, df, p): rank test of equal distributions, ties by their mean rank."""
    values = df.where(F.col(value).isNotNull())
    by_value = values.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ranks = below(by_value, "v", ["n"]).select(F.col("v").alias(value), "n", (F.col("before_n") + (F.col("n") + 1) / 2).alias("rank"))
    ties = ranks.agg(F.sum(F.col("n").cast("double")).alias("total"), F.sum(F.pow(F.col("n"), F.lit(3.0)) - F.col("n")).alias("ties"))
    g = values.join(ranks.drop("n"), value).groupBy(label).agg(F.count("*").alias("n"), F.sum("rank").alias("r"))
    s = g.agg(F.sum(F.col("r") * F.col("r") / F.col("n")).alias("s"), (F.count("*") - 1).cast("double").alias("df"))
    out = s.join(F.broadcast(ties), F.lit(True))
    n = F.col("total")
    out = out.withColumn("h", F.try_divide(12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1), 1 - F.col("ties") / (n * n * n - n)))
    return out.select("h", "df", chi2_p_value(F.coalesce("h", F.lit(float("nan"))), "df").alias("p"))


def normality(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, n, skewness, kurtosis, k2, p): the moment test of normality in its plain (Jarque-Bera) form."""
    g = df.groupBy(*by).agg(F.count(value).alias("n"), F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"))
    g = g.withColumn("k2", F.col("n") / 6 * (F.col("skewness") * F.col("skewness") + F.col("kurtosis") * F.col("kurtosis") / 4))
    return g.withColumn("p", chi2_p_value(F.coalesce("k2", F.lit(float("nan"))), F.lit(2.0)))


def _scores_of_ranks(first: int, last: int, n: int) -> tuple[float, float]:
    """Sum and sum of squares of the approximate normal scores of the ranks first..last (from 1) of n."""
    inverse = NormalDist().inv_cdf
    total = squares = 0.0
    for i in range(first, last + 1):
        m = inverse((i - 0.375) / (n + 0.25))
        total += m
        squares += m * m
    return total, squares


@F.pandas_udf(T.StructType().add("s", T.DoubleType()).add("q", T.DoubleType()))
def normal_scores(before: pd.Series, count: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Of the rows of one value, which have the ranks before + 1 to before + count: one row a distinct value."""
    return pd.DataFrame([_scores_of_ranks(int(b) + 1, int(b + c), int(k)) for b, c, k in zip(before, count, n)], columns=["s", "q"], dtype=float)


#: Fixed values of Royston's approximation: the two outermost weights by powers of 1/sqrt(n) from the first on, and the mean and
#: logarithm of the deviation of the transformed W by powers of n (4 to 11) or of log n (12 and more).
WEIGHTS = ((0.221157, -0.147981, -2.071190, 4.434685, -2.706056), (0.042981, -0.293762, -1.752461, 5.682633, -3.582633))
SMALL = ((0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322))
LARGE = ((-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302))


def _power_sum(x: Column, coefficients: Sequence[float], start: int = 0) -> Column:
    return sum((F.lit(c) * F.pow(x, F.lit(float(k))) for k, c in enumerate(coefficients, start)), F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def normal_above(z: pd.Series) -> pd.Series:
    """P(Z > z): one value a group."""
    from math import erfc, sqrt

    return z.map(lambda x: float("nan") if np.isnan(x) else erfc(x / sqrt(2)) / 2)


def shapiro(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, n, w, p): the Shapiro-Wilk test with Royston's weights, for 3 values or more; null for fewer, and where all are equal w = 1 and p = 1.

    Ranks come from sums over ranges of the values (`quantiles.ranks`), so a group is not sorted in one task; each distinct value brings
    the sum of the normal scores of its ranks, and a group's statistic is one aggregate of these. The p of more than 5,000 values is an extrapolation.
    """
    found = ranks(df, value, by)
    keyed = found.select(group_key(by).alias("__g"), *by, "value", F.col("n").alias("m"), "before")
    sizes = keyed.groupBy("__g").agg(F.sum("m").alias("n"), (F.sum(F.col("m") * F.col("value")) / F.sum("m")).alias("mean"))
    rows = keyed.join(sizes, "__g").withColumn("__z", normal_scores("before", "m", "n"))
    at = lambda i: F.max(F.when((F.col("before") < i) & (i <= F.col("before") + F.col("m")), F.col("value")))
    n = F.col("n")
    ends = [at(F.lit(1)).alias("x1"), at(F.lit(2)).alias("x2"), at(n - 1).alias("x3"), at(n).alias("x4")]
    d = F.col("value") - F.col("mean")
    g = rows.groupBy("__g", "n").agg(*(F.first(c).alias(c) for c in by), *ends, F.sum(F.col("value") * F.col("__z.s")).alias("s"), F.sum("__z.q").alias("q"), F.sum(F.col("m") * d * d).alias("ss"))
    score = lambda i: outer_score(i, n)
    m1, m2 = score(F.lit(0)), score(F.lit(1))
    g = g.withColumn("m1", m1).withColumn("m2", m2)
    c1, c2 = F.col("m1") / F.sqrt("q"), F.col("m2") / F.sqrt("q")
    u = 1 / F.sqrt(n)
    a1 = F.when(n == 3, F.lit(0.5**0.5)).otherwise(c1 + _power_sum(u, WEIGHTS[0], 1))
    g = g.withColumn("a1", a1).withColumn("a2", c2 + _power_sum(u, WEIGHTS[1], 1))
    m1, m2, a1, a2 = (F.col(c) for c in ("m1", "m2", "a1", "a2"))
    outer, inner = F.col("x4") - F.col("x1"), F.col("x3") - F.col("x2")
    two = F.sqrt((F.col("q") - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2))
    one = F.sqrt((F.col("q") - 2 * m1 * m1) / (1 - 2 * a1 * a1))
    sums = F.when(n == 3, a1 * outer).when(n <= 5, a1 * outer + (F.col("s") - m1 * outer) / one).otherwise(a1 * outer + a2 * inner + (F.col("s") - m1 * outer - m2 * inner) / two)
    g = g.withColumn("w", F.when(n >= 3, F.when(F.col("ss") == 0, 1.0).otherwise(F.least(sums * sums / F.col("ss"), F.lit(1.0)))))
    w, low = F.col("w"), F.log(1 - F.col("w"))
    x = F.log(n)
    small = (-F.log(F.lit(-2.273) + 0.459 * n - low) - _power_sum(n.cast("double"), SMALL[0])) / F.exp(_power_sum(n.cast("double"), SMALL[1]))
    large = (low - _power_sum(x, LARGE[0])) / F.exp(_power_sum(x, LARGE[1]))
    z = F.coalesce(F.when(n <= 11, small).otherwise(large), F.lit(float("nan")))
    three = F.lit(6 / np.pi) * (F.asin(F.sqrt(w)) - F.lit(float(np.arcsin(0.75**0.5))))
    p = F.when(w == 1, 1.0).when(n == 3, F.greatest(three, F.lit(0.0))).otherwise(normal_above(z))
    out = g.select(*by, "n", "w", p.alias("p"))
    return out.withColumn("p", F.when(F.col("w").isNotNull(), F.col("p")))


@F.pandas_udf(T.DoubleType())
def outer_score(place: pd.Series, n: pd.Series) -> pd.Series:
    """Normal score of the largest value but `place` of n: one value a group."""
    return pd.Series([NormalDist().inv_cdf((k - i - 0.375) / (k + 0.25)) if k > i else float("nan") for i, k in zip(place, n)], dtype=float)


def moment_normality(df: DataFrame, value: str, *by: str) -> DataFrame:
    """(by, n, z_skewness, z_kurtosis, k2, p): D'Agostino and Pearson's test, for 8 values or more; null for fewer and for equal values."""
    g = df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.skewness(value).alias("g1"), F.kurtosis(value).alias("g2"))
    n = F.col("n").cast("double")
    y = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b - 1)) - 1
    ratio = y / F.sqrt(2 / (w2 - 1))
    skew = F.log(ratio + F.sqrt(ratio * ratio + 1)) / F.sqrt(0.5 * F.log(w2))
    x = (F.col("g2") + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)))
    beta = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / beta * (2 / beta + F.sqrt(1 + 4 / (beta * beta)))
    under = 1 + x * F.sqrt(2 / (a - 4))
    kurt = (1 - 2 / (9 * a) - F.signum(under) * F.pow((1 - 2 / a) / F.abs(under), F.lit(1 / 3))) / F.sqrt(2 / (9 * a))
    fits = (F.col("n") >= 8) & F.col("g1").isNotNull() & ~F.isnan("g1")
    out = g.withColumn("z_skewness", F.when(fits, skew)).withColumn("z_kurtosis", F.when(fits, kurt))
    out = out.withColumn("k2", F.col("z_skewness") * F.col("z_skewness") + F.col("z_kurtosis") * F.col("z_kurtosis"))
    return out.select(*by, "n", "z_skewness", "z_kurtosis", "k2", F.exp(-F.col("k2") / 2).alias("p"))


def pooled_t(df: DataFrame, label: str, value: str) -> DataFrame:
    """(label1, label2, t, df, p) for each pair of labels: t-test of the means with one variance."""
    m = df.where(F.col(value).isNotNull()).groupBy(F.col(label).alias("l")).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    pairs = m.join(m.select(*(F.col(c).alias(f"{c}2") for c in m.columns)), F.col("l") < F.col("l2")).withColumn("df", (F.col("n") + F.col("n2") - 2).cast("double"))  # one row a label
    pooled = ((F.col("n") - 1) * F.col("v") + (F.col("n2") - 1) * F.col("v2")) / F.nullif(F.col("df"), F.lit(0.0))
    pairs = pairs.withColumn("t", F.try_divide(F.col("m") - F.col("m2"), F.sqrt(pooled * (1 / F.col("n") + 1 / F.col("n2")))))
    return pairs.select(F.col("l").alias("label1"), F.col("l2").alias("label2"), "t", "df", t_p_value(F.coalesce("t", F.lit(float("nan"))), "df").alias("p"))
