"""Folds, balancing, classifiers with out-of-fold scores, feature selection, stacking. Learners are those of pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import UnivariateFeatureSelector, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shuffled(key: str, seed: int = 1) -> Column:
    """A fixed order of keys that looks random: the digest of the seed and the key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def placed(df: DataFrame, key: str, y: str, seed: int = 1, out: str = "__place") -> DataFrame:
    """Adds each row's place within its class in the fixed order, from 0.

    A class may be most of the table, so rows are ranked within the first three digits of their digest, and the numbers of rows before each of
    those (at most 4096 a class) are added.
    """
    df = df.withColumn("__o", shuffled(key, seed)).withColumn("__p", F.substring("__o", 1, 3))
    sizes = df.groupBy(y, "__p").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy(y).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = sizes.select(F.col(y).alias("__y"), F.col("__p").alias("__q"), before.alias("__before"))
    rank = F.row_number().over(W.partitionBy(y, "__p").orderBy("__o", key)) - 1
    joined = df.withColumn("__r", rank).join(F.broadcast(at), F.col(y).eqNullSafe(F.col("__y")) & (F.col("__p") == F.col("__q")))
    return joined.withColumn(out, F.col("__before") + F.col("__r")).drop("__o", "__p", "__r", "__y", "__q", "__before")


def folds(df: DataFrame, key: str, y: str, k: int = 10, seed: int = 1) -> DataFrame:
    """Adds fold 0..k-1, dealt within each class in the fixed order."""
    return placed(df, key, y, seed).withColumn("fold", (F.col("__place") % k).cast("int")).drop("__place")


def balanced(df: DataFrame, key: str, y: str, method: str = "under", seed: int = 1) -> DataFrame:
    """As many rows of either class: the first of the larger in the fixed order (under), or the smaller's repeated (rand_over)."""
    counts = {r[0]: r[1] for r in df.groupBy(y).count().collect()}  # two classes
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    few = 1 if pos <= neg else 0
    n, m = min(pos, neg), max(pos, neg)
    ranked = placed(df, key, y, seed)
    if method == "rand_over":
        if not n:
            return df
        whole, rest = divmod(m, n)
        times = F.when(F.col(y) == few, F.lit(whole) + (F.col("__place") < rest).cast("int")).otherwise(1)
        return ranked.withColumn("__t", F.explode(F.array_repeat(F.lit(1), times))).drop("__t", "__place")
    return ranked.where((F.col(y) == few) | (F.col("__place") < n)).drop("__place")


def class_weights(df: DataFrame, y: str) -> DataFrame:
    """Adds weight: rows over the rows of the class."""
    by = df.groupBy(F.col(y).alias("__y")).agg(F.count("*").alias("__n"))
    whole = by.agg(F.sum("__n").alias("__all"))
    return df.join(F.broadcast(by.join(whole, F.lit(True))), F.col(y).eqNullSafe(F.col("__y"))).withColumn("weight", F.col("__all") / F.col("__n")).drop("__y", "__n", "__all")


def learner(kind: str, **params):
    makers = {"log": LogisticRegression, "rf": RandomForestClassifier, "svm": LinearSVC, "gbt": GBTClassifier, "lin": LinearRegression}
    return makers[kind](featuresCol="__x", labelCol="__y", **params)


def fitted(train: DataFrame, columns: Sequence[str], y: str, kind: str = "log", **params) -> PipelineModel:
    """A saved or applied model of the columns; rows with a missing feature are skipped. `model.write()` keeps it."""
    stages = [VectorAssembler(inputCols=list(columns), outputCol="__x", handleInvalid="skip"), learner(kind, **params)]
    return Pipeline(stages=stages).fit(train.withColumn("__y", F.col(y).cast("double")))


def scored(model: PipelineModel, df: DataFrame, out: str = "p") -> DataFrame:
    """Probability of class 1; for the two learners without probabilities their raw score or prediction."""
    f = model.transform(df)
    if "probability" in f.columns:
        p = vector_to_array("probability")[1]
    elif "rawPrediction" in f.columns:
        p = vector_to_array("rawPrediction")[1]
    else:
        p = F.col("prediction")
    return f.withColumn(out, p).drop("__x", "rawPrediction", "probability", "prediction")


def cross_scored(df: DataFrame, columns: Sequence[str], key: str, y: str, kind: str = "log", k: int = 10, sample: str | None = "under", out: str = "p", seed: int = 1, **params) -> DataFrame:
    """Each row with the score of the model that did not see its fold; training folds are balanced first."""
    dealt = folds(df, key, y, k, seed)
    result = None
    for i in range(k):
        train = dealt.where(F.col("fold") != i)
        model = fitted(balanced(train, key, y, sample, seed) if sample else train, columns, y, kind, **params)
        part = scored(model, dealt.where(F.col("fold") == i), out)
        result = part if result is None else result.unionByName(part)
    return result


def grid_searched(df: DataFrame, columns: Sequence[str], y: str, kind: str, grid: dict[str, list], k: int = 8, share: float = 0.8, key: str = "id", seed: int = 1):
    """(best model, its area under the curve on the rows held out, areas of all settings)."""
    part = F.conv(F.substring(shuffled(key, seed), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    data = VectorAssembler(inputCols=list(columns), outputCol="__x", handleInvalid="skip").transform(df).withColumn("__y", F.col(y).cast("double"))
    est = learner(kind)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(est.getParam(name), values)
    auc = BinaryClassificationEvaluator(labelCol="__y", rawPredictionCol="rawPrediction")
    cv = CrossValidator(estimator=est, estimatorParamMaps=builder.build(), evaluator=auc, numFolds=k, seed=seed).fit(data.where(part < share))
    return cv.bestModel, auc.evaluate(cv.bestModel.transform(data.where(part >= share))), cv.avgMetrics


def selected(df: DataFrame, columns: Sequence[str], y: str, method: str = "univariate", n: int = 10, threshold: float = 0.0, **params) -> list[str]:
    """Names of the columns that a method keeps: variance, univariate, l1, tree, or rfe (drop the weakest one by one)."""
    columns = list(columns)
    data = VectorAssembler(inputCols=columns, outputCol="__x", handleInvalid="skip").transform(df).withColumn("__y", F.col(y).cast("double"))
    if method == "variance":
        kept = VarianceThresholdSelector(featuresCol="__x", outputCol="__o", varianceThreshold=threshold).fit(data).selectedFeatures
    elif method == "univariate":
        s = UnivariateFeatureSelector(featuresCol="__x", labelCol="__y", outputCol="__o", selectionMode="numTopFeatures").setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(n)
        kept = s.fit(data).selectedFeatures
    elif method == "l1":
        c = learner("log", elasticNetParam=1.0, **({"regParam": 0.01} | params)).fit(data).coefficients.toArray()
        kept = [i for i, w in enumerate(c) if abs(w) > 1e-9]
    elif method == "tree":
        w = learner("rf", seed=1, **params).fit(data).featureImportances.toArray()
        kept = sorted(sorted(range(len(columns)), key=lambda i: (-w[i], i))[:n])
    elif method == "rfe":
        left = columns
        while len(left) > n:
            c = fitted(df, left, y, "log", **params).stages[-1].coefficients.toArray()
            left = [f for f in left if f != left[int(abs(c).argmin())]]
        return left
    else:
        raise ValueError(method)
    return [columns[i] for i in sorted(kept)]


def odds(model: PipelineModel, columns: Sequence[str], spark) -> DataFrame:
    """(feature, coefficient, odds, rank by size) of a logistic model."""
    c = model.stages[-1].coefficients.toArray()
    f = spark.createDataFrame([(n, float(w)) for n, w in zip(columns, c)], "feature string, coefficient double")
    return f.withColumn("odds", F.exp("coefficient")).withColumn("rank", F.row_number().over(W.orderBy(F.abs("coefficient").desc(), "feature")))  # one row a feature


def mean_coefficients(folds_: DataFrame) -> DataFrame:
    """(feature, mean, odds, low, high): over folds of (feature, coefficient); the 5th and 95th percentile of the odds."""
    q = F.percentile(F.exp("coefficient"), F.array(F.lit(0.05), F.lit(0.95)))
    g = folds_.groupBy("feature").agg(F.avg("coefficient").alias("mean"), F.avg(F.exp("coefficient")).alias("odds"), q.alias("__q"))
    return g.select("feature", "mean", "odds", F.get("__q", F.lit(0)).alias("low"), F.get("__q", F.lit(1)).alias("high"))


def stacked(df: DataFrame, columns: Sequence[str], key: str, y: str, kinds: Sequence[str] = ("log", "rf", "gbt"), k: int = 5, rounds: int = 1, out: str = "p") -> DataFrame:
    """Super learner: a logistic model of the learners' out-of-fold scores; more rounds feed the scores back as features."""
    features = list(columns)
    f = df
    for r in range(rounds):
        made = []
        for kind in kinds:
            name = f"__{kind}{r}"
            part = cross_scored(f, features, key, y, kind, k, None, name).select(F.col(key).alias("__k"), name)
            f = f.join(part, f[key] == F.col("__k")).drop("__k")
            made.append(name)
        features = [*columns, *made]
    final = cross_scored(f, made, key, y, "log", k, None, out, seed=2)
    return final.drop(*(c for c in final.columns if c.startswith("__")), "fold")


def subsemble(df: DataFrame, columns: Sequence[str], key: str, y: str, parts: int = 3, kind: str = "log", k: int = 5, out: str = "p") -> DataFrame:
    """One learner for each of `parts` disjoint sets of rows, combined by a logistic model of their scores out of fold."""
    f = folds(df, key, y, k).withColumnRenamed("fold", "__f")
    f = folds(f, key, y, parts, seed=3).withColumnRenamed("fold", "__part")
    result = None
    for i in range(k):
        test = f.where(F.col("__f") == i)
        for j in range(parts):
            test = scored(fitted(f.where((F.col("__f") != i) & (F.col("__part") == j)), columns, y, kind), test, f"__s{j}")
        result = test if result is None else result.unionByName(test)
    final = cross_scored(result, [f"__s{j}" for j in range(parts)], key, y, "log", k, None, out, seed=2)
    return final.drop(*(c for c in final.columns if c.startswith("__")), "fold")


def performance_rows(models: Sequence[str], features: Sequence[str]) -> list[tuple[str, str]]:
    """The (model, feature set) cells of a results sheet."""
    return [(m, f) for m in models for f in features]
