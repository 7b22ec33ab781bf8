"""Quality classifier: Bradley-Terry ranking of documents from preference pairs, with a threshold at a score quantile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajecta.llm.arrowtext import SPACED, blocks, words
from trajecta.llm.partenum import shingles
from trajecta.llm.scratch import Scratch, key_filter, passes, plain
from trajecta.operators.quantiles import quantiles
from trajecta.sources.steps import Steps

#: Scores up to so far apart are summed up together while pairs are compared; pull of the weights to 0; most passes over the labelled rows.
WIDTH, PULL, PASSES = 1 / 16, 1e-3, 60
#: A score of 0.3 stands at the threshold, one of 0.9 at the median of the preferred rows.
AT_THRESHOLD, AT_MEDIAN = 0.3, 0.9

_CLASSES = ["other", "upper", "lower", "digit", "space", "line", "stop", "comma", "shout", "bar", "symbol", "beyond"]
_CLASS = np.zeros(256, dtype=np.int64)
for _name, _bytes in {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": b" \t\r\v\f", "line": b"\n",
    "stop": b".?", "comma": b",;:'\"()-", "shout": b"!", "bar": b"|", "symbol": b"#*$%&<>@^~=+\\/_{}[]`", "beyond": range(128, 256),
}.items():
    _CLASS[list(_bytes)] = _CLASSES.index(_name)
FEATURES = [*(f"share_{c}" for c in _CLASSES), "log_words", "word_bytes", "distinct_words", "distinct_runs", "bare_words", "line_words", "stop_words"]


def _measured(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; zeros for a text without bytes."""
    n, sizes = len(at) - 1, np.diff(at)
    k = len(_CLASSES)
    owner = np.repeat(np.arange(n), sizes)
    counts = np.bincount(owner * k + _CLASS[raw], minlength=n * k).reshape(n, k)
    w = words(raw, at, SPACED)
    n_words = w.counts()
    order = np.lexsort((w.hash, w.text))
    t, h = w.text[order], w.hash[order]
    new = np.ones(len(t), dtype=bool)
    new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
    distinct = np.bincount(t[new], minlength=n)
    runs = np.bincount(shingles(w, 3)[0], minlength=n)
    letters = np.concatenate([[0], np.cumsum((_CLASS[raw] == 1) | (_CLASS[raw] == 2) | (_CLASS[raw] == 11))])
    bare = np.bincount(w.text[letters[w.end] == letters[w.start]], minlength=n)
    some, most = np.maximum(sizes, 1), np.maximum(n_words, 1)
    lines, stops = counts[:, 5] + 1, counts[:, 6] + counts[:, 8] + 1
    full = sizes > 0
    columns = [*(np.sqrt(counts / some[:, None]).T), np.log1p(n_words), np.minimum(np.where(n_words > 0, (sizes - counts[:, 4] - counts[:, 5]) / most, 0), 30), distinct / most, runs / np.maximum(n_words - 2, 1), bare / most, np.log1p(n_words / lines), np.log1p(n_words / stops)]
    return np.stack(columns, axis=1) * full[:, None]


def features(docs: DataFrame, keep: list[str], text: str, out: str = "x", bits=None) -> DataFrame:
    """The columns `keep` with `out`, the features of each whole text; with `bits` (a broadcast `key_filter`) only of rows whose first kept column passes."""
    fields = docs.select(*map(plain, keep)).schema.add(out, T.ArrayType(T.DoubleType()))
    names, m = fields.names, len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bits is not None:
                batch = batch.filter(pa.array(passes(bits.value, batch.column(0).to_numpy(zero_copy_only=False))))
            for a, b, raw, at in blocks(batch.column(len(keep))):
                x = _measured(raw, at)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * m), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(len(keep))), lists], names=names)

    return docs.select(*(plain(c).alias(f"f{i}") for i, c in enumerate(keep)), plain(text).alias("__features_of")).mapInArrow(run, fields)


def _by_score(fit: DataFrame, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, n_parts: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]:
    """For label 1 and for label 0, by ranges of score of WIDTH: rows, sums of the scaled features, sums of their products."""
    m = len(mean)

    def summed(y: np.ndarray, at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((at, y))
        y, at = y[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], (y[1:] != y[:-1]) | (at[1:] != at[:-1])]))
        return y[first], at[first], np.add.reduceat(values[order], first)

    def lists(values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            z = (batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, m) - mean) / scale
            values = np.concatenate([np.ones((len(z), 1)), z, (z[:, :, None] * z[:, None, :]).reshape(-1, m * m)], axis=1)
            new = summed(batch.column(0).to_numpy(zero_copy_only=False), np.floor(z @ weights / WIDTH).astype(np.int64), values)
            held = new if held is None else summed(*(np.concatenate(pair) for pair in zip(held, new)))
        if held is not None:
            y, at, values = held
            yield pa.RecordBatch.from_arrays([pa.array(y), pa.array(at), lists(values)], names=["y", "at", "v"])

    def merged(key: tuple, part: pa.Table) -> pa.Table:
        v = part["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 1 + m + m * m)
        y, at, values = summed(part["y"].to_numpy(), part["at"].to_numpy(), v)
        return pa.table({"y": y, "at": at, "v": lists(values)})

    kinds = "y long, at long, v array<double>"
    parts = fit.select(F.col("y").cast("long"), "x").mapInArrow(run, kinds).withColumn("part", F.pmod("at", F.lit(n_parts)))
    got = parts.groupBy("part").applyInArrow(lambda key, part: merged(key, part.drop_columns(["part"])), kinds).toArrow()
    y, at = got["y"].to_numpy(), got["at"].to_numpy()
    v = got["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, 1 + m + m * m)
    sides = (np.flatnonzero(y == side)[np.argsort(at[y == side])] for side in (1, 0))
    return tuple((v[i, 0], v[i, 1 : m + 1], v[i, m + 1 :].reshape(-1, m, m)) for i in sides)


def preferred(fit: DataFrame, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Weights of the scaled features: least mean logistic loss over all pairs of a row of label 1 and a row of label 0, with PULL / 2 times their squares.

    Newton steps, of which each takes one pass over the rows (y, x). Rows of a label whose scores lie in one range of WIDTH are compared
    together, by the range's mean score and its second moments, so every pair counts and the work grows with the rows, not with the pairs.
    """
    m = len(mean)
    n_parts = fit.sparkSession.sparkContext.defaultParallelism
    best, loss, step = np.zeros(m), np.inf, np.zeros(m)
    for _ in range(PASSES):
        weights = best + step
        (n, x, xx), (k, y, yy) = _by_score(fit, mean, scale, weights, n_parts)
        s, t = x @ weights / n, y @ weights / k
        x_off, y_off = xx @ weights - s[:, None] * x, yy @ weights - t[:, None] * y  # sums of the features times the score's distance from the mean
        s_var, t_var = x_off @ weights / n, y_off @ weights / k
        value, gradient, bend = 0.0, np.zeros(m), np.zeros((m, m))
        for a in range(0, len(n), 256):
            part = slice(a, a + 256)
            apart = s[part, None] - t[None, :]
            p = 1 / (1 + np.exp(np.clip(apart, -500, 500)))
            q = p * (1 - p)
            var = s_var[part, None] + t_var[None, :]
            value += float(n[part] @ (np.logaddexp(0, -apart) + q * var / 2) @ k)
            slope = p + q * (1 - 2 * p) * var / 2
            gradient += (slope.T @ n[part]) @ y - (slope @ k) @ x[part] + (q.T @ n[part]) @ y_off + (q @ k) @ x_off[part]
            mixed = x[part].T @ q @ y
            bend += np.tensordot(q @ k, xx[part], 1) + np.tensordot(q.T @ n[part], yy, 1) - mixed - mixed.T
        pairs = n.sum() * k.sum()
        value = value / pairs + PULL / 2 * float(weights @ weights)
        if value > loss + 1e-6:  # too far
            step = step / 2
            continue
        best, loss = weights, value
        down = -(gradient / pairs + PULL * weights)
        step = np.linalg.solve(bend / pairs + PULL * np.eye(m), down)
        if down @ step < 1e-8:
            return best + step
    return best


def ranked(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of `docs` with score (0 to 1) and predicted (1 from AT_THRESHOLD on).

    learn: a condition on doc_id for the labelled rows that are learned from, all of them. Each row of label 1 is preferred
    to each row of label 0; logistic loss on the differences of their features, over all of these pairs, gives the weights
    of a document's score (`preferred`). The threshold is the quantile of the learned rows' scores
    at their share of label 0. Null and empty texts have all features 0 and get that score; null labels are not used,
    rows that repeat a label count again, repeated documents get equal scores and rows without an id are scored but not
    learned from; a kept column named score or predicted gives way to the result; with labels of one kind only, or none, every score is 0.5.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    kept = [c for c in keep if c not in ("score", "predicted")]
    names = [f"k{i}" for i in range(len(kept))]
    source = docs.select(*(plain(c).alias(k) for c, k in zip(kept, names)), plain(doc_id).alias("__id"), plain(text).alias("__text"))
    known = labels.select(plain(doc_id).alias("__id"), plain(label).alias("y"), learn.alias("use")).where("use and y in (0, 1)").select("__id", "y")
    known = scratch.table(known.withColumn("h", F.xxhash64("__id")))
    bits = spark.sparkContext.broadcast(key_filter(known, "h"))
    labelled = features(source.select(F.xxhash64("__id").alias("h"), "__id", "__text"), ["h", "__id"], "__text", "x", bits)
    fit = scratch.table(labelled.select("__id", "x").join(known.select("__id", "y"), "__id"))
    x = features(source, names, "__text", "__x")
    stats = fit.agg(F.count("*").alias("n"), F.sum("y").alias("good"), *(F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(len(FEATURES))), *(F.stddev_pop(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(len(FEATURES)))).first()
    good, bad = int(stats["good"] or 0), int(stats["n"] - (stats["good"] or 0))
    if not good or not bad:
        return x.select(*(F.col(k).alias(c) for c, k in zip(kept, names)), F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    mean = np.array([stats[f"m{i}"] for i in range(len(FEATURES))])
    scale = np.array([stats[f"s{i}"] if stats[f"s{i}"] > 1e-9 else 1.0 for i in range(len(FEATURES))])

    weights = preferred(fit, mean, scale) / scale

    def weighted(column: str) -> Column:
        return sum((F.get(column, F.lit(i)) * F.lit(float(w)) for i, w in enumerate(weights)), F.lit(float(-(weights * mean).sum())))

    s = fit.select(weighted("x").alias("s"), F.when(F.col("y") == 1, weighted("x")).alias("of_good"))
    shares = [min(1.0, bad / (good + bad) * f) for f in (0.98, 1.0, 1.02)]
    at = {r["column"]: r["q"] for r in quantiles(s, ["s", "of_good"], [*shares, 0.5], steps=Steps(spark, "quality")).collect()}
    low, cut, high, middle = *at["s"][:3], at["of_good"][3]
    threshold = (low + high) / 2 if high > low else cut
    logit = lambda p: float(np.log(p / (1 - p)))
    slope = (logit(AT_MEDIAN) - logit(AT_THRESHOLD)) / max(middle - threshold, 1e-6)
    score = 1 / (1 + F.exp(-F.greatest(F.least((weighted("__x") - threshold) * slope + logit(AT_THRESHOLD), F.lit(30.0)), F.lit(-30.0))))
    return x.select(*(F.col(k).alias(c) for c, k in zip(kept, names)), score.alias("score"), (score >= AT_THRESHOLD).cast("int").alias("predicted"))
