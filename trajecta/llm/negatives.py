"""Hard negatives of anchors by exact integer scores, with several candidates packed in one wide integer.

Components are integers. A candidate's components are raised by a bias so that none is negative, and those of several
candidates stand in separate fields of one number, each field wide enough for a whole inner product. One product with an
anchor's (raised) component then serves all of them, and the sums are unpacked and freed of the bias without an error.
The wide integer is one of the 53 bits that a double holds exactly, so the sums of products are matrix products; where
one inner product doesn't fit, 64-bit integers with one field and no bias are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trajecta.llm.scratch import Scratch, plain

#: Anchors, and candidates, that meet in one group; anchors whose scores a task holds at a time.
ANCHORS, CANDIDATES, HELD = 16_384, 8_192, 256
#: Bits of the wide integers: of a double, and of a 64-bit integer.
EXACT, WIDEST = 53, 63
_NONE = np.iinfo(np.int64).min


class Packed:
    """Candidates' vectors (rows of integers within low..high, at most `most` of them) as wide integers, ready for `scores`."""

    def __init__(self, v: np.ndarray, low: int, high: int):
        self.low, self.size, self.n = low, v.shape[1], len(v)
        self.bits = max(1, (self.size * (high - low) ** 2).bit_length())
        self.kind = np.float64
        if self.bits > EXACT:  # one field, without a bias
            self.low, self.bits, self.kind = 0, WIDEST, np.int64
        if self.size * max(-low, high) ** 2 >= 1 << WIDEST:
            raise ValueError(f"components from {low} to {high} in {self.size} dimensions: their products don't fit in 64 bits")
        self.fields = max(1, EXACT // self.bits)
        self.sums = v.sum(axis=1)
        raised = np.zeros((-(-self.n // self.fields) * self.fields, self.size), dtype=np.int64)
        raised[: self.n] = v - self.low
        wide = np.zeros((len(raised) // self.fields, self.size), dtype=np.int64)
        for f in range(self.fields):
            wide += raised[f :: self.fields] << (self.bits * f)
        self.wide = wide.astype(self.kind)

    def scores(self, a: np.ndarray) -> np.ndarray:
        """(anchors, candidates): the inner products of the rows of `a` with all candidates."""
        product = ((a - self.low).astype(self.kind) @ self.wide.T).astype(np.int64)
        out = np.empty((len(a), product.shape[1] * self.fields), dtype=np.int64)
        for f in range(self.fields):
            out[:, f :: self.fields] = (product >> (self.bits * f)) & ((1 << self.bits) - 1) if self.kind is np.float64 else product
        out = out[:, : self.n]
        out += self.low * (a.sum(axis=1)[:, None] + self.sums[None, :]) - self.size * self.low**2
        return out


def firsts(scores: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, score) of the k largest entries of each row, of equal ones the leftmost; _NONE is no entry. `scores` is used up."""
    for _ in range(min(k, scores.shape[1])):
        at = scores.argmax(axis=1)
        rows = np.arange(len(scores))
        best = scores[rows, at]
        there = np.flatnonzero(best != _NONE)
        if not len(there):
            return
        yield there, at[there], best[there]
        scores[rows, at] = _NONE


def _quantized(batches: Iterator[pa.RecordBatch], scale: float) -> Iterator[pa.RecordBatch]:
    """(id, label, v, low, high, size, anchor) of the (id, label, vector, anchor) rows that take part; v: floor(scale * x) as 32-bit integers."""
    for batch in batches:
        vectors = batch.column(2)
        size = np.diff(vectors.offsets.to_numpy())
        x = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component is nan here
        owner = np.repeat(np.arange(len(size)), size)
        fine = np.bincount(owner, ~np.isfinite(x), minlength=len(size)) == 0
        whole = np.floor(scale * np.where(fine[owner], x, 0.0))
        if np.abs(whole).max(initial=0) >= 2**31:
            raise ValueError("a component times the scale doesn't fit in 32 bits")
        fine, ends = np.flatnonzero(fine), np.cumsum(size)
        rows = [whole[ends[i] - size[i] : ends[i]].astype(np.int32) for i in fine]
        kept = [batch.column(i).take(pa.array(fine)) for i in (0, 1, 3)]
        least, most = (pa.array(np.array([f(r, initial=0) for r in rows], dtype=np.int64)) for f in (np.min, np.max))
        yield pa.RecordBatch.from_arrays([*kept[:2], pa.array([r.tobytes() for r in rows], pa.binary()), least, most, pa.array(size[fine].astype(np.int64)), kept[2]], names=["id", "label", "v", "low", "high", "size", "anchor"])


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    out = np.zeros((len(column), size), dtype=np.int64)
    for i, b in enumerate(column.to_pylist()):
        v = np.frombuffer(b, dtype=np.int32)
        out[i, : len(v)] = v
    return out


def hard_negatives(
    rows: DataFrame, anchors: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", n_positives: int = 5, n_negatives: int = 3, percents: tuple[int, int] = (50, 95), scale: float = 256.0
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows where `anchors` holds.

    A component x counts as floor(scale * x). Scores are integer inner products with the anchor; higher ones come first, ties by the
    smaller id. Positives are an anchor's first `n_positives` other rows of its label; for each of them come the first `n_negatives` rows of
    another label with percents[0] % to percents[1] % of its score, so a positive of a negative score has none.

    Rows with a null id, label or vector, or with a component that is null or not finite, take no part. Labels are integers. A shorter vector
    is as if zeros followed; an empty one scores 0. Rows that repeat id, label and vector are one row; other rows that share an id
    are rows of their own, and of equal scores and ids the one of the smaller hash comes first. A component of 2^31 or more, or ranges whose
    inner products don't fit in 64 bits, are an error. An empty table gives an empty result.

    Anchors and candidates are dealt to blocks of bounded size and each pair of blocks meets in one task, first for positives, then
    for negatives between bounds that are known by then; tasks give on only each anchor's first rows.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "negatives")
    source = rows.where(plain(vec_id).isNotNull() & plain(label).isNotNull() & plain(vector).isNotNull()).select(plain(vec_id).cast("long").alias("id"), plain(label).cast("long").alias("label"), plain(vector).alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    whole = source.select("id", "label", "v", "anchor").mapInArrow(lambda batches: _quantized(batches, scale), "id long, label long, v binary, low long, high long, size long, anchor boolean")
    table = scratch.table(whole.groupBy("id", "label", "v").agg(F.max("anchor").alias("anchor"), F.first("low").alias("low"), F.first("high").alias("high"), F.first("size").alias("size")).withColumn("key", F.xxhash64("id", "label", "v")))
    n, n_anchors, low, high, size = table.agg(F.count("*"), F.count_if("anchor"), F.coalesce(F.min("low"), F.lit(0)), F.coalesce(F.max("high"), F.lit(0)), F.coalesce(F.max("size"), F.lit(0))).first()
    a_blocks, c_blocks = -(-n_anchors // ANCHORS) or 1, -(-n // CANDIDATES) or 1
    size = max(size, 1)

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return df.withColumn(own, F.pmod("key", F.lit(n_own))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))))

    candidates = dealt(table.select("id", "label", "v", "key"), "c", c_blocks, "a", a_blocks).groupBy("a", "c")

    def met(asked: DataFrame, run, schema: str) -> DataFrame:
        return dealt(asked, "a", a_blocks, "c", c_blocks).groupBy("a", "c").cogroup(candidates).applyInArrow(run, schema)

    def sides(left: pa.Table, right: pa.Table) -> tuple:
        right = right.sort_by([("id", "ascending"), ("key", "ascending")])
        return left["key"].to_numpy(), left["label"].to_numpy(), _matrix(left["v"], size), right["id"].to_numpy(), right["key"].to_numpy(), right["label"].to_numpy(), _matrix(right["v"], size)

    def positives(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            a_key, a_label, a, c_id, c_key, c_label, c = sides(left, right)
            for which in np.intersect1d(a_label, c_label):
                mine, theirs = np.flatnonzero(a_label == which), np.flatnonzero(c_label == which)
                packed = Packed(c[theirs], low, high)
                for i in range(0, len(mine), HELD):
                    some = mine[i : i + HELD]
                    s = packed.scores(a[some])
                    s[a_key[some][:, None] == c_key[theirs][None, :]] = _NONE
                    for r, k, best in firsts(s, n_positives):
                        found.append((a_key[some[r]], c_id[theirs[k]], c_key[theirs[k]], best))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 4
        return pa.table(dict(zip(("key", "positive_id", "p_key", "positive_score"), columns)))

    def negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            a_key, a_label, a, c_id, c_key, c_label, c = sides(left, right)
            bounds = np.full((2, n_positives, len(a)), 0, dtype=np.int64)
            bounds[0] = 1  # none
            for i, listed in enumerate(left["scores"].to_pylist()):
                for j, p in enumerate(listed):
                    bounds[:, j, i] = -((-percents[0] * p) // 100), (percents[1] * p) // 100
            packed = Packed(c, low, high)
            for i in range(0, len(a), HELD):
                s = packed.scores(a[i : i + HELD])
                s[a_label[i : i + HELD][:, None] == c_label[None, :]] = _NONE
                for j in range(n_positives):
                    least, most = (b[j, i : i + HELD][:, None] for b in bounds)
                    if (least <= most).any():
                        for r, k, best in firsts(np.where((s >= least) & (s <= most), s, _NONE), n_negatives):
                            found.append((a_key[i + r], np.full(len(r), j), c_id[k], c_key[k], best))
        columns = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 5
        return pa.table(dict(zip(("key", "place", "negative_id", "n_key", "negative_score"), columns)))

    asked = table.where("anchor").select("id", "label", "v", "key")
    first = met(asked, positives, "key long, positive_id long, p_key long, positive_score long")
    listed = F.sort_array(F.collect_list(F.struct((-F.col("positive_score")).alias("s"), "positive_id", "p_key")))  # of n_positives at most
    best = _cut(first, ["key"], "positive_score", "positive_id", "p_key", n_positives)
    with_positives = scratch.table(asked.join(best.groupBy("key").agg(listed.alias("p")), "key").withColumn("scores", F.transform("p", lambda x: -x["s"])))
    second = met(with_positives.select("id", "label", "v", "key", "scores"), negatives, "key long, place long, negative_id long, n_key long, negative_score long")
    chosen = _cut(second, ["key", "place"], "negative_score", "negative_id", "n_key", n_negatives)
    out = chosen.join(with_positives.select("key", F.col("id").alias("anchor_id"), "p"), "key").withColumn("positive", F.get("p", F.col("place").cast("int")))
    return out.select("anchor_id", F.col("positive.positive_id").alias("positive_id"), "rank", "negative_id", (-F.col("positive.s")).alias("positive_score"), "negative_score")


def _cut(df: DataFrame, keys: list[str], score: str, item: str, tie: str, k: int) -> DataFrame:
    """The first k rows of each key by score, then item, then tie, with their rank from 1."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.col(score).desc(), item, tie))).where(F.col("rank") <= k)
