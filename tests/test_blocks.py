"""Pairs by blocks against the same pairs by joins and loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_twins import same_as_sql
from trajecta.functions import sequences
from trajecta.operators import blocks, clustering
from trajecta.plans import catalog

BY = {"braycurtis": sequences.bray_curtis, "euclidean": sequences.norm_euclidean, "cityblock": sequences.norm_cityblock}


def odd_rows(n, keys=int, seed=0):
    """Arrays of one size, and some that are shorter, empty, null, all zeros, have a null or are equal; some labels and a key are null."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        v = [r.choice([0.0, 1.0, 2.5, 0.1 * r.randrange(40)]) for _ in range(6)]
        v = {3: None, 5: [], 7: v[:4], 11: [0.0] * 6, 13: [1.0, None, 2.0, 0.0, 0.0, 1.0], 17: [1.0] * 6}.get(i % 41, v)
        out.append((keys(i), v, None if i % 29 == 0 else r.randrange(4)))
    return out + [(None, [1.0] * 6, 1)]


@pytest.mark.parametrize("how,keys,rows", [("cityblock", int, 40), ("braycurtis", str, 200), ("euclidean", lambda i: i // 2, 300)])
def test_distances_of_blocks(spark, how, keys, rows):
    given = odd_rows(400, keys)
    df = spark.createDataFrame(given, f"k {'string' if keys is str else 'long'}, v array<double>, l int")
    d = F.when((F.size("a.v") > 0) & (F.size("b.v") > 0), BY[how](F.col("a.v"), F.col("b.v")))
    want = df.alias("a").join(df.alias("b"), F.col("a.k") < F.col("b.k")).select("a.k", "b.k", d)
    plain = lambda df: sorted((tuple(x) for x in df.collect()), key=lambda x: (x[0], x[1], -1 if x[2] is None else x[2]))
    assert plain(blocks.pair_distances(df, "k", "v", how, rows=rows)) == plain(want)


def test_sums_by_label(spark):
    df = spark.createDataFrame(odd_rows(500), "k long, v array<double>, l int")
    edges = clustering.both_ways(blocks.pair_distances(df, "k", "v", "cityblock"), "key", "key2")
    want = clustering.label_sums(edges, df.select(F.col("k").alias("id"), F.col("l").alias("label")))
    by = lambda df: {(x["id"], x["label"], x["other"]): (None if x["total"] is None else round(x["total"], 9), x["n"]) for x in df.collect()}
    assert by(blocks.label_sums(df, "k", "v", "l", "cityblock", rows=200)) == by(want)


def test_moments(spark):
    df = spark.createDataFrame(odd_rows(400), "k long, v array<double>, l int")
    d = [x["d"] for x in blocks.pair_distances(df, "k", "v", "cityblock").where("d is not null").collect()]
    n, mean, variance = blocks.moments(df, "k", "v", "cityblock", rows=150)
    assert n == len(d) and math.isclose(mean, np.mean(d)) and math.isclose(variance, np.var(d))
    assert blocks.merged([(0, 0.0, 0.0)]) == (0, 0.0, 0.0)


def test_rounding():
    assert blocks.rounded(np.array([0.000005, 0.00000499, 1.5, np.inf, np.nan, 0.0]), 5).tolist()[:4] == [1e-5, 0.0, 1.5, np.inf]


@pytest.mark.parametrize("name", ["q_braycurtis", "q_euclid", "q_cityblock", "q_intra_inter", "q_silhouette", "q_medoid", "q_similarity"])
def test_no_pair_is_a_row_of_a_join(spark, tmp_path, name):
    r = random.Random(2)
    given = [(i, [r.uniform(-1, 1) for _ in range(64)], r.randrange(5)) for i in range(90)]
    same_as_sql(spark, tmp_path, name, embeddings=(given, "vec_id long, embedding array<float>, label int"))
    plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan


def test_shared_ids_have_all_their_labels(spark, tmp_path):
    r = random.Random(3)
    given = [(i // 2 if i < 20 else i, [r.uniform(-1, 1) for _ in range(64)], r.randrange(3)) for i in range(60)]
    same_as_sql(spark, tmp_path, "q_intra_inter", embeddings=(given, "vec_id long, embedding array<float>, label int"))
