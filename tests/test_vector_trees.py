"""Ward trees of vectors against those of the table of all their distances."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trajecta.operators import clustering, joins
from trajecta.plans import catalog


def rows_of(df):
    return sorted((x["a"], x["b"], round(x["height"], 6), x["size"]) for x in df.collect())


def edges(df):
    squares = F.aggregate(F.zip_with("v", "v2", lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, x: s + x)
    return joins.all_pairs(df, "id").select(F.col("id").alias("id1"), F.col("id2"), F.sqrt(squares).alias("d"))


@pytest.mark.parametrize("kind", ["long", "string"])
def test_tree_of_vectors(spark, kind):
    r = random.Random(5)
    key = int if kind == "long" else "{:03}".format
    given = [(key(i), [r.randrange(-900, 900) for _ in range(5)]) for i in range(150)]
    given += [(key(150 + i), given[i % 3][1]) for i in range(14)]  # copies of three of them
    df = spark.createDataFrame([*given, (None, [0] * 5), (key(990), None), (key(991), [0, 0, None, 0, 0])], f"id {kind}, v array<long>")
    want = rows_of(clustering.linkage(edges(spark.createDataFrame(given, df.schema))))
    for ending in (5000, 120):
        assert rows_of(clustering.vector_linkage(df, "id", "v", ending)) == want


def test_small_trees_of_vectors(spark):
    df = spark.createDataFrame([(2, [0, 0]), (7, [3, 4])], "id int, v array<long>")
    assert [tuple(x) for x in clustering.vector_linkage(df, "id", "v").collect()] == [(2, 7, 5.0, 2)]
    assert clustering.vector_linkage(df.limit(1), "id", "v").count() == 0 and clustering.vector_linkage(df.where("id > 9"), "id", "v").count() == 0


@pytest.mark.parametrize("name", ["q_ward", "q_ward_tree"])
def test_no_table_of_pairs(spark, tmp_path, monkeypatch, name):
    """Of 300 vectors there are 44,850 pairs; no table that is kept between the steps has more rows than vectors."""
    r = random.Random(6)
    spark.createDataFrame([(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(300)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    kept, table = [], clustering.Steps.table

    def counted(self, df):
        back = table(self, df)
        kept.append(back.count())
        return back

    monkeypatch.setattr(clustering.Steps, "table", counted)
    monkeypatch.setattr(clustering, "LEAST", 100)
    assert catalog.QUERIES[name](spark, str(tmp_path)).count() in (299, 300)
    assert max(kept) <= 300
