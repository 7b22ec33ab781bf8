"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node that has an edge; root is the same within a component.

    edges: (a, b), 64-bit keys that are spread at random, as hashes are. Every round hangs each node under its least
    neighbour and contracts the graph to the nodes under which others hang, so few rounds are needed; a round is
    joins and sums on keys, and only the number of edges left comes to the driver. Loops and repeats are allowed; an
    empty table gives an empty one.
    """
    left = scratch.table(edges.select("a", "b").where("a <> b").distinct())
    roots = None
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = scratch.table(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")))
        if roots is None:
            now = up.select("node", F.col("up").alias("root"))
        else:
            now = roots.join(up.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        now = scratch.table(now)
        moved = left.join(up.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        fewer = scratch.table(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        scratch.drop(left, up, *([roots] if roots is not None else []))
        left, roots = fewer, now
    if roots is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
