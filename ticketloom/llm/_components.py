"""Connected components by alternating large-star and small-star steps, written after each pair of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ticketloom.llm._store import discard, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): each node's larger (large) or smaller neighbours are tied to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    x = both.join(least, "u").withColumn("m", F.least("m", "u"))
    if large:
        out = x.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = x.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (u long, v long) to (node, root): the least node reachable, for every node with an edge.

    A hub's edges are spread by the join's skew splitting; sums and minima are combined before each shuffle.
    """
    now = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    # Stars are done: no node is both a leaf and a centre.
    while not now.select("u").join(now.select(F.col("v").alias("u")), "u", "left_semi").isEmpty() or not now.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        before, now = now, materialise(_star(_star(now, True), False), "edges")
        discard(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
