"""Connected components by alternating star steps, all of it in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewgraph.llm.store import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select("a", F.least("a", "least").alias("least"))
    return (both.join(least, "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("least").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and itself, move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = (down.join(least, "a").where(F.col("b") != F.col("least"))
             .select(F.col("b").alias("a"), F.col("least").alias("b")))
    return moved.unionByName(least.withColumnRenamed("least", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component, its smallest reachable node, for all nodes of edges (a, b).

    Each round is written to the shared folder; the number of rounds grows with the logarithm of
    the nodes. Pairs of a node with itself are left out.
    """
    now = stored(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        told = now.agg(F.count(F.lit(1)).alias("n"),
                       F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if told == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = told
        now = stored(_small_star(_large_star(now)))
