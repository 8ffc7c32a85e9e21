"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import settled


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) for every node of the edges (a, b), both long; root is the component's smallest node.

    Alternating large-star and small-star rounds: every step is an aggregation with partial sums and a join on the
    node, in a number of rounds that grows with the logarithm of the component size. Each round is written to the
    shared folder. Nodes without an edge don't appear.
    """
    pairs = settled(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: every larger neighbour of u goes to u's smallest neighbour.
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.where("m < u").select("u", F.col("m").alias("v")))
        large = large.where("u > v").distinct()
        # Small star: every smaller neighbour of u, and u, go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        pairs = settled(small.where("u > v").distinct(), "edges")
        # Stable when every node has one edge, to a node that has none upwards: then all sums stay as they are.
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select("v", "v").distinct())
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
