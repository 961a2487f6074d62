"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girderlake.llm.store import cut


def _toward_least(edges: DataFrame, small: bool) -> DataFrame:
    """large star: every larger neighbour of a node to its least neighbour; small star: every smaller one, and itself."""
    both = edges if small else edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
    met = both.join(least.repartition("a"), "a")  # a stage of its own, so that a node with very many neighbours can be split
    if small:  # a > b in every edge
        return met.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b"))).where("a > b").distinct()
    return met.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a > b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): for every node of the edges (a, b) the least node that it is connected with.

    Each round is two shuffles of the edges, which never grow; rounds follow the logarithm of the longest path.
    Edges from a node to itself, or with a null end, say nothing.
    """
    pairs = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    state = None
    while True:
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == state or not now["n"]:
            break
        state = now
        pairs = cut(_toward_least(_toward_least(pairs, False), True))
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select("b", "b").distinct())
