"""Connected components of an edge table, by alternating star steps in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlure.llm.tables import drop_kept, keep


def _pointed(edges: DataFrame) -> DataFrame:
    """Edges with the larger end first, without loops and repeats."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _pointed(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return _pointed(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node that is not the least of its component, with that least node.

    ``edges`` has a and b (long). Each round is written to the shared folder; the rounds
    grow with the logarithm of the longest path. Only a count and a hash sum reach the driver.
    """
    current, before = keep(_pointed(edges), "edges"), None
    while True:
        state = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or state == before:
            return current
        before = state
        following = keep(_small_star(_large_star(current)), "edges")
        drop_kept(current)
        current = following
