"""Connected components of edges: alternating large-star and small-star steps, each written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node goes to the node's least neighbour, or to the node itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below it go to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    return edges.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("u", F.col("low").alias("v"))).filter("u > v")


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component) of every node of the edges (u, v) that is not the least of its component, which names it. Nodes order by their type; an
    edge of a node with itself says nothing. Ends when a round changes no edge."""
    high, low = F.greatest("u", "v"), F.least("u", "v")
    edges = written(edges.select(high.alias("u"), low.alias("v")).filter("u > v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        edges = written(_small_star(_large_star(edges)).distinct(), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
