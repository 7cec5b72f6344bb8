"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled, written


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index of each node's component, for links (i, j) among n nodes."""
    low = np.arange(n)
    while True:
        before = low.copy()
        least = np.minimum(low[i], low[j])
        np.minimum.at(low, i, least)
        np.minimum.at(low, j, least)
        np.minimum.at(low, before, low)
        low = low[low]
        if (low == before).all():
            return low


def _forest(batches):
    """Stars that connect what a partition's edges connect: one row at most for each node it holds."""
    import pandas as pd

    u = v = None
    for pdf in batches:
        if u is not None:
            pdf = pd.concat([pd.DataFrame({"u": u, "v": v}), pdf])
        if not len(pdf):
            continue
        both = pd.concat([pdf["u"], pdf["v"]]).to_numpy()
        nodes, at = np.unique(both, return_inverse=True)
        low = roots(len(nodes), at[: len(pdf)], at[len(pdf) :])
        leaf = np.flatnonzero(low != np.arange(len(nodes)))
        u, v = nodes[leaf], nodes[low[leaf]]
    if u is not None:
        yield pd.DataFrame({"u": u, "v": v})


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on rows (u, v) with u > v; returns such rows, distinct."""
    if large:  # every neighbour larger than u goes to u's least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that both sides of the join are plain exchanges, whose hot keys adaptive execution can split
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        out = up.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # u and its smaller neighbours go to the least of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(least, "u")
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component_id) for every node of ``edges`` (columns u, v; any order, repeats and loops allowed).

    component_id is the least node reachable. Each partition first turns its edges into a forest of stars. Each round is written to the shared folder
    and deleted once the result is. The star of a hub is aggregated on the map side, and the joins on its key are left to
    adaptive skew splitting; no group is collected.
    """
    return settled(edges.sparkSession, lambda: _rounds(edges, max_rounds), "components")


def _rounds(edges: DataFrame, max_rounds: int) -> DataFrame:
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema)
    now = written(ordered.mapInPandas(_forest, schema).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if state == before or state[0] == 0:
            break
        # a forest of stars: each node has one smaller neighbour and no centre is a leaf
        if state[0] == state[2] and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        before = state
        now = written(_star(_star(now, True), False), "edges")
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    )
