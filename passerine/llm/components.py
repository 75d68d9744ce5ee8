"""Connected components by alternating star contraction.

Each round links every node's larger neighbours, then its smaller ones, to the
smallest node around it.  The edge table never grows, each round is two
groupings, and lineage is cut with a reliable checkpoint after each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from .common import checkpoint, release


def _both(edges: DataFrame) -> DataFrame:
    ways = F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.explode(ways).alias("e")).select("e.u", "e.v")


def _large_star(arcs: DataFrame) -> DataFrame:
    """u's larger neighbours, linked to the smallest node around u."""
    least = arcs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    linked = arcs.join(least, "u").where("v > u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(arcs: DataFrame) -> DataFrame:
    """u and its neighbours, all smaller than u, linked to the smallest of them."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m"))
    ends = F.explode(F.array("u", "v"))
    return arcs.join(least, "u").select(ends.alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of every node in ``edges`` (u, v long).

    Loops, repeated edges and edges with a null end are ignored; no edges, no rows.
    """
    arcs = edges.select("u", "v").where("u is not null and v is not null and u <> v")
    now = checkpoint(arcs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        # all edges lead from a node to a smaller one; at the end each node has one and no target has any
        seen, old = Observation(), now
        edge_sum = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        now = checkpoint(_small_star(_large_star(_both(now))).observe(seen, F.count(F.lit(1)).alias("n"), edge_sum.alias("s")))
        new = seen.get
        release(old)
        if new == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        mark = new
