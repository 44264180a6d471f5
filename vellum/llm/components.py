"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import join_many, release, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours (large: above it; else: not above it) are tied to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.filter("v < u")
    least = staged(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("c")), "star-least")
    tied = join_many(near, least, ["u"], "c")  # a hub may hold any share of the edges
    if large:
        out = tied.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = staged(out.filter("u <> v").dropDuplicates(["u", "v"]), "large-star" if large else "small-star")
    release(least)
    return out


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the least node reachable) for each node that an edge (u, v) names.

    Edges are undirected long pairs; self-loops and repeats are allowed, nulls are dropped.
    Each step is written to the shared folder. An empty table gives an empty result.
    """
    now = staged(edges.select("u", "v").dropna().filter("u <> v").dropDuplicates(["u", "v"]), "edges")
    told = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    was = told(now)
    nodes = now
    for _ in range(most_rounds):
        if not was[0]:
            break
        wide = _star(now, True)
        after = _star(wide, False)
        release(wide, *([now] if now is not nodes else []))
        now = after
        if (got := told(now)) == was:
            break
        was = got
    else:
        raise RuntimeError("the components did not settle")
    every = nodes.select(F.col("u").alias("node")).unionByName(nodes.select(F.col("v").alias("node"))).distinct()
    return every.join(now.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
