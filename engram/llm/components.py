"""Connected components on an edge table, without collecting edges.

Alternating large-star and small-star steps: each round points every vertex at its least neighbour, so
the longest path shrinks geometrically and hubs end as stars. Rounds are cut by scratch tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. `edges`: (u, v). The least neighbour comes from a plain aggregate, so hubs are combined map-side."""
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, name: str, rounds: int = 40) -> DataFrame:
    """(u, v) longs -> (vertex, root): root is the least vertex that links reach. Vertices without an edge are absent.

    Empty input gives no rows; loops and repeated edges don't matter. Raises if `rounds` don't suffice.
    """
    now = scratch.keep(edges.where("u <> v").select("u", "v").distinct(), f"{name}-0")
    state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    for i in range(1, rounds + 1):
        now = scratch.keep(_star(_star(now, True), False), f"{name}-{i}")
        scratch.drop(f"{name}-{i - 1}")
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            leaves = now.select(F.col("u").alias("vertex"), F.col("v").alias("root"))
            return leaves.unionByName(now.select(F.col("v").alias("vertex"), F.col("v").alias("root")).distinct())
        state = new
    raise RuntimeError(f"components did not settle in {rounds} rounds")
