"""Connected components and what is built on them (labels, sizes, largest component)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import discard, materialize


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, component)`` for each endpoint of ``edges(src, dst)``; the component is its
    smallest node id. Nodes without edges do not occur; self-loops make a component of one.

    Large-star and small-star in turn: every round at least halves long chains, no node's
    neighbour list is ever gathered, and each round's edge set is written to the shared folder, the last round's deleted.
    Skewed hubs are left to adaptive skew joins, which apply as both sides are plain exchanges.
    """
    pairs = edges.select(F.col("src").cast("long").alias("u"), F.col("dst").cast("long").alias("v")).where("u is not null and v is not null")
    current = materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    mark = None
    for _ in range(max_rounds):
        both = current.where("u <> v").select("u", "v").unionByName(current.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct()
        )
        small = small.unionByName(current.where("u = v").select("u", "v"))
        before, current = current, materialize(small, "cc")
        discard(before)
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labelled = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return labelled.unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
