"""Connected components of a graph whose edges are a table, by alternating large-star and small-star steps.

Every step is one shuffle with partial aggregation; a step's result is checkpointed, so its lineage stays short and an
executor's loss costs one step at most. Nothing but a count of changes reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, spread_join


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (larger ones if large, else smaller ones) to its least neighbour or itself."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = spread_join(both, least, ["a"])  # the neighbours of a hub may be very many
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Of edges (a, b; longs, no loops): node, label, the least node of its component. Isolated nodes aren't listed."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    size = None
    for _ in range(rounds):
        after = cut(_star(_star(now, True), False))
        state = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == size:
            break
        drop(now)
        size, now = tuple(state), after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = after.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
