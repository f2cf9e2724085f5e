"""Connected components of an edge table, wholly in shuffles: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint


def _least(edges: DataFrame) -> DataFrame:
    """For each node the least neighbour, itself included; a map-side minimum comes before the shuffle."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v) longs to (node, root), root the least node that is reachable; only nodes with an edge to another appear.

    Hubs are no hazard: minima are combined before shuffles and Spark splits skewed joins. Each round is
    checkpointed, so a lost executor repeats one round. Null ends are ignored; no edges give no rows.
    """
    now = checkpoint(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(most_rounds):
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if state["n"] == 0 or state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = state
        now = checkpoint(_small_star(_large_star(now)))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
