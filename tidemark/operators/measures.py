"""Figures on logs and resolved tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an entry costs in memory besides its bytes.
ENTRY_OVERHEAD = 64


def row_bytes() -> Column:
    return F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))


def memtable_bytes(resolved: DataFrame) -> DataFrame:
    """Bytes that the newest versions take in memory, tombstones with them."""
    return resolved.agg(F.coalesce(F.sum((row_bytes() + ENTRY_OVERHEAD).cast("long")), F.lit(0)).alias("memtable_bytes"))


def write_stats(ops: DataFrame) -> DataFrame:
    return ops.agg(F.count("*").alias("writes"), F.count_if("is_delete").alias("deletes"), F.count_if(~F.col("is_delete")).alias("puts"), F.count_distinct("key").alias("keys"))


def space_amplification(ops: DataFrame, live: DataFrame) -> DataFrame:
    """Bytes of all versions, bytes of live rows, and their ratio (null without live rows)."""
    stored = ops.agg(F.coalesce(F.sum(row_bytes().cast("long")), F.lit(0)).alias("stored_bytes"))
    needed = live.agg(F.coalesce(F.sum(row_bytes().cast("long")), F.lit(0)).alias("live_bytes"))
    ratio = F.when(F.col("live_bytes") > 0, F.round(F.col("stored_bytes") / F.col("live_bytes"), 6))
    return stored.join(needed).select("stored_bytes", "live_bytes", ratio.alias("space_amp"))


def nearest_rank(df: DataFrame, column: str, ranks: dict[str, float]) -> DataFrame:
    """Exact percentiles that are values of the column, e.g. {"p50": 0.5}."""
    return df.agg(*[F.expr(f"percentile_disc({p}) within group (order by {column})").alias(name) for name, p in ranks.items()])
