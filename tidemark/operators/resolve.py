"""The core operator: from an operation log to one row per key, the newest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import OPS

COLUMNS = OPS.names


def _newest() -> list[Column]:
    """Aggregates for the winner of a key. A struct keeps the winner's null value, which a bare max_by would, too, but other engines not."""
    return [F.max_by(F.struct("value", "is_delete"), "seq").alias("winner"), F.max("seq").alias("seq")]


def _flat(df: DataFrame) -> DataFrame:
    return df.select("key", F.col("winner.value").alias("value"), F.col("winner.is_delete").alias("is_delete"), "seq")


def resolve(ops: DataFrame, keep_tombstones: bool = False) -> DataFrame:
    """One row per key: the operation of highest seq. A deleted key has none unless tombstones are kept.

    The maximum is combined before the shuffle, so a key with many versions sends one row per task. Filters on the
    key pass below; filters on values or deletes must stay above, where the caller puts them.
    """
    rows = _flat(ops.groupBy("key").agg(*_newest()))
    return rows if keep_tombstones else live(rows)


def live(resolved: DataFrame) -> DataFrame:
    """key, value of what is not deleted."""
    return resolved.where(~F.col("is_delete")).select("key", "value")


def merge(runs: list[DataFrame], keep_tombstones: bool) -> DataFrame:
    """Runs to one run in key order, with a single shuffle: rows are ranged by key, and the aggregate reuses that.

    For runs, which have each key once; for raw logs, with keys of any frequency, resolve first.
    """
    rows = reduce(DataFrame.unionByName, [r.select(*COLUMNS) for r in runs]).repartitionByRange("key")
    merged = _flat(rows.groupBy("key").agg(*_newest()))
    return (merged if keep_tombstones else merged.where(~F.col("is_delete"))).sortWithinPartitions("key")


def versions(ops: DataFrame, n: int) -> DataFrame:
    """The n newest operations of each key, by rank; the limit runs before and after the shuffle."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("seq")))
    return ops.withColumn("version", rank).where(F.col("version") <= n)


def valid_prefix(log: DataFrame, segment: str = "segment", position: str = "position", valid: str = "valid") -> DataFrame:
    """Of each segment the records before its first invalid one. The first bad position is a minimum, so no segment is sorted."""
    bad = log.where(~F.col(valid)).groupBy(segment).agg(F.min(position).alias("_bad"))
    return log.join(bad, segment, "left").where(F.col("_bad").isNull() | (F.col(position) < F.col("_bad"))).drop("_bad")
