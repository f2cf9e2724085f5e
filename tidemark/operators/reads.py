"""Point, many-key and range reads over an operation log. Every key predicate is put where Parquet can prune by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.keys import next_prefix
from tidemark.operators.resolve import live, resolve


def check_key(key, what: str = "key") -> bytes:
    if not isinstance(key, (bytes, bytearray, memoryview)):
        raise TypeError(f"{what} must be bytes, not {type(key).__name__}")
    return bytes(key)


def in_range(low: bytes | None, high: bytes | None) -> Column:
    """low <= key < high; None leaves a side open. low above high is an error, equal bounds are an empty range."""
    if low is not None and high is not None and check_key(low) > check_key(high):
        raise ValueError("range starts after its end")
    out = F.lit(True)
    if low is not None:
        out = F.col("key") >= F.lit(check_key(low))
    if high is not None:
        upper = F.col("key") < F.lit(check_key(high))
        out = upper if low is None else out & upper
    return out


def get(ops: DataFrame, key: bytes) -> DataFrame:
    """The live row of a key: one or none."""
    return resolve(ops.where(F.col("key") == F.lit(check_key(key))))


def multi_get(ops: DataFrame, keys: DataFrame) -> DataFrame:
    """Live rows of the distinct keys given; the planner broadcasts the keys if they are few and shuffles both sides if not."""
    return resolve(ops.join(keys.select("key").where("key is not null").distinct(), "key", "left_semi"))


def multi_get_missing(ops: DataFrame, keys: DataFrame) -> DataFrame:
    """The distinct keys given that are not live."""
    wanted = keys.select("key").where("key is not null").distinct()
    return wanted.join(multi_get(ops, wanted).select("key"), "key", "left_anti")


def scan(ops: DataFrame, low: bytes | None = None, high: bytes | None = None, limit: int | None = None) -> DataFrame:
    """Live rows in key order, from low up to but without high."""
    rows = resolve(ops.where(in_range(low, high))).orderBy("key")
    return rows if limit is None else rows.limit(limit)


def prefix_scan(ops: DataFrame, prefix: bytes, limit: int | None = None) -> DataFrame:
    return scan(ops, prefix, next_prefix(prefix), limit)


def scan_ranges(ops: DataFrame, ranges: DataFrame, most_buckets: int = 1 << 14) -> DataFrame:
    """range_id, key, value of the live rows of many ranges at once; ranges has range_id, low and high (null: open).

    Keys are cut into stretches at lows of the ranges, as many as there are ranges up to most_buckets; a range meets the
    rows of the stretches that it reaches by an equi-join, so the work follows the rows returned. Rows outside all ranges
    go before the shuffle where the ranges' bounds tell. Ranges that begin after their end fail; empty ones have no rows.
    """
    backward = F.raise_error(F.lit("range starts after its end")).cast("binary")
    ranges = ranges.select("range_id", F.when(F.col("low") > F.col("high"), backward).otherwise(F.coalesce("low", F.lit(b""))).alias("low"), "high")
    ends = ranges.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or(F.col("high").isNull()).alias("open"), F.count("*").alias("n")).first()
    if not ends["n"]:
        return ops.sparkSession.createDataFrame([], ranges.select("range_id").schema.add("key", "binary").add("value", "binary"))
    wanted = min(most_buckets, ends["n"])
    lows = ranges.select("low").distinct().orderBy("low")
    step = max(1, ends["n"] // wanted)
    cuts = [bytes(r["low"]) for r in lows.where(F.pmod(F.xxhash64("low"), F.lit(step)) == 0).limit(2 * most_buckets).collect()]

    @F.arrow_udf("int")
    def stretch(keys):
        import bisect

        import pyarrow as pa

        return pa.array([None if k is None else bisect.bisect_right(cuts, k) for k in keys.to_pylist()], pa.int32())

    rows = live(resolve(ops.where(in_range(bytes(ends["low"]), None if ends["open"] else bytes(ends["high"]))), keep_tombstones=True))
    rows = rows.withColumn("stretch", stretch("key"))
    last = F.coalesce(stretch("high"), F.lit(len(cuts)))
    spread = ranges.select("range_id", "low", "high", F.explode(F.sequence(stretch("low"), F.greatest(stretch("low"), last))).alias("stretch"))
    met = rows.join(spread, "stretch").where((F.col("key") >= F.col("low")) & (F.col("high").isNull() | (F.col("key") < F.col("high"))))
    return met.select("range_id", "key", "value")


def snapshot(ops: DataFrame, seq: int) -> DataFrame:
    """Live rows as they were after operation seq."""
    return resolve(ops.where(F.col("seq") <= F.lit(seq)))


def compare(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows that only one side has, with their side; empty where both hold the same live rows."""
    left = expected.exceptAll(actual).withColumn("side", F.lit("expected"))
    return left.unionByName(actual.exceptAll(expected).withColumn("side", F.lit("actual")))


__all__ = ["check_key", "compare", "get", "in_range", "live", "multi_get", "multi_get_missing", "prefix_scan", "scan", "scan_ranges", "snapshot"]
