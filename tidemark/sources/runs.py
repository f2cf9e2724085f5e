"""Sorted runs: immutable Parquet folders, ranged and sorted by key, with bloom filters and checksums."""

from __future__ import annotations

import math
import os
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.manifest import Run
from tidemark.schema import OPS

#: Hadoop settings of every read and write; without the check flipped bits can pass as data.
CHECKS = {"parquet.page.write-checksum.enabled": "true", "parquet.page.verify-checksum.enabled": "true"}


def write_options(row_group_bytes: int, page_bytes: int, bloom_bits: int, keys: int | None = None) -> dict[str, str]:
    """Options of the Parquet writer. bloom_bits per key give the filter's error rate, 0 leaves it out.

    Where the number of keys isn't known the filter adapts to it; else it would take a megabyte a file.
    """
    out = {"parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), **CHECKS}
    if bloom_bits > 0:
        out |= {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.fpp#key": f"{max(1e-6, math.exp(-bloom_bits * math.log(2) ** 2)):.7f}"} | ({"parquet.bloom.filter.expected.ndv#key": str(keys)} if keys else {"parquet.bloom.filter.adaptive.enabled": "true"})
    return out


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


def listing(spark: SparkSession, path: str) -> list[str]:
    fs, at = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, at = _hadoop(spark, path)
    return fs.getFileStatus(at).isDirectory()


def bytes_of(spark: SparkSession, path: str) -> int:
    """Of the Parquet files."""
    fs, at = _hadoop(spark, path)
    return sum(s.getLen() for s in fs.listStatus(at) if s.getPath().getName().endswith(".parquet"))


def _force(path: str) -> None:
    """On a local file system: files and folder to disk. Elsewhere a closed file is as durable as the store makes it."""
    local = path.removeprefix("file://") if path.startswith("file://") else path if path.startswith("/") else None
    if not local or not os.path.isdir(local):
        return
    for name in [*os.listdir(local), ""]:
        fd = os.open(os.path.join(local, name), os.O_RDONLY)
        try:
            os.fsync(fd)
        finally:
            os.close(fd)


def write_run(rows: DataFrame, path: str, run_id: int, options: dict[str, str], sync: bool) -> Run | None:
    """Write rows (one per key, ranged and sorted by key) as a run; None, and nothing left, if there are none."""
    spark, seen = rows.sparkSession, Observation()
    counted = rows.select(*OPS.names).observe(seen, F.count(F.lit(1)).alias("n"), F.hex(F.min("key")).alias("low"), F.hex(F.max("key")).alias("high"))
    counted.write.options(**options).parquet(path)
    got = seen.get
    if got["n"] == 0:
        delete(spark, path)
        return None
    if sync:
        _force(path)
    return Run(run_id, path, bytes_of(spark, path), got["n"], got["low"], got["high"])


def read_runs(spark: SparkSession, runs: list[Run]) -> DataFrame:
    """All versions in the runs, in one scan; the files are fixed now, so later commits don't show."""
    if not runs:
        return spark.createDataFrame([], OPS)
    return spark.read.schema(OPS).options(**CHECKS).parquet(*[r.path for r in runs])


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
