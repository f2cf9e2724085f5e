"""Bloom filters as tables: built by one aggregation, probed by one join, with no bit array on the driver.

Parquet's own filters serve the reads of runs; these serve filters across tables and figures on error rates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    bits: int
    probes: int


def shape(n: int, bits_per_key: int) -> Shape | None:
    """Size and number of probes for n keys; None where 0 or fewer bits per key turn the filter off."""
    if bits_per_key <= 0:
        return None
    bits = max(64, n * bits_per_key)
    return Shape((bits + 63) // 64 * 64, min(30, max(1, round(bits_per_key * math.log(2)))))


def probes(key: Column, s: Shape) -> Column:
    """The bits of a key, by double hashing."""
    a, b = F.xxhash64(key), F.xxhash64(key, F.lit(1)).bitwiseOR(F.lit(1))
    at = lambda i: F.pmod(F.pmod(a, F.lit(s.bits)) + i * F.pmod(b, F.lit(s.bits)), F.lit(s.bits))  # noqa: E731  reduced first, so nothing overflows
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(s.probes - 1).cast("long")), at)


def _mask() -> Column:
    """The bit of column `bit` within its word."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("bit", F.lit(64)).cast("int"))


def build(keys: DataFrame, s: Shape, key: str = "key") -> DataFrame:
    """(word, bits): the words of the filter that have a bit set; or-ed before the shuffle."""
    each = keys.select(F.explode(probes(F.col(key), s)).alias("bit"))
    return each.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(_mask()).alias("bits"))


def maybe_present(candidates: DataFrame, filter_: DataFrame, s: Shape, key: str = "key") -> DataFrame:
    """Distinct candidate keys that the filter does not rule out; no key that was built in is ever ruled out."""
    each = candidates.select(key).distinct().select(key, F.explode(probes(F.col(key), s)).alias("bit")).withColumn("word", F.shiftright("bit", 6))
    hit = each.join(filter_, "word", "left").withColumn("hit", F.coalesce(F.col("bits").bitwiseAND(_mask()) != 0, F.lit(False)))
    return hit.groupBy(key).agg(F.bool_and("hit").alias("all_set")).where("all_set").select(key)
