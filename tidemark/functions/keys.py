"""Key codecs. Binary columns order as unsigned bytes, so a codec must keep its type's order in bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_key(column: Column, width: int = 0) -> Column:
    """UTF-8 of the column's text, filled with zeros on the left to width, so that whole numbers order as numbers."""
    text = column.cast("string")
    return F.encode(F.lpad(text, width, "0") if width else text, "UTF-8")


def long_key(column: Column) -> Column:
    """Eight bytes that order as signed 64-bit numbers do: the sign bit is flipped."""
    return F.unhex(F.lpad(F.hex(column.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"))


def long_of_key(column: Column) -> Column:
    """The number that long_key encoded."""
    high = F.conv(F.substring(F.hex(column), 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(F.hex(column), 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low).bitwiseXOR(F.lit(-(1 << 63)))


def key_text(column: Column) -> Column:
    return F.decode(column, "UTF-8")


def next_prefix(prefix: bytes) -> bytes | None:
    """The least key above every key with this prefix; None if there is none."""
    kept = prefix.rstrip(b"\xff")
    return kept[:-1] + bytes([kept[-1] + 1]) if kept else None
