"""Casts with the wrapping and saturating arithmetic of the JVM, whatever the session's ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wrapped_int(c: str | Column) -> Column:
    """A long's low 32 bits as an int."""
    return (F.pmod(column(c).cast("long") + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")


def saturated(c: Column, low: int, high: int, kind: str) -> Column:
    d = c.cast("double")
    return F.when(F.isnan(d), F.lit(0).cast(kind)).when(d >= high, F.lit(high).cast(kind)).when(d <= low, F.lit(low).cast(kind)).otherwise(d.cast(kind))


def float_to_int(c: str | Column) -> Column:
    return saturated(column(c), -(1 << 31), (1 << 31) - 1, "int")


def float_to_long(c: str | Column) -> Column:
    return saturated(column(c), -(1 << 63), (1 << 63) - 1, "bigint")


def parsed(c: str | Column, kind: str, strict: bool = True) -> Column:
    """A number from its string; strict: bad strings fail, else they are null."""
    return column(c).cast(kind) if strict else column(c).try_cast(kind)


def as_text(c: str | Column, nested: bool = False) -> Column:
    return F.to_json(column(c)) if nested else column(c).cast("string")


def sized_bytes(c: str | Column) -> Column:
    """The bytes after a 4-byte big-endian length; null if that isn't how many there are."""
    b = column(c)
    stated = F.conv(F.hex(F.substring(b, 1, 4)), 16, 10).cast("long")
    return F.when((F.octet_length(b) >= 4) & (stated == F.octet_length(b) - 4), F.substring(b, 5, 2147483647))
