"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000.0


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 as a long, of timestamps with or without a zone (sessions run in UTC)."""
    return F.unix_micros(col(ts).cast("timestamp"))


def hours(start: str | Column, end: str | Column) -> Column:
    return (micros(end) - micros(start)) / F.lit(HOUR_US)


def time_bin(ts: str | Column, bin_hours: float) -> Column:
    """Whole bins since 1970."""
    return F.floor(micros(ts) / F.lit(HOUR_US * bin_hours)).cast("long")


def cell(x: str | Column, size: float) -> Column:
    return F.floor(col(x) / F.lit(size)).cast("long")


def below(x: str | Column, limit: float) -> Column:
    """x < limit; a missing or NaN x isn't."""
    return F.coalesce(F.nanvl(col(x), F.lit(None).cast("double")) < F.lit(limit), F.lit(False))


def above(x: str | Column, limit: float) -> Column:
    return F.coalesce(F.nanvl(col(x), F.lit(None).cast("double")) > F.lit(limit), F.lit(False))


def wrapped_degrees(turn: Column) -> Column:
    """A turn in degrees, as -180 up to but not including 180 (but for rounding just below -180)."""
    x = turn + F.lit(180.0)
    return x - F.lit(360.0) * F.floor(x / F.lit(360.0)) - F.lit(180.0)


def pair_of(a: str | Column, b: str | Column) -> tuple[Column, Column]:
    return F.least(col(a), col(b)), F.greatest(col(a), col(b))


def share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def has_prefix(x: str | Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | col(x).cast("string").startswith(p)
    return out
