"""Numeric columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_HASH_SPAN = float(1 << 53)


def not_nan(col: Column) -> Column:
    """NaN to null, so that every aggregate skips it."""
    return F.when(~F.isnan(col), col)


def to_numeric(col: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null.

    The JVM reads `1.5f` and `2d` as numbers; a CSV reader does not, so they are kept out.
    """
    text = F.trim(col.cast("string"))
    return F.when(~text.rlike("[0-9.][dDfF]$"), not_nan(text.try_cast("double")))


def parse_range_mean(col: Column) -> Column:
    """`1000-1500` to 1250, `1200` to 1200; null when any part is not a number."""
    parts = F.transform(F.split(F.trim(col.cast("string")), "-"), to_numeric)
    total = F.aggregate(parts, F.lit(0.0), lambda left, right: left + right)
    return F.when(~F.exists(parts, lambda part: part.isNull()), total / F.size(parts))


def round_to(col: Column, digits: int) -> Column:
    """Half-up rounding; meant for the outermost projection only."""
    return F.round(col, digits)


def hash_uniform(seed: int, *cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the row's values only.

    Unlike `rand(seed)` it does not depend on the partition or on row order, so a task that is run
    again after an executor was lost gives the same number. The 53 high bits of the hash fill a
    double exactly.
    """
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") / F.lit(_HASH_SPAN)


def hash_normal(seed: int, *cols: Column | str) -> Column:
    """A standard normal number that depends on the row's values only (Box-Muller)."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - hash_uniform(seed, F.lit("radius"), *cols)))
    angle = F.lit(2.0) * F.pi() * hash_uniform(seed, F.lit("angle"), *cols)
    return radius * F.cos(angle)
