"""Joins with a dimension or with a table of aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..fixed_values import GEO_KEYS
from ..sources.readers import lowercase_columns, require_columns

# Sides up to this many rows are broadcast. Beyond it the join shuffles on its keys and AQE splits
# the partitions of hot keys.
BROADCAST_ROWS = 100_000


def join_counted(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Equi-join that broadcasts `small` only if it has at most `max_rows` rows; runs a job.

    `small` is a table of aggregates whose size Catalyst can only guess from its inputs, so it would
    plan a shuffle of `big`. Its first `max_rows + 1` rows are read: if that is all of it, those rows
    are broadcast, and it is not computed again; otherwise the plain join is left to Catalyst and
    AQE. Nothing stays behind on the executors.
    """
    rows = small.limit(max_rows + 1).toArrow()
    if rows.num_rows <= max_rows:
        small = F.broadcast(small.sparkSession.createDataFrame(rows, small.schema))
    return big.join(small, list(on), how)


def unique_municipalities(municipalities: DataFrame) -> DataFrame:
    """One row per (department, municipality).

    Of several rows with one key the one with the fewest nulls is kept, whole, and of equally
    complete ones the smallest by its other columns, so the choice does not depend on row order.
    """
    municipalities = require_columns(lowercase_columns(municipalities), GEO_KEYS)
    others = [name for name in municipalities.columns if name not in GEO_KEYS]
    if not others:
        return municipalities.distinct()
    nulls = sum((F.col(f"`{name}`").isNull().cast("int") for name in others), F.lit(0))
    return (
        municipalities.groupBy(*GEO_KEYS)
        .agg(F.min(F.struct(nulls.alias("_nulls"), *others)).alias("_row"))
        .select(*GEO_KEYS, *[F.col(f"_row.{name}").alias(name) for name in others])
    )


def duplicate_municipalities(municipalities: DataFrame) -> DataFrame:
    """Keys with more than one row, and how many."""
    return (
        lowercase_columns(municipalities).groupBy(*GEO_KEYS)
        .agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > 1)
    )


def with_geography(patients: DataFrame, municipalities: DataFrame) -> DataFrame:
    """Left join of patients with their municipality; unmatched patients stay, with nulls.

    The dimension is read from files, so Catalyst knows its size and broadcasts it below
    `spark.sql.autoBroadcastJoinThreshold`; a larger one is shuffled, with AQE splitting hot keys.
    """
    dimension = unique_municipalities(municipalities)
    clash = set(dimension.columns) & set(patients.columns) - set(GEO_KEYS)
    return patients.drop(*clash).join(dimension, list(GEO_KEYS), "left")


def with_group_total(counts: DataFrame, key: str, count: str = "n", total: str = "total") -> DataFrame:
    """Counts with the sum over all rows of the same `key`.

    Two aggregates are joined instead of a window per key: a window would sort every distinct value
    of one key in one task. `key` is a calendar year here, whose range the timestamp type bounds,
    so the totals are always small enough to broadcast.
    """
    totals = counts.groupBy(key).agg(F.sum(count).alias(total))
    return counts.join(F.broadcast(totals), key)
