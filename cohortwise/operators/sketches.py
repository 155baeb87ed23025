"""Quantile sketches kept per part and merged without the rows (E3, sketch option).

The exact percentiles of `quantiles` read the rows several times. A sketch is made in one pass with partial
aggregation, is a few kilobytes whatever the number of rows, and sketches of any grouping of the rows (by
day, by cohort) merge to a sketch of all of them. Its ranks are off by at most `rank_error(k)` with a
confidence of 99 %.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

K = 2048


def rank_error(k: int = K) -> float:
    """The sketch's error of a rank, as a share of the rows; a fixed property of the sketch."""
    return 2.296 / k**0.9021


def sketches(df: DataFrame, columns: Mapping[str, Column] | Sequence[str], by: Sequence[str], k: int = K) -> DataFrame:
    """One row per part: its keys, and per column the finite values' sketch and number.

    A part without a value has a null sketch. Null keys are a part of their own.
    """
    if not isinstance(columns, Mapping):
        columns = {c: F.col(c) for c in columns}
    measures = []
    for name, col in columns.items():
        value = col.cast("double")
        finite = F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)
        n = F.count(finite)
        measures += [n.alias(f"n_{name}"), F.when(n > 0, F.kll_sketch_agg_double(finite, F.lit(k))).alias(f"sketch_{name}")]
    return df.groupBy(*by).agg(*measures)


def merged(parts: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Sketches of finer parts merged per `by`; with no `by` to a single row."""
    measures = []
    for c in columns:
        n = F.sum(f"n_{c}")
        measures += [F.coalesce(n, F.lit(0)).alias(f"n_{c}"), F.when(n > 0, F.kll_merge_agg_double(f"sketch_{c}")).alias(f"sketch_{c}")]
    return parts.groupBy(*by).agg(*measures)


def percentiles(parts: DataFrame, column: str, probabilities: Sequence[float]) -> Column:
    """The column's values at the probabilities, as an array; null without a value."""
    sketch = F.col(f"sketch_{column}")
    values = [F.kll_sketch_get_quantile_double(sketch, F.lit(float(p))) for p in probabilities]
    return F.when(sketch.isNotNull(), F.array(*values))


def robust_scale_from(parts: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(median, interquartile range) per column from kept sketches, as `robust_scale_fit` gives from rows;
    a zero range is replaced by 1."""
    whole = merged(parts, columns, [])
    row = whole.select(*[percentiles(whole, c, (0.25, 0.5, 0.75)).alias(c) for c in columns]).collect()[0]
    empty = [c for c in columns if row[c] is None]
    if empty:
        raise ValueError(f"columns without a single value: {', '.join(empty)}")
    return {c: (row[c][1], (row[c][2] - row[c][0]) or 1.0) for c in columns}
