"""Exact order statistics and percentiles with bounded memory.

Spark's `percentile` keeps a map of every distinct value of a group in one task, which fails for
billions of continuous measurements. Here the wanted ranks are narrowed instead: each pass counts
the rows of every open interval in `BINS` equal-width bins (a partial and a final hash aggregate
over a few thousand groups), keeps the bin that holds the rank, and goes on inside it. The bin's
own minimum and maximum become the next interval, so a bin with one distinct value is finished at
once. Ten billion rows of distinct values need three or four scans; no row leaves the executors
except the last few thousand candidates of a rank.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BINS = 1024
# Intervals with at most this many rows are read out, sorted inside one array per rank.
READ_OUT_ROWS = 5_000


@dataclass
class _Rank:
    """The `rank`-th smallest value (from 0) among the rows of `test`, known to lie in [low, high]."""

    group: object
    column: str
    rank: int
    low: float
    high: float
    rows: int
    value: float | None = None

    @property
    def settled(self) -> bool:
        return self.low == self.high

    @property
    def interval(self):
        return (self.group, self.column, self.low, self.high)


def _finite(col: Column) -> Column:
    value = col.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(math.inf)), value)


def _extent(df: DataFrame, columns: Mapping[str, Column], by: Column | None) -> dict:
    """Count, minimum and maximum per group and column."""
    measures = []
    for i, col in enumerate(columns.values()):
        value = _finite(col)
        measures += [
            F.count(value).alias(f"n{i}"), F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}"),
        ]
    grouped = df.groupBy(by.alias("_group")) if by is not None else df.groupBy(F.lit(0).alias("_group"))
    out = {}
    for row in grouped.agg(*measures).collect():
        if row["_group"] is None:
            continue
        for i, name in enumerate(columns):
            out[row["_group"], name] = (row[f"n{i}"], row[f"lo{i}"], row[f"hi{i}"])
    return out


def _inside(columns: Mapping[str, Column], by: Column | None, interval) -> tuple[Column, Column]:
    group, name, low, high = interval
    value = _finite(columns[name])
    test = value.between(F.lit(low), F.lit(high))
    if by is not None:
        test = test & (by == F.lit(group))
    return value, test


def _narrow(df: DataFrame, columns, by, ranks: list[_Rank]) -> None:
    """One pass: moves every rank into the bin that holds it."""
    intervals = sorted({r.interval for r in ranks}, key=repr)
    hits = []
    for i, interval in enumerate(intervals):
        value, test = _inside(columns, by, interval)
        # The highest value has its own number BINS + 1; it goes to the last bin.
        number = F.least(
            F.width_bucket(value, F.lit(interval[2]), F.lit(interval[3]), F.lit(BINS)),
            F.lit(BINS).cast("long"),
        )
        hits.append(F.when(test, F.struct(F.lit(i).alias("at"), number.alias("bin"), value.alias("x"))))
    counted = (
        df.select(F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("hit.*")
        .groupBy("at", "bin").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    )
    bins: dict[int, list] = {}
    for row in counted.collect():
        bins.setdefault(row["at"], []).append(row)
    for rank in ranks:
        below = 0
        for row in sorted(bins[intervals.index(rank.interval)], key=lambda r: r["bin"]):
            if rank.rank < below + row["n"]:
                rank.rank -= below
                rank.low, rank.high, rank.rows = row["lo"], row["hi"], row["n"]
                break
            below += row["n"]


def _read_out(df: DataFrame, columns, by, ranks: list[_Rank]) -> None:
    """One pass: reads the few candidates of every rank and picks it."""
    intervals = sorted({r.interval for r in ranks}, key=repr)
    picks = []
    for i, interval in enumerate(intervals):
        value, test = _inside(columns, by, interval)
        wanted = sorted({r.rank for r in ranks if r.interval == interval})
        ordered = F.sort_array(F.collect_list(F.when(test, value)))
        picks.append(F.array(*[F.get(ordered, F.lit(k)) for k in wanted]).alias(f"v{i}"))
    row = df.agg(*picks).collect()[0]
    for rank in ranks:
        i = intervals.index(rank.interval)
        wanted = sorted({r.rank for r in ranks if r.interval == rank.interval})
        rank.value = row[f"v{i}"][wanted.index(rank.rank)]


def _solve(df: DataFrame, columns, by, ranks: list[_Rank], read_out_rows: int) -> None:
    while True:
        open_ranks = [r for r in ranks if not r.settled and r.rows > read_out_rows]
        if not open_ranks:
            break
        _narrow(df, columns, by, open_ranks)
    waiting = []
    for rank in ranks:
        if rank.settled:
            rank.value = rank.low
        else:
            waiting.append(rank)
    if waiting:
        _read_out(df, columns, by, waiting)


def extents(df: DataFrame, column: Column, by: Column) -> dict[object, tuple[int, float, float]]:
    """(count, minimum, maximum) of the finite values per group of `by`, in one aggregate."""
    return {group: found for (group, _), found in _extent(df, {"x": column}, by).items()}


def order_statistics(
    df: DataFrame,
    column: Column,
    by: Column,
    wanted: Mapping[object, Sequence[int]],
    read_out_rows: int = READ_OUT_ROWS,
    known: Mapping[object, tuple[int, float, float]] | None = None,
) -> dict[object, dict[int, float]]:
    """For every group of `by`, the values at the wanted 0-based ranks; runs jobs.

    `by` must take few values (strata, bins): the open intervals are held on the driver. `known` are
    the groups' `extents`, where the caller has them.
    """
    columns = {"x": column}
    extent = _extent(df, columns, by) if known is None else {(g, "x"): v for g, v in known.items()}
    ranks = {}
    for group, positions in wanted.items():
        n, low, high = extent.get((group, "x"), (0, None, None))
        for position in positions:
            if not 0 <= position < n:
                raise ValueError(f"group {group!r} has {n} values, no rank {position}")
            ranks[group, position] = _Rank(group, "x", position, low, high, n)
    _solve(df, columns, by, list(ranks.values()), read_out_rows)
    out: dict[object, dict[int, float]] = {}
    for (group, position), rank in ranks.items():
        out.setdefault(group, {})[position] = rank.value
    return out


def exact_percentiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    probabilities: Sequence[float],
    by: Column | None = None,
    read_out_rows: int = READ_OUT_ROWS,
    known: Mapping[tuple[object, str], tuple[int, float, float]] | None = None,
) -> dict[tuple[object, str], list[float | None]]:
    """Linear-interpolated percentiles of each column, per group of `by` if given; runs jobs.

    Keys of the result are (group, column name), with group 0 when there is no `by`; null, NaN and
    infinite values are left out. `by` must take few values. `known` has the (count, minimum,
    maximum) of every key, where the caller has them.
    """
    extent = _extent(df, columns, by) if known is None else known
    probabilities = [float(p) for p in probabilities]
    out: dict[tuple[object, str], list[float | None]] = {
        key: [None] * len(probabilities) for key, (n, _, _) in extent.items() if n == 0
    }
    if by is None:
        for name in columns:
            out.setdefault((0, name), [None] * len(probabilities))
    filled = {key: value for key, value in extent.items() if value[0] > 0}
    ranks: dict[tuple, _Rank] = {}
    for (group, name), (n, low, high) in filled.items():
        for p in probabilities:
            position = p * (n - 1)
            for k in {math.floor(position), math.ceil(position)}:
                ranks[group, name, k] = _Rank(group, name, k, low, high, n)
    _solve(df, columns, by, list(ranks.values()), read_out_rows)
    for (group, name), (n, _, _) in filled.items():
        values = []
        for p in probabilities:
            position = p * (n - 1)
            low = ranks[group, name, math.floor(position)].value
            high = ranks[group, name, math.ceil(position)].value
            values.append(low + (high - low) * (position - math.floor(position)))
        out[group, name] = values
    return out
