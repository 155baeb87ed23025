"""Interval binning as generated `CASE` expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def _sorted_edges(edges: Sequence[float]) -> list[float]:
    ordered = sorted(edges)
    if len(ordered) < 2:
        raise ValueError("at least two bin edges are needed")
    if len(set(ordered)) != len(ordered):
        raise ValueError(f"bin edges must be unique: {ordered}")
    return ordered


def _edge_text(edge: float) -> str:
    return str(int(edge)) if float(edge).is_integer() else str(edge)


def range_labels(edges: Sequence[float], unit: str = "") -> list[str]:
    """`low-high` labels; whole numbers are written without a decimal part."""
    ordered = _sorted_edges(edges)
    return [f"{_edge_text(a)}-{_edge_text(b)}{unit}" for a, b in zip(ordered, ordered[1:])]


def bin_conditions(
    col: Column, edges: Sequence[float], right: bool = True, include_lowest: bool = False
) -> list[Column]:
    """One membership test per interval, in edge order.

    `right=True` gives `(a, b]`, and `[a, b]` for the first interval with `include_lowest`;
    `right=False` gives `[a, b)`. NaN sorts above every number in Spark, so it fits no interval.
    """
    ordered = [F.lit(float(e)) for e in _sorted_edges(edges)]
    tests = []
    for i, (low, high) in enumerate(zip(ordered, ordered[1:])):
        if not right:
            tests.append((col >= low) & (col < high))
        elif i == 0 and include_lowest:
            tests.append((col >= low) & (col <= high))
        else:
            tests.append((col > low) & (col <= high))
    return tests


def cut(
    col: Column,
    edges: Sequence[float],
    labels: Sequence | None = None,
    right: bool = True,
    include_lowest: bool = False,
) -> Column:
    """Label of the interval that holds the value; null outside all of them.

    Without `labels` the 0-based interval number is given.
    """
    tests = bin_conditions(col, edges, right, include_lowest)
    labels = list(range(len(tests))) if labels is None else list(labels)
    if len(labels) != len(tests):
        raise ValueError(f"{len(tests)} intervals need as many labels, got {len(labels)}")
    out = F.when(tests[0], F.lit(labels[0]))
    for test, label in zip(tests[1:], labels[1:]):
        out = out.when(test, F.lit(label))
    return out


def digitize(col: Column, edges: Sequence[float]) -> Column:
    """Number of edges at or below the value, 0..n; null for null and NaN."""
    total = F.lit(0)
    for edge in _sorted_edges(edges):
        total = total + (col >= F.lit(float(edge))).cast("int")
    return F.when(~F.isnan(col), total)


def decade_bin(age: Column) -> Column:
    """First year of the ten-year age group."""
    return (F.floor(age / F.lit(10)) * F.lit(10)).cast("int")
