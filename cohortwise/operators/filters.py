"""Row filters (F1-F8). Each is a plain predicate, so Catalyst pushes it to the scan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..fixed_values import GEO_FEATURE_PREFIXES, MIN_PATIENTS
from ..functions import ieq


def all_of(tests: Iterable[Column]) -> Column:
    """Conjunction; true when there is no test."""
    return reduce(lambda left, right: left & right, tests, F.lit(True))


def not_null(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Rows in which every one of the columns has a value."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    return df.where(all_of(F.col(name).isNotNull() for name in columns)) if columns else df


def scorable(df: DataFrame, inputs: Sequence[str]) -> DataFrame:
    """Rows without a null in the model inputs."""
    return df.dropna(subset=list(inputs))


def having_min(df: DataFrame, min_rows: int | None = MIN_PATIENTS, count: str = "n_patients") -> DataFrame:
    """Groups with at least `min_rows` rows; all groups for None or 0."""
    return df.where(F.col(count) >= min_rows) if min_rows else df


def match_profile(
    df: DataFrame, sex: str | None = None, age: int | None = None, status: int | None = None
) -> DataFrame:
    """Rows like one person: same sex, same ten-year age group, same stratum; None switches off."""
    tests = []
    if sex is not None:
        tests.append(F.col("sex") == F.lit(sex))
    if age is not None:
        start = age // 10 * 10
        tests.append(F.col("age").between(start, start + 9))
    if status is not None:
        tests.append(F.col("socioeconomic_status") == F.lit(status))
    return df.where(all_of(tests)) if tests else df


def optional_eq(df: DataFrame, column: str, value: str | None = None) -> DataFrame:
    """Case-insensitive equality filter that is off for None or an empty value."""
    return df.where(ieq(F.col(column), value)) if value else df


def exclude_prefixes(
    df: DataFrame, prefixes: Sequence[str] = GEO_FEATURE_PREFIXES, column: str = "feature"
) -> DataFrame:
    """Rows whose name starts with none of the prefixes."""
    return df.where(all_of(~F.col(column).startswith(prefix) for prefix in prefixes))


def min_value(df: DataFrame, column: str, threshold: float | None = None) -> DataFrame:
    """Rows at or above the threshold; None or 0 switches off."""
    return df.where(F.col(column) >= threshold) if threshold else df


def has_date(df: DataFrame, column: str = "diagnosis_date") -> DataFrame:
    """Rows with a parsed date."""
    return df.where(F.col(column).isNotNull())
