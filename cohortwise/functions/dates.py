"""Date columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from ..fixed_values import PANDEMIC_YEARS

_DAY_MICROS = 86_400_000_000


# Besides ISO: year first with slashes, month first, and month names; the first that fits counts.
DATE_FORMATS = (
    "yyyy/M/d", "yyyy/M/d H:mm[:ss]", "M/d/yyyy", "M/d/yyyy H:mm[:ss]", "M-d-yyyy", "MMM d yyyy", "MMM d, yyyy",
    "MMMM d yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy",
)


def parse_date(col: Column | str, formats: Iterable[str] = ()) -> Column:
    """Text to timestamp; text that fits no format becomes null.

    Without `formats` ISO dates and timestamps are read.
    """
    text = F.col(col) if isinstance(col, str) else col
    formats = tuple(formats)
    if not formats:
        return F.try_to_timestamp(text)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def parse_any_date(col: Column | str, formats: Iterable[str] = DATE_FORMATS) -> Column:
    """ISO dates and timestamps, then the formats in order."""
    text = F.trim(F.col(col) if isinstance(col, str) else col)
    return F.coalesce(parse_date(text), *[parse_date(text, (f,)) for f in formats])


def quarter_label(date: Column) -> Column:
    """`T1`..`T4`; null for a null date."""
    return F.concat(F.lit("T"), F.quarter(date).cast("string"))


def days_since(date: Column, as_of: str | dt.date | dt.datetime | None = None) -> Column:
    """Whole elapsed days from `date` to `as_of` (today when left out), rounded down."""
    end = F.current_date() if as_of is None else F.lit(as_of)
    elapsed = F.unix_micros(end.cast("timestamp")) - F.unix_micros(date.cast("timestamp"))
    return F.floor(elapsed / F.lit(_DAY_MICROS)).cast("int")


def period_flag(year: Column, years: Iterable[int] = PANDEMIC_YEARS) -> Column:
    """1 when the year is one of `years`, else 0; also 0 for a null year."""
    return F.coalesce(year.isin(list(years)), F.lit(False)).cast("int")


def date_parts(date: Column, as_of=None) -> dict[str, Column]:
    """The columns derived from a diagnosis date, by name."""
    return {
        "diagnosis_year": F.year(date),
        "diagnosis_month": F.month(date),
        "diagnosis_trimester": quarter_label(date),
        "days_since_diagnosis": days_since(date, as_of),
        "pandemic_period": period_flag(F.year(date)),
    }
