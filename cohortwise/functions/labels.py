"""Text labels and text matching."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, functions as F

from ..fixed_values import (
    DIABETES_LABELS, RISK_BAND_EDGES, RISK_BAND_LABELS, SMOKER_LABELS,
)


def risk_band(
    score: Column,
    edges: Sequence[float] = RISK_BAND_EDGES,
    labels: Sequence[str] = RISK_BAND_LABELS,
) -> Column:
    """Band of an unrounded score, left-closed; null for null and NaN."""
    if len(labels) != len(edges) + 1:
        raise ValueError("one more label than edges is needed")
    band = F.when(score.isNull() | F.isnan(score), F.lit(None).cast("string"))
    for edge, label in zip(edges, labels):
        band = band.when(score < F.lit(edge), F.lit(label))
    return band.otherwise(F.lit(labels[-1]))


def code_label(code: Column, names: Mapping, default: str | None = None) -> Column:
    """Label of a code; `default` for a code without one, null for a null code."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(names.items())])
    label = F.try_element_at(table, code)
    if default is not None:
        label = F.coalesce(label, F.lit(default))
    return F.when(code.isNotNull(), label)


def combo_label(
    smoker: Column,
    diabetes: Column,
    smoker_labels: Sequence[str] = SMOKER_LABELS,
    diabetes_labels: Sequence[str] = DIABETES_LABELS,
) -> Column:
    """Two 0/1 flags as one label, such as `Fumador / No Diabético`."""
    def side(flag, labels):
        return F.when(flag == 1, F.lit(labels[0])).otherwise(F.lit(labels[1]))

    return F.concat_ws(" / ", side(smoker, smoker_labels), side(diabetes, diabetes_labels))


def ieq(col: Column, value: str) -> Column:
    """Case-insensitive equality that ignores outer blanks."""
    return F.upper(F.trim(col.cast("string"))) == F.lit(value.strip().upper())


def strip_prefix(col: Column, prefix: str) -> Column:
    """The text without its leading `prefix`."""
    return F.regexp_replace(col, "^" + re.escape(prefix), "")


def canonical_sex(col: Column) -> Column:
    """`masculino` and `m` to M, `femenino` and `f` to F; other text is kept."""
    text = F.upper(F.trim(col.cast("string")))
    return (
        F.when(text.isin("M", "MASCULINO"), F.lit("M"))
        .when(text.isin("F", "FEMENINO"), F.lit("F"))
        .otherwise(col.cast("string"))
    )


def canonical_area(col: Column) -> Column:
    """Area codes 0/U to U and 1/R to R; other text is kept."""
    text = F.upper(F.trim(col.cast("string")))
    return (
        F.when(text.isin("0", "0.0", "U"), F.lit("U"))
        .when(text.isin("1", "1.0", "R"), F.lit("R"))
        .otherwise(col.cast("string"))
    )
