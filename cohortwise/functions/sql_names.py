"""The row functions P7-P17 as SQL functions, so that reports can be written as SQL text.

They are SQL expressions, which Spark inlines into the query; nothing runs in Python. Names carry a prefix.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..fixed_values import DIABETES_LABELS, RISK_BAND_EDGES, RISK_BAND_LABELS, SMOKER_LABELS
from .sql_text import number, text

PREFIX = "cohort_"
_NUMBER = "regexp_like(trim(p), '[0-9.][dDfF]$')"


def _risk_band() -> str:
    steps = " ".join(f"WHEN score < {number(e)} THEN {text(label)}" for e, label in zip(RISK_BAND_EDGES, RISK_BAND_LABELS))
    return f"CASE WHEN score IS NULL OR isnan(score) THEN NULL {steps} ELSE {text(RISK_BAND_LABELS[-1])} END"


def _side(flag: str, labels: tuple[str, str]) -> str:
    return f"CASE WHEN {flag} = 1 THEN {text(labels[0])} ELSE {text(labels[1])} END"


def definitions() -> dict[str, tuple[str, str, str]]:
    """Per function its parameters, its type and its SQL expression."""
    part = f"CASE WHEN {_NUMBER} THEN NULL ELSE nullif(try_cast(trim(p) AS DOUBLE), double('NaN')) END"
    parts = f"transform(split(trim(value), '-'), p -> {part})"
    return {
        "risk_band": ("score DOUBLE", "STRING", _risk_band()),
        "range_mean": ("value STRING", "DOUBLE", f"CASE WHEN NOT exists({parts}, x -> x IS NULL) THEN "
                       f"aggregate({parts}, 0D, (s, x) -> s + x) / size({parts}) END"),
        # Without the last edge and label: intervals [a, b) of sorted edges, as `cut` with right=False.
        "cut": ("value DOUBLE, edges ARRAY<DOUBLE>, labels ARRAY<STRING>", "STRING",
                "CASE WHEN value >= edges[0] AND value < edges[size(edges) - 1] THEN "
                "get(labels, size(filter(edges, e -> value >= e)) - 1) END"),
        "digitize": ("value DOUBLE, edges ARRAY<DOUBLE>", "INT", "CASE WHEN value IS NOT NULL AND NOT isnan(value) THEN size(filter(edges, e -> value >= e)) END"),
        "code_label": ("code INT, names MAP<INT, STRING>, otherwise STRING", "STRING", "CASE WHEN code IS NOT NULL THEN coalesce(try_element_at(names, code), otherwise) END"),
        "combo_label": ("smoker INT, diabetes INT", "STRING", f"concat_ws(' / ', {_side('smoker', SMOKER_LABELS)}, {_side('diabetes', DIABETES_LABELS)})"),
        "decade_bin": ("age DOUBLE", "INT", "CAST(floor(age / 10) * 10 AS INT)"),
        "ieq": ("value STRING, other STRING", "BOOLEAN", "upper(trim(value)) = upper(trim(other))"),
        "strip_prefix": ("value STRING, prefix STRING", "STRING", "CASE WHEN startswith(value, prefix) THEN substr(value, length(prefix) + 1) ELSE value END"),
        "round_to": ("value DOUBLE", "DOUBLE", "round(value, 4)"),
    }


def register_functions(spark: SparkSession, prefix: str = PREFIX) -> list[str]:
    """Defines the functions in the session, replacing those of an earlier call; their names."""
    names = []
    for name, (parameters, kind, body) in definitions().items():
        names.append(prefix + name)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
    return names
