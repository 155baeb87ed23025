"""Pieces of SQL text for generated formulas.

A model's formula has a few hundred terms. Written as text it reaches the JVM in one call and is
parsed there; built from `Column` objects each term would cost several calls.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping


def name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def number(value: float) -> str:
    return f"({float(value)!r}D)"


def lookup(subject: str, values: Mapping[str, float]) -> str:
    """Number of the text value that `subject` equals; null for any other.

    The map is a constant of the plan and the generated code for it is one short loop, where a CASE
    with as many branches would push the stage's method past the size the JIT compiles.
    """
    pairs = ", ".join(f"{text(v)}, {number(x)}" for v, x in values.items())
    return f"try_element_at(map({pairs}), {subject})"


def all_present(columns: Iterable[str]) -> str:
    """Whether every column has a value."""
    return " AND ".join(f"{name(c)} IS NOT NULL" for c in columns) or "true"
