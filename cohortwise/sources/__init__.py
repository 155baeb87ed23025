"""Readers, schema checks, sinks and the model store."""

from .readers import (
    lowercase_columns, read_municipalities, read_patients, read_table, require_columns,
    with_defaults,
)
from .sinks import read_importances, write_importances

__all__ = [
    "lowercase_columns", "read_importances", "read_municipalities", "read_patients",
    "read_table", "require_columns", "with_defaults", "write_importances",
]
