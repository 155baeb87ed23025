"""Column functions: every one returns a `Column` that stays inside whole-stage codegen."""

from .bins import cut, decade_bin, digitize, range_labels
from .dates import date_parts, days_since, parse_date, period_flag, quarter_label
from .labels import (
    canonical_area, canonical_sex, code_label, combo_label, ieq, risk_band, strip_prefix,
)
from .numbers import hash_normal, hash_uniform, parse_range_mean, round_to, to_numeric

__all__ = [
    "canonical_area", "canonical_sex", "code_label", "combo_label", "cut", "date_parts",
    "days_since", "decade_bin", "digitize", "hash_normal", "hash_uniform", "ieq",
    "parse_date", "parse_range_mean", "period_flag", "quarter_label", "range_labels",
    "risk_band", "round_to", "strip_prefix", "to_numeric",
]
