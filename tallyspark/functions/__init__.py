"""Column -> Column building blocks (all native Spark expressions)."""

from .calendar import frequency_from_gap, month_key, month_label, months_since, per_month
from .classify import categorize, extract_source
from .parse import is_na, parse_amount, parse_balance, parse_date, parse_number
from .text import contains_pattern, safe_pattern, split_words, strip_ws

__all__ = [
    "categorize", "contains_pattern", "extract_source", "frequency_from_gap", "is_na",
    "month_key", "month_label", "months_since", "parse_amount", "parse_balance",
    "parse_date", "parse_number", "per_month", "safe_pattern", "split_words", "strip_ws",
]
