"""Month keys, labels, recurrence frequencies and month arithmetic."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Occurrences per month for each payment frequency; an unknown
# frequency counts once per month, an absent one is monthly.
OCCURRENCES_PER_MONTH = [
    ("weekly", 52 / 12),
    ("biweekly", 26 / 12),
    ("monthly", 1.0),
    ("quarterly", 1 / 3),
    ("yearly", 1 / 12),
]

# Average gap in days -> frequency (upper bounds, inclusive).
GAP_LIMITS = [
    (10, "weekly"),
    (17, "biweekly"),
    (35, "monthly"),
    (100, "quarterly"),
]
GAP_DEFAULT = "yearly"


def month_key(d: Column) -> Column:
    """``YYYY-MM`` month key."""
    return F.date_format(d, "yyyy-MM")


def month_label(d: Column) -> Column:
    """``March 2024`` month label."""
    return F.date_format(d, "MMMM yyyy")


def per_month(frequency: Column) -> Column:
    """Frequency text -> occurrences per month (double)."""
    f = F.lower(F.coalesce(frequency, F.lit("monthly")))
    expr = None
    for name, k in OCCURRENCES_PER_MONTH:
        expr = F.when(f == name, F.lit(k)) if expr is None else expr.when(f == name, F.lit(k))
    return expr.otherwise(F.lit(1.0))


def frequency_from_gap(avg_gap: Column) -> Column:
    """Average gap between consecutive dates -> frequency; NULL gap -> monthly."""
    expr = F.when(avg_gap.isNull(), F.lit("monthly"))
    for limit, name in GAP_LIMITS:
        expr = expr.when(avg_gap <= limit, F.lit(name))
    return expr.otherwise(F.lit(GAP_DEFAULT))


def months_since(first_month: Column, as_of: _dt.date) -> Column:
    """Calendar months from ``YYYY-MM`` to ``as_of``'s month, inclusive, >= 1."""
    y = F.substring(first_month, 1, 4).cast("int")
    m = F.substring(first_month, 6, 2).cast("int")
    now = as_of.year * 12 + as_of.month
    return F.greatest(F.lit(1), F.lit(now) - (y * 12 + m) + 1)


def date_literal(day) -> Column:
    """A date of any year as a literal (the binding renders years before 1000 without zeros)."""
    return F.lit(day.isoformat()).cast("date")


def as_date(value) -> _dt.date | None:
    """Accept ``date``/``datetime``/``'YYYY-MM-DD'``; ``None``/'' stay None."""
    if value is None or value == "":
        return None
    if isinstance(value, _dt.datetime):
        return value.date()
    if isinstance(value, _dt.date):
        return value
    return _dt.date.fromisoformat(str(value))
