"""Recurring-payment detection with an inferred frequency (R1).

The reference sorts each group's dates and averages consecutive gaps. That
sum telescopes: sum(d[i+1] - d[i]) = max - min, so the average gap is
``datediff(max, min) / (n - 1)``. The whole operator is therefore a single
partial-aggregatable ``groupBy`` (count, sum, min and max date): no window,
no sort and no collected lists, whatever the size of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import frequency_from_gap


def analyze_recurring(df: DataFrame, min_occurrences: int = 3,
                      keys: list[str] | None = None, ordered: bool = False) -> DataFrame:
    """Per direction (``deposit`` for amount > 0, else ``withdrawal``) and exact
    description: average amount (absolute for withdrawals), frequency and the
    number of occurrences, for groups with at least ``min_occurrences`` rows."""
    keys = keys or []
    amt = F.col("amount")
    direction = F.when(amt > 0, F.lit("deposit")).otherwise(F.lit("withdrawal"))
    signed = F.when(amt > 0, amt).otherwise(F.abs(amt))
    g = df.select(*keys, "description", "transaction_date", direction.alias("direction"),
                  signed.alias("value")).groupBy(*keys, "direction", "description").agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.sum("value").alias("total"),
        F.min("transaction_date").alias("first_date"),
        F.max("transaction_date").alias("last_date"),
    )
    return with_frequency(g, min_occurrences, keys, ordered)


def with_frequency(g: DataFrame, min_occurrences: int, keys: list[str],
                   ordered: bool = False) -> DataFrame:
    """Amount and frequency of groups (keys, direction, description) that have ``occurrences``,
    ``total``, ``first_date`` and ``last_date``."""
    n = F.col("occurrences")
    g = g.filter(n >= F.lit(min_occurrences))
    gap = F.when(n > 1, F.datediff("last_date", "first_date") / (n - 1))
    out = g.select(
        *keys, "direction", "description",
        (F.col("total").cast("double") / n).alias("amount"),
        frequency_from_gap(gap).alias("frequency"),
        gap.alias("avg_days_between"),
        "occurrences",
    )
    return out.orderBy(*keys, "direction", F.desc("amount"), "description") if ordered else out
