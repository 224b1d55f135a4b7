"""Filtered search, listing/paging and point statistics over a ledger.

Filters are plain Column predicates, so Catalyst pushes them into the
Parquet scan (``PushedFilters``); on a ledger partitioned by ``month`` the
date bounds also become ``PartitionFilters``.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import as_date, date_literal
from ..functions.text import safe_pattern

DATE = "transaction_date"


def date_bounds(df: DataFrame, start=None, end=None) -> list[Column]:
    """Inclusive date bounds; adds ``month`` bounds when the ledger has that
    partition column (Spark does not derive them from the date filter)."""
    start, end = as_date(start), as_date(end)
    conds = []
    has_month = "month" in df.columns
    if start:
        conds.append(F.col(DATE) >= date_literal(start))
        if has_month:
            conds.append(F.col("month") >= F.lit(start.isoformat()[:7]))
    if end:
        conds.append(F.col(DATE) <= date_literal(end))
        if has_month:
            conds.append(F.col("month") <= F.lit(end.isoformat()[:7]))
    return conds


def ledger_month(df: DataFrame) -> Column:
    """``YYYY-MM`` of each row: the stored ledger's ``month`` partition column
    when present (free: constant per file), else computed from the date."""
    from ..functions.calendar import month_key
    return F.col("month") if "month" in df.columns else month_key(F.col(DATE))


def date_range(df: DataFrame, start=None, end=None) -> DataFrame:
    conds = date_bounds(df, start, end)
    return df.filter(reduce(lambda a, b: a & b, conds)) if conds else df


def text_match(text: str) -> Column:
    """``description ILIKE %text% OR notes ILIKE %text%`` (``%``/``_`` are wildcards)."""
    pattern = safe_pattern(F.lit(f"%{text}%"))
    return F.ilike(F.col("description"), pattern) | F.ilike(F.col("notes"), pattern)


def exact(bound) -> Column:
    """A bound as the decimal that its text names, not rounded to cents."""
    return F.lit(Decimal(format(Decimal(str(bound)), "f")))


def search(df: DataFrame, *, text=None, start=None, end=None, category=None, source=None,
           min_amount=None, max_amount=None, ordered: bool = False) -> DataFrame:
    """All set filters ANDed; empty strings mean "no filter", 0 is a valid bound."""
    conds = []
    if text:
        conds.append(text_match(text))
    conds += date_bounds(df, start or None, end or None)
    if category:
        conds.append(F.col("category") == F.lit(category))
    if source:
        conds.append(F.col("source") == F.lit(source))
    if min_amount is not None:
        conds.append(F.col("amount") >= exact(min_amount))
    if max_amount is not None:
        conds.append(F.col("amount") <= exact(max_amount))
    out = df.filter(reduce(lambda a, b: a & b, conds, F.lit(True)))
    return out.orderBy(F.col(DATE).desc(), F.col("id").desc()) if ordered else out


def search_total(df: DataFrame, keys: list[str] | None = None, **filters) -> DataFrame:
    """Sum of the amounts found by ``search`` (0 when nothing matches)."""
    found = search(df, **filters)
    aggs = [F.coalesce(F.sum("amount"), F.lit(0).cast("decimal(12,2)")).cast("double")
            .alias("total"), F.count(F.lit(1)).alias("matches")]
    return found.groupBy(*keys).agg(*aggs) if keys else found.agg(*aggs)


def _newest_first(df: DataFrame) -> DataFrame:
    return df.orderBy(F.col(DATE).desc(), F.col("id").desc())


def list_page(df: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Newest first; ``limit`` 0/None returns every row and ignores ``offset``.

    With a limit the plan is a top-(offset+limit) (``TakeOrderedAndProject``),
    not a full sort.
    """
    out = _newest_first(df)
    if limit:
        if offset:
            out = out.offset(int(offset))
        out = out.limit(int(limit))
    return out


def page(df: DataFrame, number: int, size: int = 50) -> DataFrame:
    """Page ``number`` (1-based) of ``size`` rows, newest first, with
    ``has_next`` = the page is full (the browser's rule). The window runs over
    the page only (at most ``size`` rows)."""
    from pyspark.sql import Window
    rows = list_page(df, size, (max(number, 1) - 1) * size)
    return rows.withColumn("has_next", F.count(F.lit(1)).over(Window.partitionBy()) == size)


def list_after(df: DataFrame, date, id_: int, limit: int) -> DataFrame:
    """Keyset page: the ``limit`` rows after ``(date, id)`` in newest-first order."""
    d = F.lit(as_date(date))
    after = (F.col(DATE) < d) | ((F.col(DATE) == d) & (F.col("id") < F.lit(id_)))
    return _newest_first(df.filter(after)).limit(int(limit))


def recent(df: DataFrame, n: int = 20) -> DataFrame:
    return list_page(df, n)


def transaction_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("transaction_count"))


def latest_date(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    agg = F.max(DATE).alias("latest_date")
    return df.groupBy(*keys).agg(agg) if keys else df.agg(agg)


def latest_balance(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Balance of the newest row (ties: highest id), per key.

    ``max_by`` is a partial aggregate: one row per key crosses the shuffle. Date and
    id are packed into one decimal, so that its buffer is of fixed width and the
    aggregate hashes instead of sorting.
    Without keys an empty ledger gives 0, as the reference does; a newest row
    with a NULL balance gives NULL.
    """
    newest = _packed_order(F.col(DATE), F.col("id"))
    bal = F.max_by(F.col("balance"), newest).cast("double")
    day = F.max_by(F.col(DATE), newest).alias("as_of_date")
    if keys:
        return df.groupBy(*keys).agg(bal.alias("balance"), day)
    return df.agg(F.when(F.count(F.lit(1)) == 0, F.lit(0.0)).otherwise(bal).alias("balance"), day)


def _packed_order(day: Column, id_: Column) -> Column:
    """Orders like (day, id), nulls before all values, as a decimal of 38 digits: 20 for an id of any
    64-bit value, the rest for the days."""
    span = F.lit(Decimal(10**20))
    days = F.coalesce(F.unix_date(day), F.lit(-(1 << 31))).cast("decimal(11,0)")
    number = F.coalesce(id_.cast("decimal(20,0)"), F.lit(Decimal(-(1 << 63) - 1)))
    return (days.cast("decimal(17,0)") * span + number).cast("decimal(38,0)")


def distinct_values(df: DataFrame, column: str, ordered: bool = True,
                    drop_empty: bool = True) -> DataFrame:
    """Distinct non-NULL (and, as the API does, non-empty) values of one column."""
    c = F.col(column)
    cond = c.isNotNull() & (c != "") if drop_empty else c.isNotNull()
    out = df.select(c.alias(column)).filter(cond).distinct()
    return out.orderBy(column) if ordered else out
