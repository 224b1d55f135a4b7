"""Pages at any depth, newest first, without sorting what lies before them (O1, O2).

``list_page`` with an offset is a top-(offset + limit): at half of a large ledger that is half of
it in one task. Here the place of the page is found by counts first:

1. rows a month, then rows a day of the page's first and last month (from ``day_counts``, which may
   be stored beside the ledger and costs a read of its few rows then);
2. where the first day alone holds many rows before the page, counts of ever narrower ranges of its
   ids, 1,024 at a time.

The page is then a small top-k over one contiguous range of (date, id). On a ledger partitioned by
``month`` the range prunes partitions. Every step is exact, ties and nulls included: null dates come
last, and in a day null ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import date_literal
from ..session import stored
from .query import DATE, ledger_month, list_page

WAYS = 10           # bits of an id that one round of counts settles


def day_counts(df: DataFrame) -> DataFrame:
    """(month, transaction_date, n): the row-count index, one row a day."""
    return df.groupBy(ledger_month(df).alias("month"), F.col(DATE)).agg(F.count(F.lit(1)).alias("n"))


def _newest_first(rows: list[tuple]) -> list[tuple]:
    """(value, n) pairs, values descending, null last."""
    return (sorted((r for r in rows if r[0] is not None), reverse=True)
            + [r for r in rows if r[0] is None])


def _at(rows: list[tuple], place: int) -> tuple[object, int] | None:
    """(value, rows before it) of the pair that holds the 0-based ``place``."""
    before = 0
    for value, n in rows:
        if place < before + n:
            return value, before
        before += n
    return None


def _days(index: DataFrame, month) -> list[tuple]:
    """The days of one month (31 rows at most, and one for null dates)."""
    rows = index.filter(F.col("month").eqNullSafe(F.lit(month))).groupBy(DATE).agg(
        F.sum("n").alias("n")).collect()
    return _newest_first([(r[DATE], r.n) for r in rows])


def _from_place(df: DataFrame, skip: int, near: int) -> tuple[Column | None, int]:
    """Of the rows of one day: a condition that leaves out rows before the place ``skip`` in
    descending id order, and how many rows are still to be skipped (``near`` at most, unless one id
    has more)."""
    edge = df.agg(F.min("id"), F.max("id"), F.count("id")).first()
    low, high, n = edge
    if n <= skip:                                   # the page begins among null ids
        return F.col("id").isNull(), skip - n
    bits = max(0, (high - low).bit_length() - WAYS)
    while skip > near:
        part = F.col("id").bitwiseAND(F.lit(-(1 << bits)).cast("long"))
        rows = (df.filter(F.col("id").between(low, high)).groupBy(part.alias("part"))
                .agg(F.count(F.lit(1)).alias("n")).collect())       # about 2**WAYS rows
        start, before = _at(_newest_first([(r.part, r.n) for r in rows]), skip)
        skip -= before
        low, high = max(low, start), min(high, start + (1 << bits) - 1)
        if not bits:
            break
        bits = max(0, bits - WAYS)
    return F.col("id").isNull() | (F.col("id") <= F.lit(high)), skip


def _between(df: DataFrame, newest, oldest) -> Column:
    """Rows from the day ``newest`` down to ``oldest``; a null day stands after all others."""
    day, month = F.col(DATE), ledger_month(df)
    if newest is None:
        return day.isNull() & month.isNull()
    out = (day <= date_literal(newest)) & (month <= F.lit(newest.isoformat()[:7]))
    if oldest is None:
        return out | day.isNull()
    return out & (day >= date_literal(oldest)) & (month >= F.lit(oldest.isoformat()[:7]))


def page_at(df: DataFrame, limit: int, offset: int = 0, index: DataFrame | None = None,
            near: int = 10_000) -> DataFrame:
    """The rows that ``list_page(df, limit, offset)`` gives, in its order.

    ``index`` is a stored ``day_counts`` of the same rows (else it is counted now). At most ``near``
    rows are skipped by the final top-k, unless more share one id."""
    if not limit or offset <= near:
        return list_page(df, limit, offset)
    index = day_counts(df) if index is None else index
    months = index.groupBy("month").agg(F.sum("n").alias("n")).collect()   # a row a calendar month
    order = _newest_first([(r.month, r.n) for r in months])
    total = sum(n for _, n in order)
    first = _at(order, offset)
    if first is None:
        return df.limit(0)
    end = min(offset + limit, total) - 1
    last = _at(order, end)
    days = _days(index, first[0])
    newest, before = _at(days, offset - first[1])
    oldest, _ = _at(days if last[0] == first[0] else _days(index, last[0]), end - last[1])
    rows = df.filter(_between(df, newest, oldest))
    skip = offset - first[1] - before
    if skip > near and isinstance(df.schema["id"].dataType, T.IntegralType):
        day = F.col(DATE).isNull() if newest is None else F.col(DATE).eqNullSafe(date_literal(newest))
        keep, skip = _from_place(df.filter(_between(df, newest, newest)), skip, near)
        rows = rows.filter(~day | keep)
    return list_page(rows, limit, skip)


def numbered(ordered: DataFrame, column: str = "place") -> DataFrame:
    """Rows of an ordered frame with their 1-based place. The rows are written once; places are
    those in a task's output after the counts of the tasks before it (a row a task)."""
    rows = stored(ordered.withColumn("__rid", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__rid", 33)
    counts = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1)
    first = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__first"))
    place = F.col("__first") + F.col("__rid").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (rows.withColumn("__part", part).join(first, "__part")
            .withColumn(column, place).drop("__part", "__first", "__rid"))
