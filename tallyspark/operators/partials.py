"""Stored partial aggregates of a ledger, renewed only for the months that changed (A1-A5, R1).

Two tables lie below one folder, both partitioned by ``month``:

* ``cells``: one row per (keys, month, source, category) with counts, exact decimal sums and the
  first and last date: all that the overall, source, monthly and category statistics need;
* ``groups``: one row per (keys, month, direction, description): all that recurring descriptions
  and the inferred frequencies need.

After an import, a correction or a deletion ``refresh`` reads those months of the ledger again
(partition-pruned) and overwrites their partitions, whatever the ledger's size. Every function is
mergeable, so the answers equal those of a full scan. A date range that cuts through a month takes
whole months from the table and the rows of the two edge months from the ledger.

Each refreshed month also holds a marker row (``n`` 0), so that a month that lost its last row is
overwritten too. A refresh that dies half-way is simply run again.
"""

from __future__ import annotations

import calendar
import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import as_date
from . import recurring as R
from . import stats as S
from .query import date_range, ledger_month

TABLES = ("cells", "groups")


def groups(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per (keys, month, direction, description)."""
    amt = F.col("amount")
    direction = F.when(amt > 0, F.lit("deposit")).otherwise(F.lit("withdrawal"))
    return df.groupBy(*(keys or []), ledger_month(df).alias("month"),
                      direction.alias("direction"), "description").agg(
        F.count(F.lit(1)).alias("n"), F.count("amount").alias("n_amount"),
        F.sum("amount").alias("net"), F.sum(F.abs("amount")).alias("total"),
        F.min("amount").alias("low"), F.max("amount").alias("high"),
        F.min("transaction_date").alias("first_date"),
        F.max("transaction_date").alias("last_date"))


def _build(name: str, ledger: DataFrame, keys: list[str]) -> DataFrame:
    return S.cells(ledger, keys) if name == "cells" else groups(ledger, keys)


def _with_markers(part: DataFrame, months: DataFrame) -> DataFrame:
    marks = months.select("month", F.lit(0).cast("long").alias("n"))
    return part.unionByName(marks, allowMissingColumns=True)


def write(ledger: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Both tables of the whole ledger, replacing what lies at ``path``."""
    for name in TABLES:
        (_build(name, ledger, keys or []).hint("rebalance", "month")
         .write.mode("overwrite").partitionBy("month").parquet(f"{path}/{name}"))


def changed_months(changed: DataFrame) -> list[str | None]:
    """The distinct months of changed rows: a value a calendar month comes to the driver."""
    got = changed.select(ledger_month(changed).alias("month")).distinct().collect()
    return sorted((r.month for r in got), key=lambda m: (m is None, m))


def _in_months(month: Column, months: list[str | None]) -> Column:
    named = month.isin([m for m in months if m is not None])
    return named | month.isNull() if None in months else named


def refresh(ledger: DataFrame, path: str, changed: DataFrame,
            keys: list[str] | None = None) -> list[str | None]:
    """Renew the months of ``changed`` (rows that were added, removed or altered, the latter with
    their old and their new dates) from ``ledger`` as it is now; returns these months."""
    months = changed_months(changed)
    if not months:
        return []
    spark = ledger.sparkSession
    marks = spark.createDataFrame([(m,) for m in months], "month string")
    rows = ledger.filter(_in_months(ledger_month(ledger), months))
    for name in TABLES:
        (_with_markers(_build(name, rows, keys or []), marks).hint("rebalance", "month")
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("month").parquet(f"{path}/{name}"))
    return months


def read(spark: SparkSession, path: str, name: str, like: DataFrame,
         keys: list[str] | None = None) -> DataFrame:
    """The table ``name`` of ``path``, without markers; ``like`` is a ledger, for the types."""
    schema = _build(name, like, keys or []).schema
    return spark.read.schema(schema).parquet(f"{path}/{name}").filter(F.col("n") > 0)


def _month_after(day: dt.date) -> dt.date:
    return dt.date(day.year + day.month // 12, day.month % 12 + 1, 1)


def cells_between(stored: DataFrame, ledger: DataFrame, start=None, end=None,
                  keys: list[str] | None = None) -> DataFrame:
    """Cells of a date range: stored ones of the months that lie wholly inside, and fresh ones of
    the ledger's rows in the months that the range cuts."""
    start, end = as_date(start), as_date(end)
    inner, edge = F.lit(True), F.lit(False)
    month = F.col("month")
    ledger_m = ledger_month(ledger)
    if start:
        first = (start if start.day == 1 else _month_after(start)).isoformat()[:7]
        inner, edge = inner & (month >= first), edge | (ledger_m < first)
    if end:
        whole = end.day == calendar.monthrange(end.year, end.month)[1]
        last = (end if whole else end.replace(day=1) - dt.timedelta(days=1)).isoformat()[:7]
        inner, edge = inner & (month <= last), edge | (ledger_m > last)
    if not start and not end:
        return stored
    cut = S.cells(date_range(ledger, start, end).filter(edge), keys or [])
    return stored.filter(inner).unionByName(cut)


def overall(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``stats.overall`` from cells."""
    aggs = [F.coalesce(F.sum("n"), F.lit(0)).alias("total_transactions"),
            S._dsum(F.col("up")).alias("total_deposits"),
            S._dsum(F.col("down")).alias("total_withdrawals"),
            S._dsum(F.col("all")).alias("net_change"),
            F.coalesce(F.try_divide(F.sum("all").cast("double"), F.sum("n_amount")), F.lit(0.0))
            .alias("avg_transaction"),
            F.min("first").alias("earliest_date"), F.max("last").alias("latest_date")]
    return cells.groupBy(*keys).agg(*aggs) if keys else cells.agg(*aggs)


def deposits_by_source(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return cells.groupBy(*(keys or []), "source").agg(
        S._dsum(F.col("up")).alias("total"), F.sum("n_pos").alias("count")).filter("count > 0")


def monthly(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return cells.groupBy(*(keys or []), "month").agg(
        S._dsum(F.col("up")).alias("deposits"), S._dsum(F.col("down")).alias("withdrawals"),
        S._dsum(F.col("all")).alias("net"))


def by_category(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return cells.filter(F.col("category").isNotNull()).groupBy(*(keys or []), "category").agg(
        S._dsum(F.col("all")).alias("total"), F.sum("n").alias("count"))


def recurring(groups_: DataFrame, min_occurrences: int = 3,
              keys: list[str] | None = None) -> DataFrame:
    """``stats.recurring`` from groups."""
    return groups_.groupBy(*(keys or []), "description").agg(
        F.sum("n").alias("occurrences"),
        F.try_divide(F.sum("net").cast("double"), F.sum("n_amount")).alias("avg_amount"),
        F.min("low").cast("double").alias("min_amount"),
        F.max("high").cast("double").alias("max_amount"),
    ).filter(F.col("occurrences") >= F.lit(min_occurrences))


def analyze_recurring(groups_: DataFrame, min_occurrences: int = 3,
                      keys: list[str] | None = None, ordered: bool = False) -> DataFrame:
    """``recurring.analyze_recurring`` from groups."""
    keys = keys or []
    g = groups_.groupBy(*keys, "direction", "description").agg(
        F.sum("n").alias("occurrences"), F.sum("total").alias("total"),
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))
    return R.with_frequency(g, min_occurrences, keys, ordered)
