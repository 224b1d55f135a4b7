"""Summary, monthly, source, category and recurring statistics.

Each function takes an optional ``keys`` list (e.g. ``["account_id"]``) so the
same plan answers one account or millions; ``keys=[]`` is the single-ledger
behaviour. Sums stay decimal (exact, order independent, so they survive any
shuffle) and become double only at the output edge. Every aggregate here is
partial-aggregatable: map-side combine leaves one row per group and task
before the shuffle, so a hot group does not concentrate rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .query import date_range, ledger_month


def _zero() -> Column:
    return F.lit(0).cast("decimal(12,2)")


def _amt() -> Column:
    return F.col("amount")


def _dsum(c: Column) -> Column:
    """COALESCE(SUM(c), 0) as double."""
    return F.coalesce(F.sum(c), _zero()).cast("double")


def _deposits() -> Column:
    return _dsum(F.when(_amt() > 0, _amt()).otherwise(_zero()))


def _withdrawals() -> Column:
    return _dsum(F.when(_amt() < 0, _amt()).otherwise(_zero()))


def _avg(c: Column) -> Column:
    """AVG as sum(double)/count, identical in every engine (NULL on no rows)."""
    return F.sum(c).cast("double") / F.count(c)


def _group(df: DataFrame, keys, *aggs) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def overall(df: DataFrame, start=None, end=None, keys: list[str] | None = None) -> DataFrame:
    """Count, deposits, withdrawals, net, average, first and last date.

    Without keys it is a global aggregate: one row even for an empty ledger.
    """
    df = date_range(df, start, end)
    return _group(
        df, keys or [],
        F.count(F.lit(1)).alias("total_transactions"),
        _deposits().alias("total_deposits"),
        _withdrawals().alias("total_withdrawals"),
        _dsum(_amt()).alias("net_change"),
        F.coalesce(_avg(_amt()), F.lit(0.0)).alias("avg_transaction"),
        F.min("transaction_date").alias("earliest_date"),
        F.max("transaction_date").alias("latest_date"),
    )


def deposits_by_source(df: DataFrame, start=None, end=None, keys: list[str] | None = None,
                       ordered: bool = False) -> DataFrame:
    """Deposits (amount > 0) per source; the NULL source is its own group."""
    keys = keys or []
    out = date_range(df, start, end).filter(_amt() > 0).groupBy(*keys, "source").agg(
        _dsum(_amt()).alias("total"), F.count(F.lit(1)).alias("count"))
    return out.orderBy(*keys, F.desc("total"), F.asc_nulls_last("source")) if ordered else out


def monthly(df: DataFrame, start=None, end=None, keys: list[str] | None = None,
            ordered: bool = False) -> DataFrame:
    """Deposits, withdrawals and net per ``YYYY-MM`` month."""
    keys = keys or []
    out = date_range(df, start, end).groupBy(*keys, ledger_month(df).alias("month")).agg(
        _deposits().alias("deposits"), _withdrawals().alias("withdrawals"),
        _dsum(_amt()).alias("net"))
    return out.orderBy(*keys, F.desc("month")) if ordered else out


def by_category(df: DataFrame, start=None, end=None, keys: list[str] | None = None,
                ordered: bool = False) -> DataFrame:
    """Net amount and count per non-NULL category (ascending total)."""
    keys = keys or []
    out = date_range(df, start, end).filter(F.col("category").isNotNull()).groupBy(
        *keys, "category").agg(_dsum(_amt()).alias("total"), F.count(F.lit(1)).alias("count"))
    return out.orderBy(*keys, "total", "category") if ordered else out


def recurring(df: DataFrame, min_occurrences: int = 3, keys: list[str] | None = None,
              ordered: bool = False) -> DataFrame:
    """Descriptions seen at least ``min_occurrences`` times (signs mixed)."""
    keys = keys or []
    out = df.groupBy(*keys, "description").agg(
        F.count(F.lit(1)).alias("occurrences"),
        _avg(_amt()).alias("avg_amount"),
        F.min(_amt()).cast("double").alias("min_amount"),
        F.max(_amt()).cast("double").alias("max_amount"),
    ).filter(F.col("occurrences") >= F.lit(min_occurrences))
    return out.orderBy(*keys, F.desc("occurrences"), "description") if ordered else out


def top_sources(df: DataFrame, n: int = 5, start=None, end=None) -> DataFrame:
    """The ``n`` largest deposit sources (a top-k, not a full sort)."""
    return deposits_by_source(df, start, end, ordered=True).limit(n)


def recent_months(df: DataFrame, n: int = 6, start=None, end=None) -> DataFrame:
    return monthly(df, start, end, ordered=True).limit(n)


def statistics_one_pass(df: DataFrame, start=None, end=None,
                        keys: list[str] | None = None) -> DataFrame:
    """Overall, by-source, monthly and by-category statistics in one scan.

    The rows are first folded to one per (keys, month, source, category); only
    these few rows are copied for the ``GROUPING SETS`` (``Expand``) of the second
    aggregate. ``grouping_id`` tells the sets apart, since a source may be a real
    NULL. Output is long: ``stat_set`` names the set and ``group_key`` holds its
    source/month/category. Source groups without deposits and the NULL category
    group are dropped, as the per-set queries filter them. Note: unlike
    ``overall``, an empty ledger yields no rows.
    """
    return fold_cells(cells(date_range(df, start, end), keys), keys)


def cells(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row of mergeable aggregates per (keys, source, month, category)."""
    keys = keys or []
    d = df.select(*keys, "amount", "transaction_date", "source", "category",
                  ledger_month(df).alias("month"))
    amount, pos = _amt(), _amt() > 0
    return d.groupBy(*keys, "source", "month", "category").agg(
        F.count(F.lit(1)).alias("n"), F.count(amount).alias("n_amount"),
        F.count(F.when(pos, F.lit(1))).alias("n_pos"),
        F.sum(F.when(pos, amount)).alias("up"), F.sum(F.when(amount < 0, amount)).alias("down"),
        F.sum(amount).alias("all"), F.min("transaction_date").alias("first"),
        F.max("transaction_date").alias("last"))


def fold_cells(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The statistics of ``statistics_one_pass`` from ``cells``, fresh or stored."""
    keys = keys or []
    sets = [keys, keys + ["source"], keys + ["month"], keys + ["category"]]
    agg = cells.groupingSets(sets, *keys, "source", "month", "category").agg(
        F.grouping_id(*keys, "source", "month", "category").alias("gid"),
        F.sum("n").alias("transactions"), F.sum("n_pos").alias("deposit_count"),
        _dsum(F.col("up")).alias("deposits"), _dsum(F.col("down")).alias("withdrawals"),
        _dsum(F.col("all")).alias("net"),
        F.min("first").alias("earliest_date"), F.max("last").alias("latest_date"),
    )
    # grouping_id bits (source, month, category; those of the keys are never set): 7 = overall, 3 = source,
    # 5 = month, 6 = category.
    gid = F.col("gid")
    stat_set = (F.when(gid == 7, "overall").when(gid == 3, "source")
                .when(gid == 5, "month").otherwise("category"))
    key = (F.when(gid == 3, F.col("source")).when(gid == 5, F.col("month"))
           .when(gid == 6, F.col("category")))
    keep = ((gid == 7) | (gid == 5) | ((gid == 3) & (F.col("deposit_count") > 0))
            | ((gid == 6) & F.col("category").isNotNull()))
    return agg.filter(keep).select(
        *keys, stat_set.alias("stat_set"), key.alias("group_key"), "transactions",
        "deposit_count", "deposits", "withdrawals", "net",
        (F.col("net") / F.col("transactions")).alias("avg_transaction"),
        "earliest_date", "latest_date")
