"""Month-by-month balance projection for many accounts at once (R2-R6).

``project_balances`` takes a scenario *table* (accounts with a current
balance, plus recurring items) instead of one request, so the same plan
projects one account or millions: one ``groupBy(account)`` for the monthly
totals, one equi-join on the account key, and a narrow ``explode(sequence)``
for the month grid. The running balance uses the closed form
``b0 + i * net`` instead of a sequential loop, so no window or ordering is
needed (trap: repeated float addition in the reference differs from the closed
form in the last bits).
"""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import OCCURRENCES_PER_MONTH, month_key, month_label
from . import contrib as C
from .query import latest_balance


def monthly_flows(items: DataFrame, keys: list[str]) -> DataFrame:
    """Recurring items -> monthly deposits and withdrawals per account.

    Deposits keep their sign; withdrawals count with their absolute value; an
    absent amount is 0; frequency per ``OCCURRENCES_PER_MONTH`` (absent:
    monthly; unknown: once a month). Amounts are summed for each direction and
    frequency, and the few sums of an account then multiplied by their factors
    and added in one fixed order, so the result does not depend on the order rows
    arrive in: see ``exact_sum``.
    """
    amt = F.coalesce(F.col("amount").cast("double"), F.lit(0.0))
    f = F.lower(F.coalesce(F.col("frequency"), F.lit("monthly")))
    is_dep = F.col("direction") == "deposit"
    known = [name for name, _ in OCCURRENCES_PER_MONTH]

    def total(cond, value):
        parts = [exact_sum(F.when(cond & which, value)) * F.lit(k)
                 for which, k in [*((f == name, float(k)) for name, k in OCCURRENCES_PER_MONTH),
                                  (~f.isin(known), 1.0)]]
        return reduce(lambda x, y: x + y, parts)

    return items.groupBy(*keys).agg(total(is_dep, amt).alias("monthly_deposits"),
                                    total(~is_dep, F.abs(amt)).alias("monthly_withdrawals"))


def exact_sum(value: Column) -> Column:
    """Sum of doubles, 0 for none. Values from a thousandth to 10**15 keep all their digits in a
    decimal of 18 places, so their sum is exact in any order. Values outside are added as
    doubles: no value is rounded or too large."""
    size = F.abs(value)
    inside = (size >= 1e-3) & (size < 1e15)
    return (F.coalesce(F.sum(F.when(inside, value).cast("decimal(33,18)")).cast("double"), F.lit(0.0))
            + F.coalesce(F.sum(F.when(~inside, value)), F.lit(0.0)))


def project_balances(accounts: DataFrame, items: DataFrame, months: int = 12,
                     as_of: _dt.date | None = None, keys: list[str] | None = None
                     ) -> tuple[DataFrame, DataFrame]:
    """Returns ``(grid, summary)``.

    grid: one row per account and month ``i = 0..months`` (none when
    ``months < 0``); row 0 has zero flows and the current balance.
    summary: final balance, total change, totals over the horizon, monthly
    net, trend and months until zero (NULL unless net < 0 and balance > 0).
    Accounts without a current balance are left out; ``projection_rejects``
    lists them.
    """
    keys = keys or ["account_id"]
    as_of = as_of or _dt.date.today()
    flows = monthly_flows(items, keys)
    valid = accounts.filter(F.col("current_balance").isNotNull())
    base = valid.join(flows, keys, "left").select(
        *keys, F.col("current_balance").cast("double").alias("b0"),
        F.coalesce("monthly_deposits", F.lit(0.0)).alias("dep"),
        F.coalesce("monthly_withdrawals", F.lit(0.0)).alias("wd"),
    ).withColumn("net", F.col("dep") - F.col("wd"))

    i = F.col("i")
    first = F.lit(as_of)
    grid = base.select("*", F.explode(
        F.sequence(F.lit(0), F.lit(months)) if months >= 0 else F.array().cast("array<int>")
    ).alias("i")).select(
        *keys,
        month_key(F.add_months(first, i)).alias("month"),
        month_label(F.add_months(first, i)).alias("month_name"),
        F.when(i > 0, F.col("dep")).otherwise(F.lit(0.0)).alias("deposits"),
        F.when(i > 0, F.col("wd")).otherwise(F.lit(0.0)).alias("withdrawals"),
        F.when(i > 0, F.col("net")).otherwise(F.lit(0.0)).alias("net_change"),
        (F.col("b0") + i.cast("double") * F.col("net")).alias("projected_balance"),
    )

    steps = float(max(months, 0))
    final = F.col("b0") + F.lit(steps) * F.col("net")
    net = F.col("net")
    summary = base.select(
        *keys,
        F.col("b0").alias("current_balance"),
        final.alias("final_balance"),
        (final - F.col("b0")).alias("total_change"),
        (F.col("dep") * F.lit(float(months))).alias("total_deposits"),
        (F.col("wd") * F.lit(float(months))).alias("total_withdrawals"),
        net.alias("monthly_net"),
        F.when(net > 0, "positive").when(net < 0, "negative").otherwise("neutral").alias("trend"),
        F.when((net < 0) & (F.col("b0") > 0), F.floor(F.col("b0") / F.abs(net)))
        .cast("bigint").alias("months_until_zero"),
    )
    return grid, summary


def projection_rejects(accounts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Accounts that cannot be projected: no current balance (the reference's
    call fails on a missing balance; here the account is reported instead)."""
    keys = keys or ["account_id"]
    return accounts.filter(F.col("current_balance").isNull()).select(
        *keys, F.lit("missing_balance").alias("reason"))


def auto_scenario(t: DataFrame, m: DataFrame, withdrawals: DataFrame, as_of: _dt.date,
                  months: int = 12, start=None, end=None) -> tuple[DataFrame, DataFrame]:
    """The browser's automatic projection for one ledger: current balance =
    balance of the newest row (0 if none), monthly deposit = average monthly
    contributions, withdrawals = the given recurring items."""
    bal = latest_balance(t).select(F.lit(0).cast("bigint").alias("account_id"),
                                   F.col("balance").alias("current_balance"))
    dep = C.avg_monthly(t, m, start, end).select(
        F.lit(0).cast("bigint").alias("account_id"), F.lit("deposit").alias("direction"),
        F.lit("Average Monthly Contributions").alias("description"),
        F.col("avg_monthly_contributions").alias("amount"), F.lit("monthly").alias("frequency"))
    wds = withdrawals.select(
        F.lit(0).cast("bigint").alias("account_id"), F.lit("withdrawal").alias("direction"),
        "description", F.col("amount").cast("double").alias("amount"), "frequency")
    return project_balances(bal, dep.unionByName(wds), months, as_of)
