"""Keyword categorization and payee extraction as native Column expressions.

Rules are data (ordered lists); the ``when`` chains are generated from them,
so the physical plan holds one ``CASE WHEN`` per output and no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, split_words, strip_ws

# Categorization rules, first matching rule wins, lower-case
# substring test. Deposits are amount > 0; everything else (including 0) is
# a withdrawal.
DEPOSIT_RULES = [
    ("Income", ["direct dep", "deposit", "payroll", "salary"]),
    ("Transfer In", ["transfer", "xfer"]),
    ("Interest/Dividend", ["interest", "dividend"]),
]
DEPOSIT_DEFAULT = "Other Income"
WITHDRAWAL_RULES = [
    ("ATM/Cash", ["atm", "withdrawal"]),
    ("Groceries", ["grocery", "supermarket", "food"]),
    ("Gas/Fuel", ["gas", "fuel", "shell", "exxon", "chevron"]),
    ("Dining", ["restaurant", "cafe", "coffee"]),
    ("Utilities", ["utility", "electric", "gas", "water"]),
    ("Transfer Out", ["transfer", "xfer"]),
    ("Check", ["check", "cheque"]),
    ("Fees", ["fee", "charge"]),
]
WITHDRAWAL_DEFAULT = "Other Expense"

# Payee extraction for deposits.
PAYROLL_WORDS = ["direct dep", "payroll"]
PAYROLL_DEFAULT = "Payroll"
SOURCE_MAX_CHARS = 50


def _chain(lowered: Column, rules, default: str) -> Column:
    expr = None
    for label, words in rules:
        cond = contains_any(lowered, words)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def categorize(description: Column, amount: Column) -> Column:
    """Category label for a (stripped) description and its signed amount."""
    lowered = F.lower(description)
    return F.when(amount > 0, _chain(lowered, DEPOSIT_RULES, DEPOSIT_DEFAULT)).otherwise(
        _chain(lowered, WITHDRAWAL_RULES, WITHDRAWAL_DEFAULT)
    )


def extract_source(description: Column, amount: Column) -> Column:
    """Payee/source of a transaction.

    Deposits: payroll-like text gives words 3-4 of the original-case text (or
    ``Payroll`` for two words or fewer); ``transfer`` gives ``Transfer``;
    ``interest`` gives ``Interest``; else ``Other``. Withdrawals: the text before
    the first ``-``, stripped, at most 50 characters (may be empty).
    """
    lowered = F.lower(description)
    words = split_words(strip_ws(description))
    payroll = F.when(F.size(words) > 2, F.array_join(F.slice(words, 3, 2), " ")).otherwise(
        F.lit(PAYROLL_DEFAULT)
    )
    deposit = (
        F.when(contains_any(lowered, PAYROLL_WORDS), payroll)
        .when(lowered.contains("transfer"), F.lit("Transfer"))
        .when(lowered.contains("interest"), F.lit("Interest"))
        .otherwise(F.lit("Other"))
    )
    head = strip_ws(F.substring_index(description, "-", 1))
    withdrawal = F.substring(head, 1, SOURCE_MAX_CHARS)
    return F.when(amount > 0, deposit).otherwise(withdrawal)
