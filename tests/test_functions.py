"""Golden rows for the scalar parsers and classifiers (FIXTURES.md section 7)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import (categorize, extract_source, frequency_from_gap, parse_amount,
                                  parse_date, per_month, safe_pattern)

D = dt.date

DATES = [
    ("01/15/2024", D(2024, 1, 15)), ("13/02/2024", D(2024, 2, 13)),
    ("1/5/2024", D(2024, 1, 5)), ("02/03/2024", D(2024, 2, 3)),
    ("01-15-2024", D(2024, 1, 15)), ("13-02-2024", D(2024, 2, 13)),
    ("2024/01/15", D(2024, 1, 15)), ("01/15/24", D(2024, 1, 15)),
    ("01/15/70", D(1970, 1, 15)), ("01/15/68", D(2068, 1, 15)),
    ("Jan 15, 2024", D(2024, 1, 15)), ("2024-01-15 10:30:00", D(2024, 1, 15)),
    ("13/02/24", D(2024, 2, 13)), ("20240115", D(2024, 1, 15)),
    ("2024-01-15", D(2024, 1, 15)), ("  01/15/2024 ", D(2024, 1, 15)),
    ("15 January 2024", D(2024, 1, 15)), ("2024-01-15T08:00:00Z", D(2024, 1, 15)),
    ("02/30/2024", None), ("", None), ("hello", None), (None, None), ("N/A", None),
]

AMOUNTS = [
    ("$1,234.56", Decimal("1234.56")), ("(5.00)", Decimal("-5.00")),
    ("-$5", Decimal("-5.00")), ("$-5", Decimal("-5.00")), ("(-5)", None),
    (None, Decimal("0.00")), ("", Decimal("0.00")), ("N/A", Decimal("0.00")),
    ("$", None), ("()", None), ("abc", None), ("1e3", Decimal("1000.00")),
    ("1 000", Decimal("1000.00")), ("1.005", Decimal("1.01")), ("-1.005", Decimal("-1.01")),
    ("+5", Decimal("5.00")), ("inf", None), ("1_000", None), ("5d", None),
    ("99999999999", None), (".5", Decimal("0.50")),
]

CLASSIFY = [
    ("DIRECT DEP Acme Corp Payroll", 1, "Income", "Acme Corp"),
    ("Payroll", 1, "Income", "Payroll"),
    ("Mobile Deposit", 1, "Income", "Other"),
    ("Zelle TRANSFER from savings", 1, "Transfer In", "Transfer"),
    ("XFER in", 1, "Transfer In", "Other"),
    ("Interest payment", 1, "Interest/Dividend", "Interest"),
    ("Dividend credit", 1, "Interest/Dividend", "Other"),
    ("Refund", 1, "Other Income", "Other"),
    ("ATM Withdrawal - Main St", -1, "ATM/Cash", "ATM Withdrawal"),
    ("Treatment center", -1, "ATM/Cash", "Treatment center"),
    ("Las Vegas Hotel", -1, "Gas/Fuel", "Las Vegas Hotel"),
    ("Coffee House", -1, "Dining", "Coffee House"),
    ("City Water Utility", -1, "Utilities", "City Water Utility"),
    ("Transfer charge", -1, "Transfer Out", "Transfer charge"),
    ("-Leading dash", -1, "Other Expense", ""),
    ("Payroll", 0, "Other Expense", "Payroll"),
    ("payroll  two   spaced words here", 1, "Income", "spaced words"),
    ("x" * 60 + " - tail", -1, "Other Expense", "x" * 50),
]


def _one(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[1] for r in df.select("i", fn(F.col("v"))).orderBy("i").collect()]


def test_parse_date_golden(spark):
    got = _one(spark, [x for x, _ in DATES], parse_date)
    assert got == [y for _, y in DATES]


def test_parse_amount_golden(spark):
    got = _one(spark, [x for x, _ in AMOUNTS], parse_amount)
    assert got == [y for _, y in AMOUNTS]


def test_categorize_and_source_golden(spark):
    df = spark.createDataFrame([(i, d, float(s)) for i, (d, s, _, _) in enumerate(CLASSIFY)],
                               "i int, d string, a double")
    rows = df.select("i", categorize(F.col("d"), F.col("a")).alias("c"),
                     extract_source(F.col("d"), F.col("a")).alias("s")).orderBy("i").collect()
    assert [(r.c, r.s) for r in rows] == [(c, s) for _, _, c, s in CLASSIFY]


@pytest.mark.parametrize("gap,freq", [(10, "weekly"), (10.5, "biweekly"), (17, "biweekly"),
                                      (35, "monthly"), (100, "quarterly"), (100.5, "yearly"),
                                      (None, "monthly")])
def test_frequency_from_gap(spark, gap, freq):
    value = None if gap is None else float(gap)
    assert _one(spark, [value], frequency_from_gap, "double") == [freq]


def test_per_month(spark):
    got = _one(spark, ["weekly", "WEEKLY", "biweekly", "monthly", "quarterly", "yearly",
                       "Hourly", None], per_month)
    assert got == [52 / 12, 52 / 12, 26 / 12, 1.0, 1 / 3, 1 / 12, 1.0, 1.0]


def test_safe_pattern(spark):
    got = _one(spark, ["%a\\%b%", "%ab\\c%", "%a\\\\x%", "%plain%"], safe_pattern)
    assert got == ["%a\\%b%", "%abc%", "%a\\\\x%", "%plain%"]


def test_staged_dates_equal_column_form(spark):
    from tallyspark.functions.parse import with_parsed_dates
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(DATES)], "i int, v string")
    got = [r.d for r in with_parsed_dates(df, {"d": "v"}).orderBy("i").collect()]
    assert got == [y for _, y in DATES]
