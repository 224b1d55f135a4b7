"""Golden and property tests of the ledger operators."""

import datetime as dt
import os
import random
import tempfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from tallyspark.operators import contrib as C
from tallyspark.operators import ingest as I
from tallyspark.operators import maintain as M
from tallyspark.operators import project as P
from tallyspark.operators import query as Q
from tallyspark.operators import recurring as R
from tallyspark.operators import stats as S
from tallyspark.schema import TRANSACTIONS
from tallyspark.sources import fixtures as FX
from tallyspark.sources.statements import read_statements


@pytest.fixture(scope="module")
def ledger(spark):
    return FX.orders_ledger(spark, SF_MID).cache()


@pytest.fixture(scope="module")
def mappings(spark):
    return FX.mappings(spark)


# --- projection golden (FIXTURES section 7) -----------------------------------

def _scenario(spark, balance, items, months):
    acc = spark.createDataFrame([(1, float(balance))], "account_id long, current_balance double")
    it = spark.createDataFrame([(1,) + x for x in items],
                               "account_id long, direction string, description string, "
                               "amount double, frequency string")
    return P.project_balances(acc, it, months, dt.date(2024, 1, 31))


def test_projection_golden(spark):
    grid, summ = _scenario(spark, 1100, [("deposit", "d", 100.0, "weekly"),
                                         ("withdrawal", "w", -600.0, "monthly")], 3)
    g = grid.orderBy("month").collect()
    assert [r.month for r in g] == ["2024-01", "2024-02", "2024-03", "2024-04"]
    assert [round(r.projected_balance, 2) for r in g] == [1100.00, 933.33, 766.67, 600.00]
    assert (g[0].deposits, g[0].withdrawals, g[0].net_change) == (0.0, 0.0, 0.0)
    assert g[1].month_name == "February 2024"
    s = summ.first()
    assert round(s.total_deposits, 2) == 1300.00 and round(s.total_withdrawals, 2) == 1800.00
    assert round(s.total_change, 2) == -500.00 and round(s.monthly_net, 2) == -166.67
    assert s.trend == "negative" and s.months_until_zero == 6


def test_projection_edges(spark):
    grid, summ = _scenario(spark, 50, [("deposit", "d", 100.0, "monthly"),
                                       ("withdrawal", "w", -100.0, "monthly")], 0)
    assert grid.count() == 1
    s = summ.first()
    assert s.trend == "neutral" and s.months_until_zero is None
    grid, summ = _scenario(spark, -5, [("withdrawal", "w", -10.0, "Hourly")], -1)
    assert grid.count() == 0
    s = summ.first()
    assert s.monthly_net == -10.0 and s.months_until_zero is None
    _, summ = _scenario(spark, 10, [("deposit", "d", None, "WEEKLY")], 2)
    assert summ.first().monthly_net == 0.0


def test_grid_last_balance_equals_final(spark):
    grid, summ = P.project_balances(FX.accounts(spark, SF_MID), FX.recurring_items(spark, SF_MID),
                                    12, dt.date(2001, 9, 1))
    last = grid.groupBy("account_id").agg(F.max_by("projected_balance", "month").alias("b"))
    bad = last.join(summ, "account_id").filter(F.abs(F.col("b") - F.col("final_balance")) > 1e-6)
    assert bad.count() == 0


# --- statements golden (FIXTURES section 6) -------------------------------------

MAIN = ('﻿Account,XXXX\n\nTransaction Date ,DESCRIPTION,Amount,Balance,TransactionType,'
        'Categories\n01/15/2024,"Whole Food, Market - ""12""","($1,234.56)",500.00,DEBIT,x\n'
        ',,,,,\n1/5/24,DIRECT DEP Acme Corp Payroll,"$2,000.00",,CREDIT,\n'
        'bad date,Row is rejected,1.00,,,\n01/16/2024,N/A,,7,,\n01/17/2024,too wide,1,2,3,4,5\n'
        '01/18/2024,"unbalanced,1,2,,\n')


@pytest.fixture(scope="module")
def statement_dir():
    d = tempfile.mkdtemp(prefix="stmts-")
    files = {
        "main.csv": MAIN,
        "noheader.csv": "01/15/2024,x,1\n01/16/2024,y,2\n",
        "falsehdr.csv": "Last updated today\nDate,Description,Amount\n01/15/2024,x,1\n",
        "dupcol.csv": "Date,Transaction Date,Description,Amount\n01/15/2024,01/15/2024,x,1\n",
        "order.csv": "Amount,Description,Date\n5,reordered,2024-02-01\n",
    }
    for name, text in files.items():
        with open(os.path.join(d, name), "w", encoding="utf-8") as fh:
            fh.write(text)
    with open(os.path.join(d, "badutf8.csv"), "wb") as fh:
        fh.write(b"Date,Description,Amount\n01/15/2024,\xff\xfe,1\n")
    return d


def test_statement_golden(spark, statement_dir):
    clean, rejects = read_statements(spark, statement_dir)
    rows = {(r.path.rsplit("/", 1)[1], r.line_no): r for r in clean.collect()}
    assert set(rows) == {("main.csv", 3), ("main.csv", 5), ("main.csv", 7), ("order.csv", 1)}
    r = rows[("main.csv", 3)]
    assert (r.transaction_date, r.description, r.amount, r.balance) == (
        dt.date(2024, 1, 15), 'Whole Food, Market - "12"', Decimal("-1234.56"), Decimal("500.00"))
    assert r.category == "Groceries" and r.source == "Whole Food, Market"
    r = rows[("main.csv", 5)]
    assert (r.transaction_date, r.amount, r.balance, r.source) == (
        dt.date(2024, 1, 5), Decimal("2000.00"), None, "Acme Corp")
    r = rows[("main.csv", 7)]
    assert (r.description, r.amount, r.balance) == ("nan", Decimal("0.00"), Decimal("7.00"))
    got = {(r.path.rsplit("/", 1)[1], r.line_no, r.reason) for r in rejects.collect()}
    assert got == {("main.csv", 6, "bad_date"), ("main.csv", 8, "too_wide"),
                   ("main.csv", 9, "unbalanced_quote"), ("noheader.csv", None, "missing_column"),
                   ("falsehdr.csv", None, "missing_column"),
                   ("dupcol.csv", None, "duplicate_column"),
                   ("badutf8.csv", None, "invalid_utf8")}
    # every md5 is the file's hash
    assert clean.filter(F.length("csv_hash") != 32).count() == 0


def test_strict_header(spark, statement_dir):
    clean, rejects = read_statements(spark, statement_dir, strict_header=True)
    files = {r.path.rsplit("/", 1)[1] for r in clean.collect()}
    assert "falsehdr.csv" in files


# --- import properties -------------------------------------------------------------

def test_import_idempotent_and_counts(spark):
    coarse = FX.coarse_events(spark, SF_MID)
    existing = I.first_per_key(coarse.filter("transaction_date < '2024-01-16'"), ["line_no"])
    incoming = coarse.filter("transaction_date >= '2024-01-10'")
    res = I.import_transactions(existing, incoming)
    c = res.counts.first()
    assert c.incoming == incoming.count() and c.inserted + c.skipped == c.incoming
    again = I.import_transactions(existing.unionByName(res.new), incoming).counts.first()
    assert again.inserted == 0
    empty = I.import_transactions(existing, incoming.limit(0)).counts.first()
    assert (empty.incoming, empty.inserted, empty.skipped) == (0, 0, 0)


def test_first_row_wins(spark):
    rows = [(1, 0, dt.date(2024, 1, 1), "x", Decimal("1.00"), 5),
            (2, 0, dt.date(2024, 1, 1), "x", Decimal("1.00"), 3),
            (3, 0, dt.date(2024, 1, 1), "x", Decimal("2.00"), 9)]
    inc = spark.createDataFrame(rows, "id long, account_id long, transaction_date date, "
                                      "description string, amount decimal(12,2), line_no long")
    new = I.import_transactions(inc.limit(0), inc).new
    assert sorted(r.id for r in new.collect()) == [2, 3]


# --- statistics properties -----------------------------------------------------------

def test_overall_consistency(ledger):
    o = S.overall(ledger).first()
    assert abs(o.total_deposits + o.total_withdrawals - o.net_change) < 1e-6
    months = S.monthly(ledger).agg(F.sum("net")).first()[0]
    assert abs(months - o.net_change) < 1e-3


def test_empty_ledger_overall(spark):
    empty = spark.createDataFrame([], TRANSACTIONS)
    o = S.overall(empty).collect()
    assert len(o) == 1 and o[0].total_transactions == 0 and o[0].total_deposits == 0.0
    assert Q.latest_balance(empty).first().balance == 0.0


def test_one_pass_equals_separate(ledger):
    one = S.statistics_one_pass(ledger)
    by_month = {r.group_key: (r.deposits, r.withdrawals, r.net)
                for r in one.filter("stat_set = 'month'").collect()}
    sep = {r.month: (r.deposits, r.withdrawals, r.net) for r in S.monthly(ledger).collect()}
    assert by_month == sep


def test_result_independent_of_partitions(spark, ledger):
    a = sorted(S.monthly(ledger.repartition(1)).collect())
    b = sorted(S.monthly(ledger.repartition(8)).collect())
    assert a == b


# --- contributions (FIXTURES section 3) -------------------------------------------

EXPECTED = {"Avery": (254390016.29, 594), "Blake": (209574659.48, 811),
            "Casey": (152355933.34, 611), "Drew": (268030399.95, 1081)}


@pytest.mark.parametrize("strategy", ["inline", "ngram"])
def test_contribution_totals(ledger, mappings, strategy):
    got = {r.person_name: (round(r.total, 2), r["count"])
           for r in C.totals(ledger, mappings, strategy=strategy).collect()}
    assert got == EXPECTED


def test_first_match_count_and_subset(ledger, mappings):
    j2 = C.contributions(ledger, mappings)
    assert j2.count() == 2674
    pairs = C.keyword_matches(ledger.filter("amount > 0"), mappings)
    assert j2.join(pairs.select("id", "person_name"), ["id", "person_name"], "left_anti") \
        .count() == 0


def test_no_mappings(spark, ledger, mappings):
    assert C.contributions(ledger, mappings.limit(0)).count() == 0
    assert C.avg_monthly(ledger, mappings.limit(0)).first()[0] == 0.0


def test_wildcard_only_keyword_ngram(spark):
    t = spark.createDataFrame([(1, dt.date(2024, 1, 1), "ab", Decimal("1.00"), None),
                               (2, dt.date(2024, 1, 1), "abcd", Decimal("2.00"), None)],
                              "id long, transaction_date date, description string, "
                              "amount decimal(12,2), balance decimal(12,2)")
    m = spark.createDataFrame([(1, "P", "___"), (2, "Q", "b\\c"), (3, "R", "%")],
                              "id long, person_name string, keyword string")
    a = sorted((r.id, r.person_name) for r in C.keyword_matches(t, m, "inline").collect())
    b = sorted((r.id, r.person_name) for r in C.keyword_matches(t, m, "ngram").collect())
    assert a == b == [(1, "R"), (2, "P"), (2, "Q"), (2, "R")]


# --- maintenance ------------------------------------------------------------------

def test_upsert_and_delete_mappings(spark, mappings):
    new = spark.createDataFrame([(" Avery ", " payroll "), ("  ", "x"), ("Emery", ""),
                                 ("Emery", "misc")], "person_name string, keyword string")
    after, rejects = M.upsert_mappings(mappings, new)
    assert after.count() == 9
    assert sorted(r.reason for r in rejects.collect()) == ["duplicate", "empty_keyword",
                                                            "empty_person"]
    ids = spark.createDataFrame([(1,), (999,)], "id long")
    kept, missing = M.delete_mappings(mappings, ids)
    assert kept.count() == 7 and [r.id for r in missing.collect()] == [999]


def test_corrections(spark, ledger):
    first = ledger.orderBy("id").first()
    second = ledger.orderBy("id").offset(1).first()
    c = spark.createDataFrame(
        [(first.id, {"category": "X", "amount": "1"}), (first.id, {"notes": None}),
         (10 ** 12, {"category": "Y"}), (second.id, {})], "id long, changes map<string,string>")
    out = M.apply_corrections(ledger, c)
    r = out.filter(F.col("id") == first.id).first()
    assert r.category == "X" and r.notes is None and r.amount == first.amount
    assert r.description == first.description
    assert out.filter(F.col("id") == second.id).first() == second     # empty map: unchanged
    assert out.count() == ledger.count()


def test_ordered_corrections_keep_the_last_value(spark, ledger):
    first = ledger.orderBy("id").first()
    c = spark.createDataFrame(
        [(first.id, {"category": "Z", "notes": "a"}, 1), (first.id, {"category": "A", "notes": None}, 2)],
        "id long, changes map<string,string>, seq int")
    r = M.apply_corrections(ledger, c, order="seq").filter(F.col("id") == first.id).first()
    assert r.category == "A" and r.notes is None


def test_projection_sums_are_exact(spark):
    accounts = spark.createDataFrame([(1, 650.0), (2, 0.0)], "account_id long, current_balance double")
    items = spark.createDataFrame(
        [(1, "withdrawal", 100.0, "biweekly"), (2, "deposit", 1e13, "weekly")],
        "account_id long, direction string, amount double, frequency string")
    from tallyspark.operators import project as P
    got = {r.account_id: r for r in P.project_balances(accounts, items)[1].collect()}
    assert got[1].months_until_zero == 3
    assert abs(got[2].monthly_net - 1e13 * 52 / 12) < 1


def test_search_bounds_are_not_rounded(spark, ledger):
    from tallyspark.operators import query as Q
    rows = spark.createDataFrame([(1, "10.00"), (2, "10.01")], "id long, amount string").withColumn(
        "amount", F.col("amount").cast("decimal(12,2)"))
    assert [r.id for r in Q.search(rows, max_amount=10.005).collect()] == [1]
    assert [r.id for r in Q.search(rows, min_amount=10.004).collect()] == [2]
    assert Q.search(rows, max_amount=1e10).count() == 2


# --- recurrence ---------------------------------------------------------------------

def test_recurring_frequency_classes(spark):
    freq = {r.frequency: r.n for r in R.analyze_recurring(FX.events_ledger(spark, SF_MID), 2)
            .groupBy("frequency").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert freq == {"weekly": 2219, "biweekly": 438, "monthly": 144}


def test_search_fixture_count(ledger):
    found = Q.search(ledger, start="1997-01-01", end="1998-12-31").filter(
        F.col("description").ilike("%coffee%") | F.col("notes").ilike("%high%"))
    assert found.count() == 327


@pytest.mark.parametrize("amounts", [[1 / 3] * 3, [1e18, 1.0, -3e18], [1e-9, 2e-9], [0.1] * 10, [9.99e14] * 50])
def test_projection_sums_of_any_size(spark, amounts):
    """Deposits by the reference's formula: the sum of amount x occurrences a month."""
    import math
    items = spark.createDataFrame([(1, "deposit", a, "weekly") for a in amounts] + [(1, "withdrawal", a, None) for a in amounts],
                                  "account_id long, direction string, amount double, frequency string").repartition(4)
    r = P.monthly_flows(items, ["account_id"]).first()
    assert math.isclose(r.monthly_deposits, sum(a * 52 / 12 for a in amounts), rel_tol=1e-13)
    assert math.isclose(r.monthly_withdrawals, sum(map(abs, amounts)), rel_tol=1e-13)


def _edited(rows, edits):
    """Edits one after another: (descriptions by id, refused (id, description) in order)."""
    key = {i: (d, t, a) for i, d, t, a in rows}
    refused = []
    for _, i, to in sorted(edits, key=lambda e: e[:2]):
        if i in key:
            d, _, a = key[i]
            new = (d, to, a)
            if None not in new and any(k == new for j, k in key.items() if j != i):
                refused.append((i, to))
            else:
                key[i] = new
    return {i: k[1] for i, k in key.items()}, sorted(refused, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_corrections_refuse_keys_taken_at_their_time(spark, seed):
    """Chains and swaps of descriptions against the same edits made one by one."""
    rnd = random.Random(seed)
    rows, seen = [], set()
    while len(rows) < 60:
        k = (rnd.choice([dt.date(2024, 1, 1), dt.date(2024, 1, 2), None]), rnd.choice("abcdefgh") + rnd.choice("12"),
             rnd.choice([Decimal("1.00"), Decimal("2.00")]))
        if k not in seen or None in k:
            seen.add(k)
            rows.append((len(rows), *k))
    edits = [(n, rnd.randint(0, 65), rnd.choice([rnd.choice("abcdefgh") + rnd.choice("12"), "new", None]))
             for n in range(45)]
    t = spark.createDataFrame([(*r, "c", "s", "n") for r in rows],
                              "id long, transaction_date date, description string, amount decimal(12,2), "
                              "category string, source string, notes string")
    c = spark.createDataFrame([(n, i, {"description": to, "notes": str(n)}) for n, i, to in edits],
                              "seq int, id long, changes map<string,string>").repartition(3)
    after, refused = M.correct(t, c, order="seq")
    want, no = _edited(rows, edits)
    got = {r.id: r.description for r in after.collect()}
    assert got == want
    assert sorted(((r.id, r.description) for r in refused.collect()), key=repr) == no and no
    # a refused edit changes no field
    notes = {i: "n" for i in want}
    left = list(no)
    for n, i, to in edits:
        if i in notes:
            ok = _edited(rows, edits[:n + 1])[1].count((i, to)) == _edited(rows, edits[:n])[1].count((i, to))
            notes[i] = str(n) if ok else notes[i]
    assert {r.id: r.notes for r in after.collect()} == notes


def test_corrections_many_to_one_key_take_few_rounds(spark):
    """Thousands of edits to one key: the first takes it, the others are refused together."""
    t = spark.range(3000).selectExpr("id", "DATE '2024-01-01' AS transaction_date", "concat('d', id) AS description",
                                     "CAST(1 AS DECIMAL(12,2)) AS amount", "'' AS category", "'' AS source", "'' AS notes")
    c = spark.range(3000).selectExpr("id", "map('description', 'same') AS changes")
    after, refused = M.correct(t, c)
    assert refused.count() == 2999 and after.where("description = 'same'").select("id").first().id == 0
    assert after.select("description").distinct().count() == 3000
