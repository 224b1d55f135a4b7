"""Edge inputs: empty ledger, one row, NULL optional fields, nothing valid."""

import datetime as dt
import os
import tempfile
from decimal import Decimal

import pytest

from tallyspark.operators import contrib as C
from tallyspark.operators import query as Q
from tallyspark.operators import recurring as R
from tallyspark.operators import stats as S
from tallyspark.schema import TRANSACTIONS, conform
from tallyspark.session import checkpoint_root
from tallyspark.sources import fixtures as FX
from tallyspark.sources.statements import read_statements


def _one_row(spark, **over):
    row = dict(id=1, account_id=1, transaction_date=dt.date(2024, 1, 2), description="Payroll",
               amount=Decimal("10.00"), balance=None, category=None, source=None, notes=None,
               csv_hash=None, imported_at=None)
    row.update(over)
    return spark.createDataFrame([tuple(row[f.name] for f in TRANSACTIONS.fields)], TRANSACTIONS)


def test_empty_ledger_everywhere(spark):
    e = spark.createDataFrame([], TRANSACTIONS)
    m = FX.mappings(spark)
    assert S.monthly(e).count() == 0
    assert S.statistics_one_pass(e).count() == 0          # documented: no rows
    assert S.recurring(e).count() == 0
    assert R.analyze_recurring(e).count() == 0
    assert C.contributions(e, m).count() == 0
    assert C.summary(e, m).first().people == 0
    assert Q.search_total(e, text="x").first().total == 0.0
    assert Q.list_page(e, 20).count() == 0


def test_single_row(spark):
    t = _one_row(spark)
    o = S.overall(t).first()
    assert (o.total_transactions, o.total_deposits, o.avg_transaction) == (1, 10.0, 10.0)
    r = R.analyze_recurring(t, 1).first()
    assert r.frequency == "monthly" and r.avg_days_between is None
    assert Q.latest_balance(t).first().balance is None     # newest row has no balance


def test_null_optional_fields(spark):
    t = _one_row(spark, notes=None, category=None, source=None)
    assert S.by_category(t).count() == 0                    # NULL category dropped
    assert S.deposits_by_source(t).first().source is None   # NULL source kept
    assert Q.search(t, text="note").count() == 0             # NULL notes never match
    assert Q.distinct_values(t, "category").count() == 0


def test_zero_amount_is_neither_side(spark):
    t = _one_row(spark, amount=Decimal("0.00"))
    o = S.overall(t).first()
    assert (o.total_deposits, o.total_withdrawals, o.total_transactions) == (0.0, 0.0, 1)
    assert R.analyze_recurring(t, 1).first().direction == "withdrawal"


def test_all_rows_rejected(spark):
    d = tempfile.mkdtemp(prefix="bad-")
    with open(os.path.join(d, "a.csv"), "w") as fh:
        fh.write("Date,Description,Amount\nnope,x,1\n01/02/2024,y,abc\n")
    clean, rejects = read_statements(spark, d)
    assert clean.count() == 0
    assert sorted(r.reason for r in rejects.collect()) == ["bad_amount", "bad_date"]


def test_keyword_with_backslash_and_wildcards(spark):
    t = conform(spark.createDataFrame(
        [(1, dt.date(2024, 1, 1), "50% off\\sale", Decimal("1.00")),
         (2, dt.date(2024, 1, 1), "500 off sale", Decimal("1.00"))],
        "id long, transaction_date date, description string, amount decimal(12,2)"))
    m = spark.createDataFrame([(1, "P", "0\\% off"), (2, "Q", "f\\s"), (3, "R", "0_ off")],
                              "id long, person_name string, keyword string")
    b = sorted((r.id, r.person_name) for r in C.keyword_matches(t, m, "inline").collect())
    n = sorted((r.id, r.person_name) for r in C.keyword_matches(t, m, "ngram").collect())
    # '\%' is a literal %; a stray '\s' is read as 's' (so 'f\s' looks for 'fs',
    # found nowhere); '_' matches one character
    assert b == n == [(1, "P"), (1, "R"), (2, "R")]


def test_projection_skips_and_reports_missing_balance(spark):
    from tallyspark.operators import project as P
    acc = spark.createDataFrame([(1, 100.0), (2, None)], "account_id long, current_balance double")
    items = spark.createDataFrame([(1, "deposit", "d", 10.0, "monthly"),
                                   (2, "deposit", "d", 10.0, "monthly")],
                                  "account_id long, direction string, description string, "
                                  "amount double, frequency string")
    grid, summary = P.project_balances(acc, items, 2, dt.date(2024, 1, 31))
    assert {r.account_id for r in summary.collect()} == {1}
    assert {r.account_id for r in grid.collect()} == {1}
    assert [(r.account_id, r.reason) for r in P.projection_rejects(acc).collect()] == [
        (2, "missing_balance")]


def test_cluster_needs_a_shared_checkpoint_folder():
    """Without ``spark.checkpoint.dir`` only a local master gets a temporary folder."""
    class Context:
        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.master": "spark://host:7077"}.get(key, default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(Session())
