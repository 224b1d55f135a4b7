"""The reference-style facade returns the same answers as the operators."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from tallyspark.api import Ledger
from tallyspark.session import shared_dir
from tallyspark.sources import fixtures as FX


def test_facade_calls(spark):
    t = FX.orders_ledger(spark, SF_SMALL)
    led = Ledger(spark, t, FX.mappings(spark))
    assert led.get_transaction_count().first()[0] == t.count()
    assert led.get_all_transactions(limit=5).count() == 5
    stats = led.get_statistics("1997-01-01", "1997-12-31")
    assert stats.overall.first().total_transactions == t.filter(
        "transaction_date between '1997-01-01' and '1997-12-31'").count()
    months = [r.month for r in stats.monthly_breakdown.collect()]
    assert months == sorted(months, reverse=True)
    by_person, monthly = led.get_contribution_statistics()
    totals = [r.total for r in by_person.collect()]
    assert totals == sorted(totals, reverse=True) and monthly.count() > 0
    assert led.get_person_mappings().count() == 8
    fixed = led.update_transactions(spark.createDataFrame(
        [(t.first().id, {"notes": "checked"})], "id long, changes map<string,string>"))
    assert fixed.transactions.filter(F.col("notes") == "checked").count() == 1


def test_facade_import_twice_is_idempotent(spark):
    t = FX.orders_ledger(spark, SF_SMALL)
    d = FX.write_statements(t, shared_dir(spark, "api-st"))
    empty = Ledger(spark, t.limit(0), FX.mappings(spark))
    once, counts, _ = empty.import_csv(d, glob="*.txt")
    assert once.transactions.filter(F.col("id").isNull()).count() == 0
    c1 = counts.first()
    assert c1.inserted > 0 and c1.inserted + c1.skipped == c1.incoming
    _, counts2, _ = once.import_csv(d, glob="*.txt")
    assert counts2.first().inserted == 0
