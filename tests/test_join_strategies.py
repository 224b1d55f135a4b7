"""The n-gram keyword join returns exactly the inline plan's pairs."""

import datetime as dt
import random
from decimal import Decimal

import pytest

from tallyspark.operators import contrib as C
from tallyspark.plans.inspect import plan_text


def _random_text(rnd, alphabet, lo, hi):
    return "".join(rnd.choice(alphabet) for _ in range(rnd.randint(lo, hi)))


@pytest.mark.parametrize("seed", [3, 5, 8, 13])
def test_random_keywords_same_pairs(spark, seed):
    rnd = random.Random(seed)
    alphabet = "abcAB -_%\\"
    descs = [(i, dt.date(2024, 1, 1), _random_text(rnd, alphabet, 0, 12), Decimal("1.00"), None)
             for i in range(400)]
    t = spark.createDataFrame(descs, "id long, transaction_date date, description string, "
                                     "amount decimal(12,2), balance decimal(12,2)")
    kws = set()
    while len(kws) < 60:
        kws.add(_random_text(rnd, "abAB_%\\ ", 1, 5))
    m = spark.createDataFrame([(i, f"P{i % 7}", k) for i, k in enumerate(sorted(kws))],
                              "id long, person_name string, keyword string")
    a = sorted((r.id, r.person_name, r.keyword)
               for r in C.keyword_matches(t, m, "inline").collect())
    b = sorted((r.id, r.person_name, r.keyword)
               for r in C.keyword_matches(t, m, "ngram").collect())
    assert len(a) > 100
    assert a == b


def test_repeated_mappings_count_alike(spark):
    """A mapping listed twice matches twice, whichever plan is chosen."""
    t = spark.createDataFrame(
        [(1, dt.date(2024, 1, 1), "rent from AVERY", Decimal("10.01"), None),
         (2, dt.date(2024, 1, 2), "other", Decimal("5.00"), None)],
        "id long, transaction_date date, description string, "
        "amount decimal(12,2), balance decimal(12,2)")
    m = spark.createDataFrame([(1, "P", "avery"), (2, "P", "avery"), (3, "P", "%%"), (4, "P", "%%")],
                              "id long, person_name string, keyword string")
    got = [sorted((r.id, r.person_name, r.keyword) for r in C.keyword_matches(t, m, s).collect())
           for s in ("inline", "ngram")]
    assert got[0] == got[1] == sorted([(1, "P", "avery")] * 2 + [(1, "P", "%%"), (2, "P", "%%")] * 2)


def _ledger(spark, tmp_path):
    t = spark.range(200).selectExpr(
        "id", "DATE'2024-01-01' AS transaction_date", "concat('Payroll - Customer#', lpad(id, 9, '0')) AS description",
        "CAST(1 AS decimal(12,2)) AS amount", "CAST(NULL AS decimal(12,2)) AS balance")
    t.write.parquet(str(tmp_path / "t"))
    return spark.read.parquet(str(tmp_path / "t"))


def test_no_description_gram_is_broadcast(spark, tmp_path):
    """Size estimates leave out the explode: a large dimension's plan broadcasts nothing, whatever they are."""
    t = _ledger(spark, tmp_path)
    n = C.BROADCAST_MAX_KEYWORDS + 1
    m = spark.range(n).selectExpr("'P' AS person_name", "concat('customer#', lpad(id, 9, '0')) AS keyword")
    df = C.totals(t, m)
    assert "BroadcastExchange" not in plan_text(df, "simple")
    assert [tuple(r) for r in df.collect()] == [("P", 200.0, 200)]


def test_small_dimension_moves_no_description_gram(spark, tmp_path):
    t = _ledger(spark, tmp_path)
    m = spark.createDataFrame([("P", "payroll"), ("Q", "0017"), ("Q", "c_stomer")], "person_name string, keyword string")
    for df in (C.contributions(t, m, strategy="ngram"), C.totals(t, m, strategy="ngram")):
        joins = [x for x in plan_text(df, "simple").splitlines() if "Join [gram" in x]
        assert any("BroadcastHashJoin" in x and "BuildRight" in x for x in joins)
    assert {tuple(r) for r in C.totals(t, m, strategy="ngram").collect()} == {("P", 200.0, 200), ("Q", 211.0, 200)}


def test_copies_of_a_mapping_are_counted_not_listed(spark, tmp_path):
    t = _ledger(spark, tmp_path)
    m = spark.range(3000).selectExpr("'P' AS person_name", "concat('customer#', lpad(id % 3, 9, '0')) AS keyword")
    got = {(r.id, r.hits) for r in C.per_row_person(t, m).collect()}
    assert got == {(0, 1000), (1, 1000), (2, 1000)}
    assert C.profile(m).ngram_lengths == (16,)      # two thirds of a literal at least, not 3 letters of it
