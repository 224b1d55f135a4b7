"""Stored partial aggregates and pages at any depth, held against full scans."""

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import functions as F

from tallyspark.operators import paging as G
from tallyspark.operators import partials as A
from tallyspark.operators import query as Q
from tallyspark.operators import recurring as R
from tallyspark.operators import stats as S
from tallyspark.sources.ledger import read_ledger, write_ledger

SCHEMA = ("id long, account_id long, transaction_date date, description string, "
          "amount decimal(12,2), category string, source string")


def _rows(seed, n, first_id=0, days=400, id_of=None):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        day = None if rnd.random() < 0.03 else dt.date(2023, 1, 1) + dt.timedelta(rnd.randrange(days))
        cents = None if rnd.random() < 0.02 else Decimal(rnd.randrange(-90000, 90000)) / 100
        out.append((id_of(rnd) if id_of else first_id + i, rnd.randrange(4), day,
                    rnd.choice(["rent", "pay", "tea", None]), cents,
                    rnd.choice(["Dining", "Income", None]), rnd.choice(["Transfer", None, "Other"])))
    return out


def _same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    def key(df):
        return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    assert key(a) == key(b)


def _check(spark, path, ledger, keys):
    cells = A.read(spark, path, "cells", ledger, keys)
    groups = A.read(spark, path, "groups", ledger, keys)
    _same(S.fold_cells(cells, keys), S.statistics_one_pass(ledger, keys=keys))
    _same(A.overall(cells, keys), S.overall(ledger, keys=keys))
    _same(A.monthly(cells, keys), S.monthly(ledger, keys=keys))
    _same(A.deposits_by_source(cells, keys), S.deposits_by_source(ledger, keys=keys))
    _same(A.by_category(cells, keys), S.by_category(ledger, keys=keys))
    _same(A.recurring(groups, 2, keys), S.recurring(ledger, 2, keys=keys))
    _same(A.analyze_recurring(groups, 2, keys), R.analyze_recurring(ledger, 2, keys=keys))


def test_partials_equal_full_scans_after_imports_and_deletions(spark, tmp_path):
    old = spark.createDataFrame(_rows(1, 500), SCHEMA)
    new = spark.createDataFrame(_rows(2, 60, 500, days=70), SCHEMA)
    for keys in ([], ["account_id"]):
        path = str(tmp_path / f"p{len(keys)}")
        A.write(old, path, keys)
        whole = old.unionByName(new)
        months = A.refresh(whole, path, new, keys)
        assert None in months and "2023-01" in months and "2023-12" not in months
        A.refresh(whole, path, new, keys)                                  # a replay
        _check(spark, path, whole, keys)
        gone = whole.filter("date_format(transaction_date, 'yyyy-MM') = '2023-02'")
        kept = whole.filter("transaction_date is null or "
                            "date_format(transaction_date, 'yyyy-MM') <> '2023-02'")
        assert A.refresh(kept, path, gone, keys) == ["2023-02"]            # a month without rows
        _check(spark, path, kept, keys)
        assert A.refresh(kept, path, new.filter("false"), keys) == []


def test_partials_of_an_empty_ledger(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    A.write(none, str(tmp_path / "p"))
    _check(spark, str(tmp_path / "p"), none, [])


def test_ranges_take_whole_months_from_the_table(spark, tmp_path):
    ledger = spark.createDataFrame(_rows(3, 600), SCHEMA)
    path = str(tmp_path / "p")
    A.write(ledger, path)
    cells = A.read(spark, path, "cells", ledger)
    for start, end in [(None, None), ("2023-02-01", "2023-05-31"), ("2023-02-10", "2023-05-30"),
                       ("2023-03-05", "2023-03-20"), (None, "2023-12-31"), ("2023-12-31", None),
                       ("2023-02-28", "2023-03-01"), ("2023-06-01", "2023-05-01"),
                       ("0001-01-01", "9999-12-31")]:
        got = A.cells_between(cells, ledger, start, end)
        _same(S.fold_cells(got), S.statistics_one_pass(ledger, start, end))


def test_a_refresh_reads_only_the_changed_months(spark, tmp_path):
    write_ledger(spark.createDataFrame(_rows(4, 300), SCHEMA).withColumn("balance", F.lit(None).cast("decimal(12,2)"))
                 .withColumn("notes", F.lit(None).cast("string")), str(tmp_path / "led"))
    led = read_ledger(spark, str(tmp_path / "led"))
    rows = led.filter(A._in_months(Q.ledger_month(led), ["2023-03"]))
    assert "PartitionFilters: [isnotnull(month" in rows._jdf.queryExecution().toString()


def _pages(spark, df, n, seed, **kw):
    want = [tuple(r) for r in Q.list_page(df, 0).select("transaction_date", "id").collect()]
    rnd = random.Random(seed)
    for offset in [0, 1, n // 2, n - 3, n, n + 5] + [rnd.randrange(n) for _ in range(4)]:
        limit = rnd.choice([1, 7, 40])
        got = [tuple(r) for r in G.page_at(df, limit, offset, **kw)
               .select("transaction_date", "id").collect()]
        assert got == want[offset:offset + limit], (offset, limit)


def test_pages_at_any_depth(spark):
    df = spark.createDataFrame(_rows(5, 400), SCHEMA).cache()
    index = G.day_counts(df).cache()
    _pages(spark, df, 400, 1, index=index, near=0)
    _pages(spark, df, 400, 2, near=5)


def test_pages_inside_one_day_by_ranges_of_ids(spark):
    edge = [-(1 << 63), (1 << 63) - 1, 0, -1, None, None, 7, 7, 7]
    rows = _rows(6, 3000, days=1, id_of=lambda r: r.choice(
        edge + [r.randrange(-(1 << 63), 1 << 63), r.randrange(5000)]))
    df = spark.createDataFrame(rows, SCHEMA).cache()
    _pages(spark, df, 3000, 3, index=G.day_counts(df).cache(), near=0)
    none = df.filter("false")
    assert G.page_at(none, 5, 20_000).count() == 0


def test_a_deep_page_reads_one_month_of_a_stored_ledger(spark, tmp_path):
    src = (spark.createDataFrame(_rows(7, 800), SCHEMA)
           .withColumn("balance", F.lit(None).cast("decimal(12,2)"))
           .withColumn("notes", F.lit(None).cast("string")))
    write_ledger(src, str(tmp_path / "led"))
    led = read_ledger(spark, str(tmp_path / "led"))
    page = G.page_at(led, 5, 400, near=0)
    months = {r.month for r in page.select("month").collect()}
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and all(m in plan for m in months)
    want = [r.id for r in Q.list_page(led, 5, 400).collect()]
    assert [r.id for r in page.collect()] == want


def test_numbered_places_follow_the_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v")).orderBy(F.desc("v"))
    got = G.numbered(df).collect()
    ranked = sorted((r.v for r in got), reverse=True)
    assert {r.place: r.v for r in got} == {i + 1: v for i, v in enumerate(ranked)}
    assert G.numbered(df.filter("v < 0")).count() == 0
