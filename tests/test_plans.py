"""Plan-shape tests: no Python on any path, broadcast where expected,
filters pushed into the scan, partition pruning on a month-partitioned ledger."""

import tempfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from tallyspark.functions.calendar import month_key
from tallyspark.operators import contrib as C
from tallyspark.operators import query as Q
from tallyspark.plans.catalog import QUERIES
from tallyspark.plans.inspect import count_nodes, plan_text, python_nodes
from tallyspark.sources import fixtures as FX

# Queries that perform writes while being built are planned separately.
WRITING = {"statement_ingest", "statement_rejects", "statement_import", "stream_ingest",
           "snapshot_roundtrip", "snapshot_validation", "snapshot_counts", "snapshot_import"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_in_plan(spark, name):
    df = QUERIES[name][0](spark, SF_SMALL)
    assert python_nodes(df) == []


def test_small_mappings_move_no_ledger_row(spark):
    """Pairs and first matches need no join and no shuffle; totals one shuffle of their sums."""
    t, m = FX.orders_ledger(spark, SF_SMALL), FX.mappings(spark)
    own = {n: count_nodes(t, n) for n in ("Join", "Exchange")}          # the fixture's customer join
    for df in (C.keyword_matches(t.filter("amount > 0"), m), C.contributions(t, m), C.per_row_person(t, m)):
        assert count_nodes(df, "Join") == own["Join"] and count_nodes(df, "Exchange") == own["Exchange"]
        assert count_nodes(df, "Aggregate") == 0
    for df in (C.totals(t, m), C.monthly_totals(t, m), C.month_person(t, m)):
        assert count_nodes(df, "Join") == own["Join"] and count_nodes(df, "SortAggregate") == 0
        assert count_nodes(df, "Exchange") == own["Exchange"] + 1


def test_large_mappings_are_never_inlined(spark):
    m = spark.range(C.INLINE_MAX_KEYWORDS + 1).selectExpr("id", "'P' AS person_name", "concat('k', id) AS keyword")
    assert C.tests(m, "inline") is None and len(C.tests(m.limit(5))) == 5


def test_strategy_choice(spark):
    prof = C.profile(FX.mappings(spark))
    assert C.choose_strategy(prof) == "inline"
    big = C.MappingProfile(rows=C.INLINE_MAX_KEYWORDS + 1, bytes=0, ngram_lengths=(3,),
                           wildcard_only=0, max_underscores=0)
    assert C.choose_strategy(big) == "ngram"


def test_date_filter_pushed_to_scan(spark):
    o = FX.table(spark, SF_SMALL, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date")
        .alias("transaction_date"))
    text = plan_text(Q.date_range(o, "1997-01-01", "1997-12-31"), "formatted")
    assert "PushedFilters: [IsNotNull(o_orderdate)" in text


def test_partition_pruning_on_month(spark):
    path = tempfile.mkdtemp(prefix="ledger-")
    t = FX.orders_ledger(spark, SF_SMALL).withColumn("month", month_key(F.col("transaction_date")))
    t.write.mode("overwrite").partitionBy("month").parquet(path)
    stored = spark.read.parquet(path)
    df = Q.search(stored, start="1997-02-01", end="1997-03-31")
    text = plan_text(df, "formatted")
    assert "PartitionFilters: [isnotnull(month" in text
    assert df.count() == t.filter("transaction_date between '1997-02-01' and '1997-03-31'").count()


def test_column_pruning(spark):
    df = Q.latest_date(FX.orders_ledger(spark, SF_SMALL))
    text = plan_text(df, "formatted")
    assert "ReadSchema: struct<o_custkey:bigint,o_orderdate:timestamp_ntz>" in text
    assert "ReadSchema: struct<c_custkey:bigint>" in text


def test_statement_lines_meet_their_files_without_moving(spark):
    """The stored file table is broadcast; without a quoted line break the only window is that of the
    splits' line counts, and lines are not grouped."""
    from tallyspark.session import shared_dir
    from tallyspark.sources import statements as ST
    d = FX.write_statements(FX.orders_ledger(spark, SF_SMALL), shared_dir(spark, "plan-st"))
    text = plan_text(ST.parse_statement_files(spark, d, "*.txt"), "simple")
    assert "BroadcastHashJoin [path" in text
    assert "collect_list" not in text and "chunk" not in text


def test_import_reads_stored_keys_for_batch_span_only(spark):
    from tallyspark.operators import ingest as I
    from tallyspark.sources import ledger as L
    path = tempfile.mkdtemp(prefix="stored-")
    L.write_ledger(FX.orders_ledger(spark, SF_SMALL), path)
    stored = L.read_ledger(spark, path)
    batch = FX.orders_ledger(spark, SF_SMALL).filter(
        "transaction_date between '1997-03-01' and '1997-03-31'")
    res = I.import_transactions(stored, batch, ["id"])
    text = plan_text(res.new, "formatted")
    assert "PartitionFilters: [isnotnull(month" in text and "1997-03" in text
    assert res.counts.first().inserted == 0


def test_import_evaluates_its_batch_once(spark):
    """New rows and counts are read from the folded batch, whose input is not scanned again."""
    from tallyspark.operators import ingest as I
    batch = FX.coarse_events(spark, SF_SMALL)
    res = I.import_transactions(batch.limit(0), batch.withColumn("n_rows", F.lit(None)), ["line_no"])
    for df in (res.new, res.counts):
        text = plan_text(df, "formatted")
        assert "import-batch" in text and "events.parquet" not in text
    assert "n_rows" in res.new.columns
    c = res.counts.first()
    assert c.incoming == batch.count() and c.inserted == res.new.count() and c.skipped > 0


def test_small_batch_does_not_move_the_stored_ledger(spark):
    from tallyspark.operators import ingest as I
    t = FX.orders_ledger(spark, SF_SMALL)
    few = t.filter("id % 10 = 0").localCheckpoint()
    text = plan_text(I.stored_keys(t, few), "simple")
    assert "LeftSemi, BuildRight" in text
    assert I.stored_keys(t, few).distinct().count() == few.select(*I.KEY).distinct().count()


def test_small_batch_is_not_moved_for_a_large_ledger(spark):
    """The stored keys that it meets, each once, are broadcast: no shuffle of the batch, no file a task of it."""
    from tallyspark.operators import ingest as I
    t = FX.orders_ledger(spark, SF_SMALL)
    few = t.filter("id % 10 = 0").withColumn("line_no", F.col("id")).localCheckpoint()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        twice = t.filter("id % 20 = 0")
        res = I.import_transactions(twice.unionByName(twice), few, ["line_no"])
        text = plan_text(res.new, "simple")
        assert "LeftAnti, BuildRight" in text and "SortMergeJoin" not in text.split("LeftAnti")[0]
        want = few.filter("id % 20 != 0").select(*I.KEY).distinct().join(twice.select(*I.KEY), I.KEY, "left_anti")
        assert res.new.select(*I.KEY).exceptAll(want).count() == 0
        assert res.new.count() == want.count() == res.counts.first().inserted
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_parsers_work_out_each_text_once(spark):
    """Repeated subexpressions had made one projection of all parsers too large to compile."""
    from tallyspark.functions import parse as PF
    df = spark.createDataFrame([("(1.5)",)], "a string")
    assert plan_text(df.select(PF.parse_amount(F.col("a"))), "simple").count("trim(") <= 2
    assert str(df.select(PF.parse_balance(F.col("a"))).first()[0].value) == "-1.50"
