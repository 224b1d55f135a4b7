"""Ledgers derived from the driver's tables (recipes in FIXTURES.md).

Every fixture is a lazy DataFrame over the parquet tables, so the queries
built on it scale with the tables. Joins to ``customer`` are left to the
planner: AQE broadcasts the customer side only when its measured size is
under ``spark.sql.autoBroadcastJoinThreshold``; otherwise it stays a
sort-merge join on the customer key.
"""

from __future__ import annotations

import os
import re
import uuid
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classify import categorize, extract_source
from ..schema import MAPPINGS, conform

# Description vocabulary of the orders ledger, indexed by
# o_orderkey % 24 (FIXTURES.md section 2).
VOCABULARY = [
    "DIRECT DEP Acme Corp Payroll", "Payroll", "Mobile Deposit",
    "Zelle TRANSFER from savings", "XFER in", "Interest payment", "Dividend credit",
    "Refund", "ATM Withdrawal", "Coffee House", "Whole Food Market", "Shell Oil",
    "Las Vegas Hotel", "City Water Utility", "Electric co", "Transfer to broker",
    "Check 1042", "Late fee", "Restaurant 100%", "-Leading dash", "Treatment center",
    "Service charge", "Grocery_Mart", "Misc",
]

# Invented person -> keyword mappings (FIXTURES.md section 3).
MAPPING_ROWS = [
    ("Avery", "payroll"), ("Avery", "direct dep"), ("Blake", "TRANSFER"),
    ("Blake", "xfer"), ("Casey", "refund"), ("Casey", "acme"), ("Drew", "e_d"),
    ("Drew", "Customer#00000001"),
]


_READERS: dict[tuple[int, str], DataFrame] = {}


def cached_reader(spark: SparkSession, path: str, read) -> DataFrame:
    """Reuse the reader DataFrame of an immutable input within a session, so
    its file listing and footer schema are resolved once, not per query."""
    session = getattr(spark, "_jsparkSession", None) or spark
    key = (id(session), path)
    df = _READERS.get(key)
    if df is None:
        df = _READERS[key] = read()
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    return cached_reader(spark, path, lambda: spark.read.parquet(path))


def _money(c):
    return c.cast("decimal(12,2)")


def orders_ledger(spark: SparkSession, sf_dir: str, classify: bool = True) -> DataFrame:
    """The main ledger: one transaction per order, owned by its customer."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    k = F.col("o_orderkey")
    vocab = F.array(*[F.lit(v) for v in VOCABULARY])
    price = _money(F.col("o_totalprice"))
    amount = (
        F.when(k % 97 == 0, _money(F.lit(0)))
        .when((F.col("o_orderstatus") == "F") | ((F.col("o_orderstatus") == "P") & (k % 2 == 1)),
              -price)
        .otherwise(price)
    )
    df = o.join(c, o.o_custkey == c.c_custkey).select(
        k.alias("id"),
        F.col("c_custkey").alias("account_id"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        F.concat(F.element_at(vocab, (k % 24 + 1).cast("int")), F.lit(" - "),
                 F.col("c_name")).alias("description"),
        amount.alias("amount"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(_money(F.col("c_acctbal"))).alias("balance"),
        F.when(k % 7 == 0, F.col("o_orderpriority")).alias("notes"),
    )
    if classify:
        df = df.withColumn("category", categorize(F.col("description"), F.col("amount")))
        df = df.withColumn("source", extract_source(F.col("description"), F.col("amount")))
    return conform(df)


def stored_orders_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders ledger stored once as a month-partitioned table (the way the
    reference keeps transactions in a database table); queries scan it."""
    from . import ledger as L
    here = os.path.dirname(os.path.abspath(__file__))
    pkg = os.path.dirname(here)
    code = [os.path.join(here, "fixtures.py"), os.path.join(here, "ledger.py"),
            os.path.join(pkg, "functions", "classify.py"),
            os.path.join(pkg, "functions", "text.py"), os.path.join(pkg, "schema.py")]
    inputs = [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("orders", "customer")]
    key = L.fingerprint(inputs, code, spark)
    return L.materialize(spark, "orders-ledger", key, lambda: orders_ledger(spark, sf_dir))


def _sql_literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, str):
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return repr(v)


def literal_rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small literal table as an inline ``VALUES`` list: a JVM-side
    ``LocalRelation`` whose exact row count the optimizer knows (no Python
    worker, no job needed to size it)."""
    values = ", ".join("(" + ", ".join(_sql_literal(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")


def mappings(spark: SparkSession) -> DataFrame:
    """The person -> keyword dimension (small; its size is checked before broadcast)."""
    rows = [(i + 1, p, kw) for i, (p, kw) in enumerate(MAPPING_ROWS)]
    return conform(literal_rows(spark, rows, ["id", "person_name", "keyword"]), MAPPINGS)


def events_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short-gap ledger from ``events`` (FIXTURES.md section 4)."""
    e = table(spark, sf_dir, "events")
    neg = F.col("event_type").isin("purchase", "error")
    value = _money(F.col("value"))
    df = e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("account_id"),
        F.col("ts").cast("date").alias("transaction_date"),
        F.concat_ws("", F.col("event_type"), F.lit(" "), F.col("user_id").cast("string"),
                    F.lit("/"), (F.col("event_id") % 5).cast("string")).alias("description"),
        F.when(neg, -value).otherwise(value).alias("amount"),
    )
    return conform(df)


def coarse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger rows with real duplicate keys (FIXTURES.md section 5).

    ``line_no`` carries the input order (``event_id``) used by first-wins dedupe.
    """
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("account_id"),
        F.col("ts").cast("date").alias("transaction_date"),
        F.col("event_type").alias("description"),
        _money(F.round(F.col("value"), 0)).alias("amount"),
        F.col("event_id").alias("line_no"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts with a current balance, from ``customer``."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("account_id"),
                    F.col("c_acctbal").cast("double").alias("current_balance"))


def recurring_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One deposit and one withdrawal item per account (FIXTURES.md section 7)."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    freq = F.element_at(
        F.array(*[F.lit(x) for x in ["weekly", "biweekly", "monthly", "quarterly", "yearly",
                                      "other"]]),
        (k % 6 + 1).cast("int"))
    dep = c.select(k.alias("account_id"), F.lit("deposit").alias("direction"),
                   F.lit("salary").alias("description"),
                   (F.lit(100) + k % 50).cast("double").alias("amount"),
                   freq.alias("frequency"))
    wd = c.select(k.alias("account_id"), F.lit("withdrawal").alias("direction"),
                  F.lit("rent").alias("description"),
                  (-(F.lit(200) + k % 30)).cast("double").alias("amount"),
                  F.lit("monthly").alias("frequency"))
    return dep.unionByName(wd)


# --- statement text rendered from a ledger ----------------------------------

DATE_FORMATS = ["MM/dd/yyyy", "yyyy-MM-dd", "MM-dd-yyyy", "yyyy/MM/dd", "MM/dd/yy", "M/d/yyyy",
                "MMM d, yyyy", "yyyy-MM-dd HH:mm:ss", "yyyyMMdd"]
ACCOUNTS_PER_FILE = 16


def render_date(d, key):
    """Date text in one of several formats chosen by ``key``; day-first
    formats only for days > 12, where they are unambiguous."""
    by_fmt = F.element_at(F.array(*[F.date_format(d, f) for f in DATE_FORMATS]),
                          (key % len(DATE_FORMATS) + 1).cast("int"))
    day_first = F.when(key % 2 == 0, F.date_format(d, "dd/MM/yyyy")) \
        .otherwise(F.date_format(d, "dd-MM-yyyy"))
    return F.when((key % 10 == 9) & (F.dayofmonth(d) > 12), day_first).otherwise(by_fmt)


def render_amount(a, key):
    """Amount text: plain, ``$x``, thousands commas, or ``(x)`` for negatives."""
    plain = a.cast("string")
    return (F.when(key % 4 == 0, plain)
            .when(key % 4 == 1, F.concat(F.lit("$"), plain))
            .when(key % 4 == 2, F.format_number(a, 2))
            .otherwise(F.when(a < 0, F.concat(F.lit("("), (-a).cast("string"), F.lit(")")))
                       .otherwise(plain)))


def _quoted(c):
    return F.concat(F.lit('"'), F.regexp_replace(c, '"', '""'), F.lit('"'))


def statement_lines(ledger: DataFrame) -> DataFrame:
    """(file_key, ord, value) lines of statement files: a preamble, a header,
    then one line per transaction. Every 23rd file has a preamble that looks
    like a header (the file is rejected); every 101st row has a missing date
    and every 103rd an unreadable amount."""
    k = F.col("id")
    file_key = F.floor(F.col("account_id") / ACCOUNTS_PER_FILE)
    date = F.when(k % 101 == 0, F.lit("n/a")).otherwise(render_date(F.col("transaction_date"), k))
    amount = F.when(k % 103 == 0, F.lit("abc")).otherwise(render_amount(F.col("amount"), k))
    line = F.concat_ws(",", _quoted(date), _quoted(F.col("description")), _quoted(amount),
                       F.coalesce(F.col("balance").cast("string"), F.lit("")), k.cast("string"))
    data = ledger.select(file_key.alias("file_key"), k.alias("ord"), line.alias("value"))
    head = ledger.select(file_key.alias("file_key")).distinct().select(
        "file_key", F.explode(F.array(
            F.struct(F.lit(-3).cast("long").alias("ord"),
                     F.when(F.col("file_key") % 23 == 0, F.lit("Last updated today"))
                     .otherwise(F.concat(F.lit("Account,"), F.col("file_key").cast("string")))
                     .alias("value")),
            F.struct(F.lit(-2).cast("long").alias("ord"), F.lit("").alias("value")),
            F.struct(F.lit(-1).cast("long").alias("ord"),
                     F.lit("Transaction Date ,DESCRIPTION,Amount,Balance,Ref").alias("value"))
        )).alias("l")
    ).select("file_key", "l.ord", "l.value")
    return data.unionByName(head)


def write_statements(ledger: DataFrame, out_dir: str) -> str:
    """Write one statement file per group of accounts under ``out_dir``, as ``file_key=<n>.txt`` in
    one of ``FOLDERS`` folders.

    Each file key is hash-partitioned into exactly one task and sorted by line
    order inside it, so the task writes its files one after the other, line by line.
    """
    local = re.sub("^file:/+", "/", out_dir)
    lines = (statement_lines(ledger).repartition("file_key").sortWithinPartitions("file_key", "ord")
             .select("file_key", "value"))
    if "://" in local:          # no mounted folder: a folder a file, by Spark's writer
        lines.write.mode("overwrite").partitionBy("file_key").text(out_dir)
        return out_dir
    os.makedirs(local, exist_ok=True)
    lines.foreachPartition(lambda rows: _write_files(rows, local))
    return out_dir


FOLDERS = 64        # the folders that statement files are dealt over


def _write_files(rows, root: str) -> None:
    """``rows(file_key, value)`` ordered by file -> the files, each in place once it is whole."""
    for key, own in groupby(rows, lambda r: r.file_key):
        folder = os.path.join(root, f"part={int(key) % FOLDERS}")
        os.makedirs(folder, exist_ok=True)
        tmp = os.path.join(folder, f".{key}-{uuid.uuid4().hex}")
        with open(tmp, "w", encoding="utf-8", newline="") as f:
            f.writelines(f"{r.value}\n" for r in own)
        os.replace(tmp, os.path.join(folder, f"file_key={key}.txt"))
