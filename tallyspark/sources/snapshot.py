"""JSON snapshots of the ledger and mappings (K3-K7, S10).

Our snapshot is a folder of JSON-lines tables plus a one-row-per-table
manifest, written and read in parallel. The reference's single JSON document
(``{exported_at, source_db, tables: {t: {count, data: [...]}}}``) is also
readable (``read_document``); a document is one file, so it is parsed by one
task (use it for migration, not as a bulk format).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ingest import import_transactions
from ..operators.maintain import MAPPING_KEY
from .lines import in_order, numbered_lines

SNAPSHOT_TRANSACTIONS = T.StructType([
    T.StructField("transaction_date", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("balance", T.DoubleType()),
    T.StructField("category", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("notes", T.StringType()),
    T.StructField("csv_hash", T.StringType()),
    T.StructField("imported_at", T.StringType()),
])
SNAPSHOT_MAPPINGS = T.StructType([
    T.StructField("person_name", T.StringType()),
    T.StructField("keyword", T.StringType()),
    T.StructField("created_at", T.StringType()),
])
MANIFEST = T.StructType([
    T.StructField("table", T.StringType()),
    T.StructField("count", T.LongType()),
    T.StructField("exported_at", T.StringType()),
    T.StructField("source_db", T.StringType()),
])
DOCUMENT = T.StructType([
    T.StructField("exported_at", T.StringType()),
    T.StructField("source_db", T.StringType()),
    T.StructField("tables", T.StructType([
        T.StructField("transactions", T.StructType([
            T.StructField("count", T.LongType()),
            T.StructField("data", T.ArrayType(SNAPSHOT_TRANSACTIONS))])),
        T.StructField("person_mappings", T.StructType([
            T.StructField("count", T.LongType()),
            T.StructField("data", T.ArrayType(SNAPSHOT_MAPPINGS))])),
    ])),
])

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


@dataclass
class Snapshot:
    transactions: DataFrame   # snapshot columns + row_id (input order)
    mappings: DataFrame       # snapshot columns + row_id
    manifest: DataFrame       # table, count, exported_at, source_db


def _as_snapshot_rows(t: DataFrame) -> DataFrame:
    return t.select(
        F.date_format("transaction_date", "yyyy-MM-dd").alias("transaction_date"),
        "description", F.col("amount").cast("double").alias("amount"),
        F.col("balance").cast("double").alias("balance"), "category", "source", "notes",
        "csv_hash", F.date_format("imported_at", TS_FORMAT).alias("imported_at"))


def export_snapshot(t: DataFrame, m: DataFrame, path: str, source_db: str = "ledger") -> DataFrame:
    """Write transactions (without id, newest first) and mappings (by person,
    keyword) as JSON lines, then a manifest with per-table counts. The counts
    are taken from the written files, so they describe exactly what was
    exported. Returns the manifest DataFrame."""
    spark = t.sparkSession
    rows = _as_snapshot_rows(t)
    # Global order as the reference writes it: part files follow the range
    # partitions of the sort, newest transactions first.
    rows.orderBy(F.desc("transaction_date"), "description", "amount").write.mode(
        "overwrite").json(f"{path}/transactions")
    m.select("person_name", "keyword",
             F.date_format("created_at", TS_FORMAT).alias("created_at")) \
        .orderBy("person_name", "keyword").write.mode("overwrite").json(
            f"{path}/person_mappings")
    written_t = spark.read.schema(SNAPSHOT_TRANSACTIONS).json(f"{path}/transactions")
    written_m = spark.read.schema(SNAPSHOT_MAPPINGS).json(f"{path}/person_mappings")
    stamp = F.date_format(F.current_timestamp(), TS_FORMAT)
    manifest = written_t.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit("transactions").alias("table"), "count").unionByName(
        written_m.agg(F.count(F.lit(1)).alias("count")).select(
            F.lit("person_mappings").alias("table"), "count")).select(
        "table", "count", stamp.alias("exported_at"), F.lit(source_db).alias("source_db"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def _table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a folder of JSON lines with ``row_id``, their position in the table: files in the order
    of their names, lines in the order of each file. Blank lines are no rows, but are counted."""
    lines = in_order(numbered_lines(spark, path, "*.json")).where(F.trim("line") != "")
    return lines.select(F.from_json("line", schema).alias("r"), "row_id").select("r.*", "row_id")


def read_snapshot(spark: SparkSession, path: str) -> Snapshot:
    """Read a snapshot folder with fixed schemas (no inference)."""
    man = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    return Snapshot(_table(spark, f"{path}/transactions", SNAPSHOT_TRANSACTIONS),
                    _table(spark, f"{path}/person_mappings", SNAPSHOT_MAPPINGS), man)


def read_document(spark: SparkSession, path: str) -> Snapshot:
    """Read snapshot documents in the single-JSON-document format; ``row_id``
    is the position inside the document's array."""
    doc = spark.read.schema(DOCUMENT).option("multiLine", True).json(path)
    t = doc.select(F.posexplode("tables.transactions.data").alias("row_id", "r")).select(
        "r.*", F.col("row_id").cast("long"))
    m = doc.select(F.posexplode("tables.person_mappings.data").alias("row_id", "r")).select(
        "r.*", F.col("row_id").cast("long"))
    man = doc.select(
        F.explode(F.array(
            F.struct(F.lit("transactions").alias("table"),
                     F.col("tables.transactions.count").alias("count")),
            F.struct(F.lit("person_mappings").alias("table"),
                     F.col("tables.person_mappings.count").alias("count")))).alias("x"),
        "exported_at", "source_db").select("x.table", "x.count", "exported_at", "source_db")
    return Snapshot(t, m, man)


def validate_snapshot(snap: Snapshot) -> DataFrame:
    """Dry run: rows missing a required field, as (table, index, reason); ``index`` is
    the row's position in its table, from 0.

    Transactions need a date and a description, mappings a person and a
    keyword; NULL and empty text both count as missing."""
    def missing(c):
        return F.col(c).isNull() | (F.col(c) == "")

    t = snap.transactions.select(
        F.lit("transactions").alias("table"), F.col("row_id").alias("index"),
        F.when(missing("transaction_date"), "missing_transaction_date")
        .when(missing("description"), "missing_description").alias("reason"))
    m = snap.mappings.select(
        F.lit("person_mappings").alias("table"), F.col("row_id").alias("index"),
        F.when(missing("person_name"), "missing_person_name")
        .when(missing("keyword"), "missing_keyword").alias("reason"))
    return t.unionByName(m).filter(F.col("reason").isNotNull())


def snapshot_to_ledger(snap_t: DataFrame) -> DataFrame:
    """Snapshot rows -> typed ledger rows; a missing ``imported_at`` becomes now."""
    return snap_t.select(
        F.to_date("transaction_date").alias("transaction_date"), "description",
        F.col("amount").cast("decimal(12,2)").alias("amount"),
        F.col("balance").cast("decimal(12,2)").alias("balance"), "category", "source", "notes",
        "csv_hash",
        F.coalesce(F.to_timestamp("imported_at"), F.current_timestamp()).alias("imported_at"),
        "row_id")


def import_snapshot(existing_t: DataFrame, existing_m: DataFrame, snap: Snapshot):
    """Load a snapshot into stored tables, skipping duplicates.

    Returns ``(new_transactions, new_mappings, counts)``; ``counts`` has one row
    per table: (table, incoming, inserted, skipped). Duplicates are skipped one
    by one (never a rollback of earlier rows)."""
    t_in = snapshot_to_ledger(snap.transactions)
    t_res = import_transactions(existing_t, t_in, ["row_id"])
    m_in = snap.mappings.select(
        "person_name", "keyword",
        F.coalesce(F.to_timestamp("created_at"), F.current_timestamp()).alias("created_at"),
        "row_id")
    m_first = m_in.groupBy(*MAPPING_KEY).agg(
        F.min_by("created_at", "row_id").alias("created_at"))
    m_new = m_first.join(existing_m.select(*MAPPING_KEY), MAPPING_KEY, "left_anti")
    m_counts = m_in.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("incoming").alias("k"), "n").unionByName(
        m_new.agg(F.count(F.lit(1)).alias("n")).select(F.lit("inserted").alias("k"), "n")
    ).agg(F.sum(F.when(F.col("k") == "incoming", F.col("n"))).cast("bigint").alias("incoming"),
          F.sum(F.when(F.col("k") == "inserted", F.col("n"))).cast("bigint").alias("inserted"))
    counts = t_res.counts.select(F.lit("transactions").alias("table"), "incoming", "inserted",
                                 "skipped").unionByName(
        m_counts.select(F.lit("person_mappings").alias("table"), "incoming", "inserted",
                        (F.col("incoming") - F.col("inserted")).alias("skipped")))
    return t_res.new.drop("row_id"), m_new, counts


def verify_counts(t: DataFrame, m: DataFrame, manifest: DataFrame) -> DataFrame:
    """Row counts of loaded tables against the manifest: (table, expected, actual, ok)."""
    actual = t.agg(F.count(F.lit(1)).alias("actual")).select(
        F.lit("transactions").alias("table"), "actual").unionByName(
        m.agg(F.count(F.lit(1)).alias("actual")).select(
            F.lit("person_mappings").alias("table"), "actual"))
    return manifest.select("table", F.col("count").alias("expected")).join(
        actual, "table", "full").select(
        "table", "expected", "actual",
        F.coalesce(F.col("expected") == F.col("actual"), F.lit(False)).alias("ok"))


def existing_counts(t: DataFrame, m: DataFrame) -> DataFrame:
    """Stored row counts before an import: (existing_transactions, existing_mappings)."""
    stacked = t.agg(F.count(F.lit(1)).alias("n")).select(F.lit("t").alias("k"), "n") \
        .unionByName(m.agg(F.count(F.lit(1)).alias("n")).select(F.lit("m").alias("k"), "n"))
    return stacked.agg(
        F.sum(F.when(F.col("k") == "t", F.col("n"))).cast("bigint").alias("existing_transactions"),
        F.sum(F.when(F.col("k") == "m", F.col("n"))).cast("bigint").alias("existing_mappings"))
