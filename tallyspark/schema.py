"""Fixed schemas of the ledger tables and the output edge conversion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)

TRANSACTIONS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("account_id", T.LongType(), True),
    T.StructField("transaction_date", T.DateType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("amount", MONEY, False),
    T.StructField("balance", MONEY, True),
    T.StructField("category", T.StringType(), True),
    T.StructField("source", T.StringType(), True),
    T.StructField("notes", T.StringType(), True),
    T.StructField("csv_hash", T.StringType(), True),
    T.StructField("imported_at", T.TimestampType(), True),
])

MAPPINGS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("person_name", T.StringType(), False),
    T.StructField("keyword", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), True),
])

RECURRING_ITEMS = T.StructType([
    T.StructField("account_id", T.LongType(), True),
    T.StructField("direction", T.StringType(), False),   # deposit / withdrawal
    T.StructField("description", T.StringType(), True),
    T.StructField("amount", T.DoubleType(), True),
    T.StructField("frequency", T.StringType(), True),
])

ACCOUNTS = T.StructType([
    T.StructField("account_id", T.LongType(), True),
    T.StructField("current_balance", T.DoubleType(), True),
])

CORRECTIONS = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("changes", T.MapType(T.StringType(), T.StringType(), True), True),
])

REJECTS = T.StructType([
    T.StructField("path", T.StringType(), True),
    T.StructField("line_no", T.IntegerType(), True),
    T.StructField("raw", T.StringType(), True),
    T.StructField("reason", T.StringType(), False),
])

LEDGER_COLUMNS = [f.name for f in TRANSACTIONS.fields]


def conform(df: DataFrame, schema: T.StructType = TRANSACTIONS) -> DataFrame:
    """Select the schema's columns in order, casting, adding missing as NULL."""
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in have else F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    return df.select(*cols)


def money_out(df: DataFrame, dates_as_text: bool = False) -> DataFrame:
    """Output edge: decimals -> double; optionally dates/timestamps -> ISO text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif dates_as_text and isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif dates_as_text and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        cols.append(c.alias(f.name))
    return df.select(*cols)
