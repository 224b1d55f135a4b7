"""The stored ledger table: Parquet partitioned by ``month`` (S8).

Writing uses the ``rebalance`` hint on ``month``: AQE splits a heavy month
over several tasks and merges light ones, so one busy month does not become
one task or one huge file, and quiet months do not become many tiny files.
Files are sorted by account and date inside each month, so Parquet min/max
statistics prune row groups for account and date filters; ``query.date_range``
adds the month bounds that turn date filters into ``PartitionFilters``.

``materialize`` stores a derived ledger once in the shared checkpoint folder
(keyed by a fingerprint of its inputs and of the code that derives it). The
table is written to a temporary folder and renamed into place, so a job that
dies half-way never leaves a partial table behind.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import month_key
from ..schema import TRANSACTIONS
from ..session import checkpoint_root


def write_ledger(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Month partitions; inside them rows are sorted by account, then date, so
    row-group statistics skip data for single-account and date-range reads."""
    out = df.withColumn("month", month_key(F.col("transaction_date")))
    order = [c for c in ("account_id", "transaction_date", "id") if c in out.columns]
    (out.hint("rebalance", "month").sortWithinPartitions("month", *order)
     .write.mode(mode).partitionBy("month").parquet(path))


LEDGER_SCHEMA = T.StructType(TRANSACTIONS.fields + [T.StructField("month", T.StringType())])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Read with the fixed schema (no partition type inference)."""
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def _fs_and_path(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        fs, p = _fs_and_path(spark, path)
        return bool(fs.exists(p))
    except AttributeError:      # Spark Connect: no JVM handle; probe with a read
        try:
            spark.read.text(path).limit(1).collect()
            return True
        except Exception:
            return False


def _rename(spark: SparkSession, src: str, dst: str) -> bool:
    try:
        fs, s = _fs_and_path(spark, src)
        _, d = _fs_and_path(spark, dst)
        return bool(fs.rename(s, d))
    except AttributeError:      # Spark Connect: rewrite into place instead
        read_ledger(spark, src).write.mode("overwrite").partitionBy("month").parquet(dst)
        return True


def _signature(spark: SparkSession | None, path: str) -> str:
    """Size, file count and modification time of a file or folder, read
    through the cluster's file system (HDFS, object stores, local)."""
    try:
        fs, p = _fs_and_path(spark, path)
        summary = fs.getContentSummary(p)
        mtime = fs.getFileStatus(p).getModificationTime()
        return f"{path}:{summary.getLength()}:{summary.getFileCount()}:{mtime}"
    except Exception:
        try:
            st = os.stat(path)
            return f"{path}:{st.st_size}:{int(st.st_mtime)}"
        except OSError:
            return path


def fingerprint(inputs: list[str], code_files: list[str],
                spark: SparkSession | None = None) -> str:
    """Hash of the inputs' sizes/mtimes and of the deriving code."""
    h = hashlib.sha256()
    for path in inputs:
        h.update(_signature(spark, path).encode())
    for path in code_files:
        with open(path, "rb") as fh:
            h.update(fh.read())
    return h.hexdigest()[:20]


def materialize(spark: SparkSession, name: str, key: str,
                build: Callable[[], DataFrame]) -> DataFrame:
    """Read ``name``/``key`` from the shared folder, writing it first if absent."""
    root = checkpoint_root(spark).rstrip("/")
    final = f"{root}/tallyspark/tables/{name}-{key}"
    if not _exists(spark, f"{final}/_SUCCESS"):
        tmp = f"{final}.tmp-{uuid.uuid4().hex[:8]}"
        write_ledger(build(), tmp)
        if not _rename(spark, tmp, final) and not _exists(spark, f"{final}/_SUCCESS"):
            raise RuntimeError(f"could not publish {final}")
    from .fixtures import cached_reader   # published tables are immutable
    return cached_reader(spark, final, lambda: read_ledger(spark, final))
