"""Incremental, idempotent import of statement files as they arrive (I2).

A Structured Streaming file source (``binaryFile``) picks up new files; each
micro-batch is parsed with the batch reader's plan and imported with the
batch import (first row per key wins, stored keys are skipped). No streaming
state is kept: cross-batch dedupe is the anti join against the stored ledger,
so state cannot grow without bound and late files are still accepted.

The batch's file names go to the split reader, whatever the files' sizes, so no
file is read or parsed by one task. 0-byte files, which no batch returns, are
listed from the folder's metadata and rejected once. That listing is of the whole folder:
it is made once in a run over a backlog, and at most once a minute by a stream that stays up.

What a batch costs follows its own files: it writes one file a month, and of the stored
ledger only the keys are scanned (``stored_keys``), without moving them. A batch's keys are
written once more in few files under ``ledger_keys``, as the ledger has a file a month and
batch, whose opening costs more than their keys. They count only while the batch's ledger folder is
as it was when they were written (its size, number of files and time); else it is read itself.

Replay safety: batch ``b`` writes only to ``ledger/batch_id=b`` (overwrite)
and dedupes against every *other* batch folder, so re-running a batch after a
failure rewrites the same rows instead of skipping them as "already stored".
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.calendar import month_key
from ..operators.ingest import KEY, import_transactions
from ..sources.ledger import _exists, _fs_and_path, fingerprint
from ..sources.statements import CLEAN_COLUMNS, empty_files, parse_statement_files, split_parsed

LEDGER_COLUMNS = CLEAN_COLUMNS + ["imported_at"]
LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LIST_SECONDS = 60         # least time between two listings of a folder by one stream
KEY_SCHEMA = "transaction_date date, description string, amount decimal(12,2), month string"
BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def read_ledger(spark: SparkSession, ledger_dir: str) -> DataFrame:
    """The imported ledger (partition columns ``batch_id`` and ``month``)."""
    return spark.read.parquet(ledger_dir)


def _stored(spark: SparkSession, ledger_dir: str, batch_id: int) -> DataFrame | None:
    try:
        led = spark.read.parquet(ledger_dir)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None                                # nothing written yet
    return led.filter(F.col("batch_id") != F.lit(batch_id))


def _keys_of(spark: SparkSession, ledger_dir: str, batch_id: int) -> str:
    """Where the keys of a batch are, as long as its ledger folder stays what it is now."""
    sign = fingerprint([f"{ledger_dir}/batch_id={batch_id}"], [], spark)
    return f"{ledger_dir}_keys/batch_id={batch_id}/of={sign}"


def _key_folders(spark: SparkSession, ledger_dir: str) -> dict[int, str | None]:
    """The folder with the keys of each batch of the ledger; None where it is to be read itself."""
    fs, p = _fs_and_path(spark, f"{ledger_dir}/batch_id=*")
    at = {}
    for s in fs.globStatus(p) or []:
        b = int(s.getPath().getName().split("=")[1])
        keys = _keys_of(spark, ledger_dir, b)
        at[b] = keys if _exists(spark, f"{keys}/_SUCCESS") else None
    return at


def _stored_keys(spark: SparkSession, ledger_dir: str, folders: dict[int, str | None]) -> DataFrame | None:
    """``KEY`` and ``month`` of the rows of the batches in ``folders``; None where there are none."""
    parts = []
    if keys := [k for k in folders.values() if k]:
        parts.append(spark.read.schema(KEY_SCHEMA).parquet(*keys))
    if rest := [f"{ledger_dir}/batch_id={b}" for b, k in folders.items() if not k]:
        try:
            parts.append(spark.read.option("basePath", ledger_dir).parquet(*rest).select(*KEY, "month"))
        except AnalysisException as e:
            if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":      # batches without rows
                raise
    return reduce(DataFrame.unionByName, parts) if parts else None


def _new_empty(spark: SparkSession, batch_id: int, ledger_dir: str, in_dir: str,
               glob: str) -> DataFrame:
    """0-byte files of the folder that no other batch has rejected."""
    empty = empty_files(spark, in_dir, glob)
    try:
        old = spark.read.schema("path string, reason string, batch_id long").json(
            f"{ledger_dir}_rejects")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return empty
    old = old.filter((F.col("batch_id") != batch_id) & (F.col("reason") == "empty_file"))
    return empty.join(old.select("path"), "path", "left_anti")


def import_batch(batch: DataFrame, batch_id: int, ledger_dir: str,
                 strict_header: bool = False, in_dir: str | None = None,
                 glob: str = "*.csv", folders: dict[int, str | None] | None = None) -> None:
    """Import one batch of files; with ``in_dir`` its 0-byte files are rejected too. ``folders`` are
    the ``_key_folders`` as a run knows them, to which the batch's own is added."""
    spark = batch.sparkSession
    size = F.col("length") if "length" in batch.columns else F.length("content")
    listed = batch.select("path", size.cast("long").alias("size"))
    # one trigger's file names (metadata, bounded by the trigger size)
    paths = [r.path for r in listed.select("path").collect()]
    if in_dir is not None:
        listed = listed.unionByName(_new_empty(spark, batch_id, ledger_dir, in_dir, glob))
    parsed = parse_statement_files(spark, paths, strict_header=strict_header, listed=listed)
    clean, rejects = split_parsed(parsed.persist())
    new = None
    try:
        incoming = clean.withColumn("imported_at", F.current_timestamp())
        in_jvm = getattr(spark, "_jvm", None) is not None      # not so with Spark Connect
        if in_jvm:
            folders = _key_folders(spark, ledger_dir) if folders is None else folders
            folders.pop(batch_id, None)
            stored = _stored_keys(spark, ledger_dir, folders)
        else:
            stored = _stored(spark, ledger_dir, batch_id)
        if stored is None:
            stored = incoming.limit(0)
        res = import_transactions(stored, incoming, ["path", "line_no"])
        new = (res.new.select(*LEDGER_COLUMNS)
               .withColumn("month", month_key(F.col("transaction_date"))).persist())
        (new.hint("rebalance", "month")
         .write.mode("overwrite").partitionBy("month")
         .parquet(f"{ledger_dir}/batch_id={batch_id}"))
        if in_jvm:
            keys = _keys_of(spark, ledger_dir, batch_id)
            new.select(*KEY, "month").hint("rebalance").write.mode("overwrite").parquet(keys)
            folders[batch_id] = keys
        rejects.write.mode("overwrite").json(f"{ledger_dir}_rejects/batch_id={batch_id}")
    finally:
        parsed.unpersist()
        if new is not None:
            new.unpersist()


def _own_session(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark``, to be changed without touching those."""
    try:
        own = spark.newSession()
    except (AttributeError, NotImplementedError):      # Spark Connect
        return spark
    have, want = own.conf.getAll, spark.conf.getAll
    for k in have.keys() - want.keys():
        own.conf.unset(k)
    for k, v in want.items():
        if have.get(k) != v:
            own.conf.set(k, v)
    return own


def stream_statements(spark: SparkSession, in_dir: str, ledger_dir: str, checkpoint: str,
                      glob: str = "*.csv", available_now: bool = True,
                      strict_header: bool = False, max_files: int = 1000) -> StreamingQuery:
    """Start the import stream; with ``available_now`` it processes every file
    present and stops (a scheduled incremental job). A trigger takes at most
    ``max_files`` files, so a backlog is imported in bounded batches."""
    # The source and the batches look up a trigger's files by name in few tasks; by default each
    # name is a task. A run over a backlog has a session of its own for that; a stream that stays up
    # belongs to the caller's, whose setting its batches copy at the start.
    session = _own_session(spark) if available_now else spark
    src = (session.readStream.format("binaryFile").schema(BINARY_FILE)
           .option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files)
           .option("recursiveFileLookup", "true").load(in_dir)
           .select("path", "length"))      # a batch is no lazy scan: contents would be read each time
    listed, folders = [], []

    def run(df, bid):
        looks = not listed or not available_now and time.monotonic() - listed[0] >= LIST_SECONDS
        if looks:
            listed[:] = [time.monotonic()]
        if available_now and not folders and getattr(df.sparkSession, "_jvm", None) is not None:
            folders.append(_key_folders(df.sparkSession, ledger_dir))
        import_batch(df, bid, ledger_dir, strict_header, in_dir if looks else None, glob,
                     folders[0] if folders else None)
    w = (src.writeStream
         .foreachBatch(run)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    old = spark.conf.get(LISTING_TASKS, None)
    session.conf.set(LISTING_TASKS, "32")
    try:
        return w.start()
    finally:
        if session is spark and old is None:
            spark.conf.unset(LISTING_TASKS)
        elif session is spark:
            spark.conf.set(LISTING_TASKS, old)
