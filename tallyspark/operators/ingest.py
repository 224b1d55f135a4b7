"""Idempotent import of new ledger rows (K1, K2) and high-water-mark loads (I1).

Uniqueness key: ``(transaction_date, description, amount)``. Within a batch
the first row per key in input order wins; rows whose key is already stored
are skipped. First-wins uses ``min_by`` over the order columns, which is a
partial aggregate: a key repeated a million times is folded map-side to one
row per task before the shuffle, so a hot key cannot pile up in one task.
The batch is evaluated once: one aggregate yields the first rows and how many
rows each stands for, and is written to the shared checkpoint folder. The date
span, the new rows and all counts come from that table. The stored side is read
only for the batch's date range (pushed into the Parquet scan; on a
month-partitioned ledger it also prunes partitions), so the cost follows the
batch, not the history.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .query import date_range

KEY = ["transaction_date", "description", "amount"]
# Size bounds of a batch whose keys are broadcast to the stored ledger.
BROADCAST_MAX_KEYS = 200_000
BROADCAST_MAX_CHARS = 16 << 20


@dataclass
class ImportResult:
    new: DataFrame        # rows to append (first per key, key not stored)
    counts: DataFrame     # one row: incoming, inserted, skipped


def first_per_key(incoming: DataFrame, order: list[str], count: str | None = None) -> DataFrame:
    """The first row of each key in ``order`` (file, line) order; with ``count`` a column of that
    name says how many rows the key has."""
    cols = [c for c in incoming.columns if c not in KEY]
    ordering = F.struct(*[F.col(c) for c in order])
    packed = F.struct(*[F.col(c) for c in cols])
    counts = [F.count(F.lit(1)).alias(count)] if count else []
    return (incoming.groupBy(*KEY)
            .agg(F.min_by(packed, ordering).alias("_row"), *counts)
            .select(*KEY, *[F.col("_row").getField(c).alias(c) for c in cols],
                    *([count] if count else [])))


def _free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def stored_keys(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Keys of the stored ledger restricted to the batch's date span, and where the batch is
    measured as small to the batch's own keys: then the stored side is scanned and not moved."""
    return _stored_keys(existing, incoming)[0]


def _stored_keys(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, bool]:
    """``stored_keys``, and whether they are restricted to the keys of a small batch."""
    span = incoming.agg(F.min("transaction_date").alias("lo"), F.max("transaction_date").alias("hi"),
                        F.count(F.lit(1)).alias("n"), F.sum(F.length("description")).alias("chars")).first()
    lo, hi = span["lo"], span["hi"]
    if lo is None:
        return existing.select(*KEY).limit(0), True
    keys = date_range(existing, lo, hi).select(*KEY)
    small = span["n"] <= BROADCAST_MAX_KEYS and (span["chars"] or 0) <= BROADCAST_MAX_CHARS
    if small:
        keys = keys.join(F.broadcast(incoming.select(*KEY)), KEY, "left_semi")
    return keys, small


def import_transactions(existing: DataFrame, incoming: DataFrame,
                        order: list[str] | None = None) -> ImportResult:
    """New rows to append and the (incoming, inserted, skipped) counts.

    An empty batch gives 0/0 with no special case. Re-running with the same
    batch after the append inserts 0 (idempotent).
    """
    order = order or ["line_no"]
    n = _free_name(incoming, "n_rows")
    # Parquet has no column without a type
    typed = incoming.select(*[F.col(f.name).cast("string") if f.dataType.typeName() == "void"
                              else F.col(f.name) for f in incoming.schema.fields])
    firsts = stored(first_per_key(typed, order, n), "import-batch")
    keys, small = _stored_keys(existing, firsts)
    if small:       # at most the batch's own keys, each once: the batch is not moved either
        keys = F.broadcast(keys.distinct())
    new = firsts.drop(n).join(keys, KEY, "left_anti")
    # Two one-row aggregates stacked and folded: no cross join.
    stacked = firsts.agg(F.coalesce(F.sum(n), F.lit(0)).alias("n")).select(
        F.lit("incoming").alias("k"), "n").unionByName(
        new.agg(F.count(F.lit(1)).alias("n")).select(F.lit("inserted").alias("k"), "n"))
    counts = stacked.agg(
        F.sum(F.when(F.col("k") == "incoming", F.col("n"))).cast("bigint").alias("incoming"),
        F.sum(F.when(F.col("k") == "inserted", F.col("n"))).cast("bigint").alias("inserted"),
    ).select("incoming", "inserted", (F.col("incoming") - F.col("inserted")).alias("skipped"))
    return ImportResult(new, counts)


def since_watermark(existing: DataFrame, incoming: DataFrame, as_of: _dt.date,
                    days: int = 30, start=None, end=None) -> DataFrame:
    """Rows of ``incoming`` in the load window. Start: ``start`` when given,
    else the newest stored date (inclusive: its day is re-read and deduped by
    the import), else ``as_of - days``. End: ``end`` when given, else ``as_of``.
    The stored maximum is one scalar (a single-row aggregate)."""
    if start is None:
        start = existing.agg(F.max("transaction_date")).first()[0]
    if start is None:
        start = as_of - _dt.timedelta(days=days)
    return date_range(incoming, start, end or as_of)
