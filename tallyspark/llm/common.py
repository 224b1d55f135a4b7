"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import os
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.session import shared_dir


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to a fresh folder of the shared checkpoint directory and read it back: a
    lost executor then costs a reread, not the recomputation of everything before."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    w = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a cluster that has
    it installed is not affected)."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])


def subset(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under internal names, so extra columns cannot clash. A missing
    column raises; a column of nulls of unknown type becomes a typed null."""
    ship_package(df.sparkSession)
    kinds = dict(df.dtypes)
    return df.select(*[
        (F.col(f"`{src}`").cast("string") if kinds.get(src) == "void" else F.col(f"`{src}`"))
        .alias(dst) for dst, src in columns.items()])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have in any case."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def bucket_crc32(col: str, modulus: int):
    """``crc32(doc_id as text) mod modulus``: the folds of the learned operators. Null ids are
    in no held-out fold and teach nothing (the result is null)."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(modulus))


def id_type(df: DataFrame, col: str) -> T.DataType:
    return df.schema[col].dataType


def slices(batch, rows: int = 512):
    """An Arrow batch in parts of at most ``rows`` rows, so what Python makes of a part stays
    small beside the batch itself."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stored table, or an empty one if its folder does not exist yet. Any other error of the
    read is raised."""
    from pyspark.errors import AnalysisException
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


@contextmanager
def task_memory(*caches: dict):
    """For the length of a task: Python's cycle collector off (these tasks make many short-lived
    objects but no cycles; reference counts free them all the same). After it, ``caches`` are
    emptied and Arrow's unused memory goes back, as the worker lives on."""
    gc.disable()
    try:
        yield
    finally:
        for c in caches:
            c.clear()
        gc.enable()
        gc.collect()
        pa.default_memory_pool().release_unused()
