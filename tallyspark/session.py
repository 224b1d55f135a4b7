"""Session construction and the shared working folder.

Intermediate tables (snapshot exports, statement drops, stream sinks) are
written under the cluster's shared checkpoint folder, ``spark.checkpoint.dir``.
It is read from the session; only when it is unset (local tests) is a local
folder chosen and registered.
"""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

import pyspark
from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


# Settings for a large cluster (~1000 executors, ~100 TB of ledger input):
# start shuffles wide and let AQE coalesce them to ~128 MB partitions, so a
# task's shuffle input fits executor memory without spilling much; read
# Parquet in 256 MB splits; split skewed join partitions (a key holding a large
# share of rows); let broadcasts happen only below 64 MB of measured size.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "8000",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
    "spark.sql.files.maxPartitionBytes": str(256 << 20),
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(256 << 20),
    "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    "spark.sql.parquet.aggregatePushdown": "true",
}


def build_session(master: str | None = None, app: str = "tallyspark",
                  shuffle_partitions: int | None = None,
                  conf: dict[str, str] | None = None,
                  profile: str = "local") -> SparkSession:
    """A session with AQE (coalescing and skew-join splitting) and UTC time;
    ``profile="cluster"`` adds ``CLUSTER_CONF``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = dict(DEFAULT_CONF)
    if profile == "cluster":
        settings.update(CLUSTER_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the session. Where none is set, a local master gets a
    temporary folder; on a cluster that is an error, as executors would not see it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        try:
            root = spark.sparkContext.getCheckpointDir()
        except Exception:  # Spark Connect: no SparkContext
            root = None
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all "
                               "executors share")
        root = tempfile.mkdtemp(prefix="tallyspark-ckpt-")
        try:
            spark.sparkContext.setCheckpointDir(root)
        except Exception:
            pass
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    path = f"{root}/tallyspark/{name}-{uuid.uuid4().hex[:12]}"
    if "://" not in path or path.startswith("file:"):
        os.makedirs(path.replace("file:", ""), exist_ok=True)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a fresh folder of the shared checkpoint directory and read back: it is
    computed once, and a lost executor costs a reread."""
    path = shared_dir(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def built_once(build):
    """``build(*args)`` of Columns, made once per JVM: they name columns and belong to no plan, and
    building them costs a call to the JVM a node, which a stream would pay in every batch."""
    made = {}

    @functools.wraps(build)
    def get(*args):
        key = (getattr(getattr(pyspark, "SparkContext", None), "_gateway", None), *args)
        if key not in made:
            made[key] = build(*args)
        return made[key]
    return get
