"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "tramline", cores: str | int | None = None) -> SparkSession:
    """Local session for tests and the bench; a cluster brings its own settings."""
    cores = cores or os.environ.get("BENCH_CPUS", "*")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="tramline-")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session may
    fall back to a temporary folder, since there the driver is the cluster.
    """
    configured = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by the cluster")
    return _local_folder()


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder (not created yet)."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint for a frame that several later passes read."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


BROADCAST_BYTES = 64 * 1024 * 1024


def is_broadcast_size(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the rows, measured as JSON text, take at most ``limit`` bytes."""
    size = F.octet_length(F.to_json(F.struct("*"))).cast("long")
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit
