"""Session settings, checkpointing and shared scratch folders."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Most rows of a join side that is sent to every executor.
BROADCAST_ROWS = 100_000

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # what a Python worker holds at a time is bounded by bytes, however long the texts are
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings every operator relies on."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship_package()
    return spark


def local_session(cores: int | str = "*", app: str = "ampersift", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the session.

    Only a master whose executors are threads of the driver may fall back to a
    temporary folder; a cluster has to name one in ``spark.checkpoint.dir``.
    """
    # a running session cannot change the setting, its context keeps the folder
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="ampersift-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder for one written table."""
    return f"{shared_dir(spark)}/ampersift/{label}-{uuid.uuid4().hex}"


def freeze(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later branches read the same stored rows, also
    after an executor is lost."""
    context = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame) -> DataFrame:
    """A grouped table to join to many rows: stored, counted, and broadcast if small.

    Without the hint the other side would be shuffled before adaptive execution
    learns the size. A larger table is joined the ordinary way.
    """
    stored = freeze(df)
    few = stored.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(stored) if few else stored


def trim() -> None:
    """Give memory that a task no longer needs back to the machine; its worker is
    used again by later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if give_back is not None:
        give_back(0)


def ship_package() -> None:
    """Send this package's functions to Python workers by value, so executors
    need no installed copy."""
    import ampersift
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(ampersift)
