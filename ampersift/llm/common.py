"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampersift.session import prepare, scratch_path

# Rows and bytes of one Arrow batch that a Python worker holds at a time.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the operators: bounded Arrow batches."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def plain(name: str) -> Column:
    return F.col(f"`{name}`")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that clash with ``names`` (case apart)."""
    taken = {n.lower() for n in names}
    return df.select(*[plain(c) for c in df.columns if c.lower() not in taken])


def store(df: DataFrame, label: str, *folders: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that no later stage
    depends on shuffle files of a lost executor; ``folders`` are columns with a
    folder for each value."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*stored: DataFrame, only: str = "") -> None:
    """Delete the files of tables made by ``store`` that nothing will read again;
    with ``only``, those in folders whose names end with it."""
    for df in stored:
        context = df.sparkSession.sparkContext
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
            if not folder.endswith(only):
                continue
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver drop shuffle files that no frame refers to any more.

    Spark removes them when their frames are collected as garbage, which a driver
    with little work of its own may not do for a long time.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


Step = Callable[[pa.RecordBatch], dict]


def annotate(df: DataFrame, fields: T.StructType, setup: Callable[[], Step]) -> DataFrame:
    """Append columns computed from Arrow batches; the rows and their columns stay.

    ``setup`` runs once per task and returns the function of a batch. Columns of
    ``df`` that clash with a new one are replaced.
    """
    base = without(df, *fields.names)
    names = [*base.columns, *fields.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = set(worker_state())
        asked().clear()
        step = setup()
        for key in held - asked():  # models of an earlier operator
            worker_state().pop(key, None)
        try:
            for batch in batches:
                new = step(batch)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(new[n] for n in fields.names)], names=names)
        finally:
            trim()

    return base.mapInArrow(run, T.StructType([*base.schema.fields, *fields.fields]))


def raw_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """UTF-8 bytes of a text column."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def worker_state() -> dict:
    """A dictionary that lives as long as the Python worker, for built models."""
    home = sys.modules.setdefault("_ampersift_worker", types.ModuleType("_ampersift_worker"))
    return home.__dict__.setdefault("state", {})


def asked() -> set:
    """Keys of the models that the running task has asked for."""
    worker_state()
    return sys.modules["_ampersift_worker"].__dict__.setdefault("asked", set())


def trim() -> None:
    """Give memory that a task no longer needs back to the machine.

    Workers are used again by later stages; what one task has freed would
    otherwise stay with the process.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if give_back is not None:
        give_back(0)


def once(key: object, build: Callable[[], object]) -> object:
    """``build()`` kept in the worker until another operator's task begins; the
    last few results stay."""
    kept = worker_state()
    asked().add(key)
    if key not in kept:
        while len(kept) >= 4:
            kept.pop(next(iter(kept)))
        kept[key] = build()
        trim()
    return kept[key]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) | np.uint64(1)


def text_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text."""
    return F.crc32(plain(column).cast("string").cast("binary"))
