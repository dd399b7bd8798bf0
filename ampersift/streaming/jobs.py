"""Streaming jobs over append-only tables.

Each micro-batch is written to its own folder under the target, replaced if the
batch is retried, so a restart neither loses nor doubles rows. Readers keep the
newest row per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ampersift.functions.columns import MICROS_PER_SECOND, quoted
from ampersift.operators import guardrails as gr
from ampersift.operators.upserts import keep_last


def stream_table(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None
) -> DataFrame:
    """A Parquet folder, or a path pattern, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drain(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    shape: Callable[[DataFrame], DataFrame] | None = None,
    mode: str = "append",
) -> None:
    """Process everything available, one folder per micro-batch, then stop.

    An empty first folder gives the target its schema, also when nothing arrives.
    """
    blank = stream.sparkSession.createDataFrame([], stream.schema)
    (shape(blank) if shape else blank).write.mode("overwrite").parquet(f"{target}/batch=-1")

    def store(batch: DataFrame, number: int) -> None:
        out = shape(batch) if shape else batch
        out.write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream_batches(stream, checkpoint, store, mode)


def stream_batches(
    stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], object], mode: str = "append"
) -> None:
    """Hand everything available to ``step``, batch by batch, then stop."""

    def take(batch: DataFrame, number: int) -> None:
        step(batch, number)

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(take)
        .start()
    )
    query.awaitTermination()


def read_latest(spark: SparkSession, target: str, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The newest row per key over all batches of a target."""
    return keep_last(spark.read.parquet(target), keys, ["batch", *order]).drop("batch")


def compact(
    spark: SparkSession, target: str, fresh: str, keys: Sequence[str], order: Sequence[str] = ()
) -> None:
    """Rewrite a target that has gathered many batches as one folder of newest rows.

    The result goes to a new path, so readers of the old one are not disturbed.
    """
    read_latest(spark, target, keys, order).write.mode("overwrite").parquet(f"{fresh}/batch=-1")


def upsert_stream(
    stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], order: Sequence[str]
) -> None:
    """Last-write-wins ingest: duplicates inside a batch are resolved before writing."""
    drain(stream, target, checkpoint, lambda batch: keep_last(batch, keys, order))


def read_sums(spark: SparkSession, target: str, keys: Sequence[str], sums: Sequence[str] = ("n",)) -> DataFrame:
    """Totals per key over the shares that the batches of a target have stored."""
    stored = spark.read.parquet(target)
    return stored.groupBy(*[quoted(k) for k in keys]).agg(*[F.sum(quoted(c)).alias(c) for c in sums])


def windowed_counts(
    stream: DataFrame,
    by: Sequence[str],
    ts: str = "ts",
    window: str = "5 minutes",
    slide: str | None = None,
    late: str | None = None,
) -> DataFrame:
    """Event counts per window and label, of a stream or of one micro-batch.

    On a stream, ``late`` bounds the state: windows older than that behind the
    newest row are closed, and rows that still come for them are not counted.
    Where every row counts, use ``count_stream``.
    """
    grain = F.window("_at", window, slide) if slide else F.window("_at", window)
    # watermarks take zoned timestamps only; the session runs in UTC
    timed = stream.withColumn("_at", quoted(ts).cast(T.TimestampType()))
    return (
        (timed.withWatermark("_at", late) if late else timed)
        .groupBy(grain.alias("w"), *[quoted(b) for b in by])
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            F.col("w.start").cast(T.TimestampNTZType()).alias("window_start"), *[quoted(b) for b in by], "n"
        )
    )


def count_stream(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    by: Sequence[str],
    ts: str = "ts",
    window: str = "5 minutes",
) -> None:
    """Store each micro-batch's share of the counts per window and label.

    ``read_sums`` adds the shares up. No state is kept between batches and no
    row is too late to be counted.
    """
    drain(stream, target, checkpoint, lambda batch: windowed_counts(batch, by, ts, window))


def outcomes(verdicts: DataFrame, ts: str) -> DataFrame:
    """One row per violation of a checked input, or one PASSED row."""
    kinds = F.transform("violations", lambda v: v["type"])
    outcome = F.when(F.col("passed"), F.array(F.lit("PASSED"))).otherwise(kinds)
    return verdicts.select(quoted(ts), F.explode(outcome).alias("outcome"))


def violation_windows(stream: DataFrame, text: str, ts: str, window: str = "1 hour") -> DataFrame:
    """Validate inputs, of a stream or of one micro-batch, and count outcomes per window."""
    return windowed_counts(outcomes(gr.validate_input(stream, text), ts), ["outcome"], ts, window)


def violation_stream(
    stream: DataFrame, target: str, checkpoint: str, text: str, ts: str, window: str = "1 hour"
) -> None:
    """Store each micro-batch's share of the outcomes per window, for ``read_sums``."""
    drain(stream, target, checkpoint, lambda batch: violation_windows(batch, text, ts, window))


def duration_alerts(
    rates: DataFrame, label: str, at: str, rate: str, threshold: float, eval_seconds: int = 30, for_seconds: int = 300
) -> DataFrame:
    """Emit (label, firing_from) once a streamed rate has held over the threshold.

    State per label: when the spell began, its last evaluation and whether it
    has fired. A missing or low evaluation ends the spell.
    """
    step, wait = eval_seconds * MICROS_PER_SECOND, for_seconds * MICROS_PER_SECOND

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        began, last, fired = state.get if state.exists else (None, None, False)
        out = []
        points = pd.concat(list(batches)).sort_values("at")
        for moment, value in zip(points["at"], points["rate"]):
            if value <= threshold:
                began, fired = None, False
            elif began is None or moment - last > step:
                began, fired = int(moment), False
            last = int(moment)
            if began is not None and not fired and last - began >= wait:
                fired = True
                out.append((key[0], began + wait))
        state.update((began, last, fired))
        yield pd.DataFrame(out, columns=["label", "firing_at"])

    shaped = rates.select(
        quoted(label).alias("label"),
        F.unix_micros(quoted(at).cast("timestamp")).alias("at"),
        quoted(rate).alias("rate"),
    )
    return (
        shaped.groupBy("label")
        .applyInPandasWithState(
            follow,
            "label string, firing_at long",
            "began long, last long, fired boolean",
            "append",
            GroupStateTimeout.NoTimeout,
        )
        .select("label", F.timestamp_micros("firing_at").cast("timestamp_ntz").alias("firing_from"))
    )
