"""Streaming jobs that keep state: alerts on timers, sessions, feedback joins.

State lives in RocksDB, so that it may exceed memory. The jobs run in a session
of their own, since the number of state partitions is fixed when a query first
starts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ampersift.functions.columns import MICROS_PER_SECOND, quoted
from ampersift.operators.upserts import keep_last
from ampersift.session import prepare
from ampersift.streaming.jobs import drain, stream_batches

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A session for stateful streams; ``partitions`` stores at most share a state."""
    fresh = prepare(spark.newSession())
    fresh.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    fresh.conf.set("spark.sql.shuffle.partitions", str(partitions or max(4, spark.sparkContext.defaultParallelism)))
    return fresh


def timed(stream: DataFrame, ts: str, late: str, name: str = "_at") -> DataFrame:
    """``stream`` with a zoned event time and its watermark."""
    return stream.withColumn(name, quoted(ts).cast(T.TimestampType())).withWatermark(name, late)


# --- alerts ---------------------------------------------------------------------

_SPELL_STATE = "ticks array<bigint>, counts array<bigint>, evaluated bigint, began bigint, fired boolean"
_ALERTS = "label string, pending_from bigint, firing_from bigint"


def _alert_rows(found: list[tuple[str, int, int]]) -> pd.DataFrame:
    labels, begun, fired = zip(*found, strict=True) if found else ((), (), ())
    return pd.DataFrame(
        {
            "label": pd.Series(labels, dtype=object),
            "pending_from": pd.Series(begun, dtype="int64"),
            "firing_from": pd.Series(fired, dtype="int64"),
        }
    )


class Spells(StatefulProcessor):
    """Follows one label's rate on the evaluation grid.

    Counts per tick wait until the watermark has passed the evaluation that sees
    them. A timer stands at the next evaluation, so that a spell fires when its
    time has come, also if no further row of the label arrives.
    """

    def __init__(self, rules: dict[str, tuple[float, int]], range_seconds: int, eval_seconds: int):
        self.rules, self.step = rules, eval_seconds * MICROS_PER_SECOND
        self.reach, self.range_seconds, self.eval_seconds = range_seconds // eval_seconds, range_seconds, eval_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("spell", _SPELL_STATE)

    def _read(self) -> tuple[dict[int, int], int | None, int | None, bool]:
        if not self.state.exists():
            return {}, None, None, False
        ticks, counts, evaluated, began, fired = self.state.get()
        return dict(zip(ticks or [], counts or [], strict=True)), evaluated, began, fired

    def _write(self, held: dict[int, int], evaluated: int | None, began: int | None, fired: bool) -> None:
        ticks = sorted(held)
        self.state.update((ticks, [held[t] for t in ticks], evaluated, began, fired))

    def _schedule(self, held: dict[int, int], evaluated: int | None, began: int | None, passed: int) -> None:
        """A timer at the first evaluation after the watermark that has anything to say."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        if held or began is not None:
            first = min(held) + 1 if held else passed + 1
            at = max(first, passed + 1, evaluated + 1 if evaluated is not None else first)
            self.handle.registerTimer(at * self.eval_seconds * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, evaluated, began, fired = self._read()
        for frame in rows:
            for tick, n in zip(frame["tick"].tolist(), frame["n"].tolist(), strict=True):
                held[tick] = held.get(tick, 0) + n
        self._write(held, evaluated, began, fired)
        self._schedule(held, evaluated, began, self._passed(timerValues))
        yield _alert_rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, evaluated, began, fired = self._read()
        passed = self._passed(timerValues)
        threshold, wait = self.rules.get(key[0], (float("inf"), 0))
        wait *= MICROS_PER_SECOND
        out = []
        # evaluations that any held tick reaches, and the one behind, which ends a spell
        due = sorted({e for t in held for e in range(t + 1, t + self.reach + 2) if e <= passed and (evaluated is None or e > evaluated)})
        ticks = np.array(sorted(held), np.int64)
        totals = np.concatenate([[0], np.cumsum([held[t] for t in ticks.tolist()])]).astype(np.int64)
        for e in due:
            a, b = np.searchsorted(ticks, [e - self.reach, e])
            high = (totals[b] - totals[a]) / float(self.range_seconds) > threshold
            if not high or (evaluated is not None and began is not None and e != evaluated + 1):
                began, fired = None, False
            if high:
                began = e if began is None else began
                if not fired and (e - began) * self.step >= wait:
                    fired = True
                    out.append((key[0], began * self.step, began * self.step + wait))
            evaluated = e
        held = {t: n for t, n in held.items() if t + self.reach >= passed}
        self._write(held, evaluated, began, fired)
        self._schedule(held, evaluated, began if held else None, passed)
        yield _alert_rows(out)

    def _passed(self, timerValues) -> int:
        """The last evaluation that the watermark has passed."""
        return timerValues.getCurrentWatermarkInMs() // (self.eval_seconds * 1000)

    def close(self) -> None:
        pass


def tick_counts(stream: DataFrame, label: str, ts: str, eval_seconds: int) -> DataFrame:
    """Rows per label and tick, counted within each Arrow batch before any shuffle,
    with the newest time of the tick (at)."""
    step = eval_seconds * MICROS_PER_SECOND
    narrow = stream.select(quoted(label).alias("label"), F.unix_micros(quoted(ts).cast("timestamp")).alias("at"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch]).drop_null()
            tick = pa.array(np.floor_divide(rows.column("at").to_numpy(), step), pa.int64())
            made = rows.append_column("tick", tick).group_by(["label", "tick"]).aggregate([("at", "count"), ("at", "max")])
            named = made.select(["label", "tick", "at_count", "at_max"]).rename_columns(["label", "tick", "n", "at"])
            yield from named.combine_chunks().to_batches()

    counted = narrow.mapInArrow(count, "label string, tick long, n long, at long")
    return counted.withColumn("at", F.timestamp_micros("at"))


def alert_stream(
    stream: DataFrame,
    rules: dict[str, tuple[float, int]],
    label: str = "label",
    ts: str = "ts",
    range_seconds: int = 300,
    eval_seconds: int = 30,
    late: str = "5 minutes",
) -> DataFrame:
    """Alerts (label, pending_from, firing_from) of a stream of events.

    ``rules`` gives each label its threshold in events a second and the seconds
    for which the rate has to stay over it. The rate over ``range_seconds`` is
    evaluated every ``eval_seconds`` as soon as the watermark has passed. Each
    spell fires once. Rows later than ``late`` are not counted.
    """
    if range_seconds % eval_seconds:
        raise ValueError("the range has to be a multiple of the evaluation step")
    counted = tick_counts(stream, label, ts, eval_seconds).withWatermark("at", late)
    fired = counted.groupBy("label").transformWithStateInPandas(
        statefulProcessor=Spells(rules, range_seconds, eval_seconds),
        outputStructType=_ALERTS,
        outputMode="Append",
        timeMode="EventTime",
    )
    moments = [F.timestamp_micros(c).cast("timestamp_ntz").alias(c) for c in ("pending_from", "firing_from")]
    return fired.select("label", *moments)


# --- sessions -------------------------------------------------------------------


def session_stream(
    stream: DataFrame, by: Sequence[str], ts: str = "ts", gap_seconds: int = 1800, late: str = "10 minutes", value: str | None = None
) -> DataFrame:
    """Sessions of a stream, each emitted once the watermark has passed its end.

    Spark merges the windows of a key within a batch and with its state. It also
    merges windows that only touch; events a whole gap apart are no session, so
    the windows are a microsecond shorter.
    """
    gap = f"{gap_seconds * MICROS_PER_SECOND - 1} microseconds"
    figures = [F.sum(quoted(value)).alias("value_sum")] if value else []
    made = (
        timed(stream, ts, late)
        .groupBy(F.session_window("_at", gap).alias("w"), *[quoted(b) for b in by])
        .agg(F.max("_at").alias("_last"), F.count(F.lit(1)).alias("n_events"), *figures)
    )
    return made.select(
        *[quoted(b) for b in by],
        F.col("w.start").cast(T.TimestampNTZType()).alias("session_start"),
        F.col("_last").cast(T.TimestampNTZType()).alias("session_end"),
        "n_events",
        *(["value_sum"] if value else []),
    )


def late_rows(stream: DataFrame, target: str, checkpoint: str, ts: str = "ts", late: str = "10 minutes") -> None:
    """Store the rows that a watermark of ``late`` drops, as a table beside the results.

    A row is late if it is older than ``late`` before the newest row of all
    earlier batches. Each batch leaves its newest time, a row, under
    ``<target>_seen``, so a batch that is tried again finds the same mark.
    """
    spark = stream.sparkSession
    seen = f"{target}_seen"
    at = quoted(ts).cast("timestamp")
    blank = spark.createDataFrame([], "newest timestamp")
    blank.write.mode("overwrite").parquet(f"{seen}/batch=-1")
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(f"{target}/batch=-1")

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        earlier = session.read.parquet(seen).filter(F.col("batch") < number)
        mark = earlier.agg(F.max("newest") - F.expr(f"INTERVAL {late}")).first()[0]
        behind = batch.filter(at < F.lit(mark)) if mark is not None else batch.limit(0)
        behind.write.mode("overwrite").parquet(f"{target}/batch={number}")
        batch.agg(F.max(at).alias("newest")).write.mode("overwrite").parquet(f"{seen}/batch={number}")

    stream_batches(stream, checkpoint, step)


# --- feedback -------------------------------------------------------------------


_PENDING = "made array<bigint>, ties array<bigint>, results array<string>, given array<bigint>, feedback array<string>, met array<bigint>"
_MATCHES = "feedback string, result string"
_NEVER = -(1 << 62)


class LatestBefore(StatefulProcessor):
    """Follows the results and the open feedback of one key.

    A feedback comes out beside the latest result at hand, again when a later one has
    come in, and with none once the watermark has passed its time. Of results of the
    same time it meets the one with the greatest tie, or all, if ``all_ties``. Kept are the feedback and results that it has not
    passed, and of the results before it the latest alone, since no other can be
    the latest before any feedback to come.
    """

    def __init__(self, within: int, all_ties: bool):
        self.within, self.all_ties = within, all_ties

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pending", _PENDING)

    def _read(self) -> list[list]:
        return [list(x or []) for x in self.state.get()] if self.state.exists() else [[], [], [], [], [], []]

    def _settle(self, made, ties, results, given, feedback, met, passed: int) -> pd.DataFrame:
        """Keep what is still open, set a timer, and say which feedback stays without a result."""
        over, passed_by = given < passed, np.searchsorted(made, passed, "right")
        lost = feedback[over & (met == _NEVER)]
        first = np.searchsorted(made, made[passed_by - 1], "left") if passed_by else 0
        if passed_by and made[passed_by - 1] < passed - self.within:
            first = passed_by
        held = [made[first:], ties[first:], results[first:], given[~over], feedback[~over], met[~over]]
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
        if len(held[0]) or len(held[3]):
            self.state.update(tuple(x.tolist() for x in held))
            end = int(held[3].min()) if len(held[3]) else int(held[0].max()) + self.within
            self.handle.registerTimer(end // 1000 + 1)
        elif self.state.exists():
            self.state.clear()
        return pd.DataFrame({"feedback": pd.Series(lost, dtype=object), "result": pd.Series([None] * len(lost), dtype=object)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        made, ties, results, given, feedback, met = self._read()
        old_results, old_feedback = len(made), len(given)
        for frame in rows:
            told = frame["feedback"].notna().to_numpy()
            at, f, r = frame["at"].to_numpy(), frame["feedback"].to_numpy(), frame["result"].to_numpy()
            given += at[told].tolist()
            feedback += f[told].tolist()
            # a missing key equals none
            if all(k is not None and k == k for k in key):
                made += at[~told].tolist()
                results += r[~told].tolist()
                ties += frame["tie"].to_numpy()[~told].tolist()
        met += [_NEVER] * (len(given) - old_feedback)
        fresh = np.arange(len(made)) >= old_results
        made, ties, given, met = (np.array(x, np.int64) for x in (made, ties, given, met))
        results, feedback = (np.array([*x, None], object)[:-1] for x in (results, feedback))
        order = np.lexsort((ties, made))
        made, ties, results, fresh = made[order], ties[order], results[order], fresh[order]
        high = np.searchsorted(made, given, "right")
        last = np.append(made, _NEVER)[high - 1]
        found = (high > 0) & (last >= given - self.within) & (last >= met)
        low = np.searchsorted(made, last, "left") if self.all_ties else high - 1
        size = np.where(found, high - low, 0)
        note = np.repeat(np.arange(len(given)), size)
        place = np.arange(len(note)) - np.repeat(np.cumsum(size) - size, size) + low[note]
        new = fresh[place] | (last[note] > met[note])
        met = np.where(found, last, met)
        yield pd.DataFrame({"feedback": feedback[note[new]], "result": results[place[new]]})
        yield self._settle(made, ties, results, given, feedback, met, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        made, ties, results, given, feedback, met = self._read()
        made, ties, given, met = (np.array(x, np.int64) for x in (made, ties, given, met))
        results, feedback = (np.array([*x, None], object)[:-1] for x in (results, feedback))
        yield self._settle(made, ties, results, given, feedback, met, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


# Rows wait in the state as JSON, with times to the microsecond.
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def feedback_matches(
    feedback: DataFrame,
    results: DataFrame,
    keys: Sequence[str] = ("query", "variant_id"),
    given_at: str = "given_at",
    ts: str = "timestamp",
    within: str = "1 hour",
    late: str = "10 minutes",
    tie: str = "result_id",
) -> DataFrame:
    """Each feedback beside the latest result of its keys in the time ``within`` before it.

    Both sides have a watermark of ``late``. A feedback comes out as soon as it has
    met a result, and again when a later one arrives; one that has met none comes
    out with nulls after its time has passed. Pairs with the results before the
    latest are not made: their number grows with the square of a key's rows. Of
    results of the same time the one with the greatest whole number ``tie`` counts;
    without such a column all of them come out. Result columns have the prefix
    ``result_``.
    """
    whole = dict(results.dtypes).get(tie) in ("tinyint", "smallint", "int", "bigint")
    told = timed(feedback, given_at, late, "_at").select(
        *[quoted(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        "_at",
        F.to_json(F.struct(*[quoted(c) for c in feedback.columns]), _JSON).alias("feedback"),
        F.lit(None).cast("string").alias("result"),
        F.lit(_NEVER).alias("tie"),
    )
    made = timed(results, ts, late, "_at").select(
        *[quoted(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        "_at",
        F.lit(None).cast("string").alias("feedback"),
        F.to_json(F.struct(*[quoted(c) for c in results.columns]), _JSON).alias("result"),
        (F.coalesce(quoted(tie).cast("long"), F.lit(_NEVER)) if whole else F.lit(_NEVER)).alias("tie"),
    )
    both = told.unionByName(made).filter(F.col("_at").isNotNull()).withColumn("at", F.unix_micros("_at"))
    found = both.groupBy(*[f"_k{i}" for i in range(len(keys))]).transformWithStateInPandas(
        statefulProcessor=LatestBefore(int(pd.Timedelta(within).total_seconds() * MICROS_PER_SECOND), not whole),
        outputStructType=_MATCHES,
        outputMode="Append",
        timeMode="EventTime",
    )
    read = found.select(*[F.from_json(n, df.schema, _JSON).alias(n) for n, df in (("feedback", feedback), ("result", results))])
    return read.select(
        *[F.col(f"feedback.`{c}`").alias(c) for c in feedback.columns], *[F.col(f"result.`{c}`").alias(f"result_{c}") for c in results.columns]
    )


def feedback_stream(
    feedback: DataFrame, results: DataFrame, target: str, checkpoint: str, keys: Sequence[str], **how
) -> None:
    """Store the matches of everything available; ``read_feedback`` picks from them."""
    drain(feedback_matches(feedback, results, keys, **how), target, checkpoint)


def read_feedback(
    spark: SparkSession,
    target: str,
    results: DataFrame,
    keys: Sequence[str] = ("query", "variant_id"),
    row_id: str = "result_id",
    ts: str = "timestamp",
    score: str = "satisfaction_score",
    order: Sequence[str] = ("feedback_no",),
) -> tuple[DataFrame, DataFrame]:
    """(results with the last score given to each, feedback that met no result).

    A feedback goes to the latest result it has met. Where later feedback of the
    same keys met the same result, the last by ``order`` counts.
    """
    stored = spark.read.parquet(target)
    own = [c for c in stored.columns if not c.startswith("result_") and c != "batch"]
    met = stored.filter(F.col(f"result_{row_id}").isNotNull())
    # of the results that a feedback has met, the latest
    latest = keep_last(met, [*keys, *order], [f"result_{ts}", f"result_{row_id}"])
    given = keep_last(latest.select(F.col(f"result_{row_id}").alias(row_id), F.col(score).alias("_given"), *order), [row_id], list(order))
    updated = results.join(given.select(row_id, "_given"), row_id, "left").withColumn(score, F.coalesce("_given", quoted(score))).drop("_given")
    lost = stored.filter(F.col(f"result_{row_id}").isNull()).select(*own)
    return updated, lost
