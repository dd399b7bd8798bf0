"""Counters, rates, quantiles and alerts over event time (batch forms)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampersift.functions.columns import MICROS_PER_SECOND, from_micros, micros, quoted, ratio

# Upper bounds of the toxicity buckets.
TOXICITY_BUCKETS = (0.1, 0.3, 0.5, 0.7, 0.9, 1.0)

# Evaluations in a chunk of time in which spells are found (a day of 30-second steps).
CHUNK_STEPS = 2880


def counter_by_label(df: DataFrame, labels: Sequence[str], amount: str | None = None) -> DataFrame:
    """Events, or the sum of ``amount``, per label."""
    total = F.sum(quoted(amount)) if amount else F.count(F.lit(1))
    return df.groupBy(*[quoted(c) for c in labels]).agg(total.alias("total"))


def _tick(ts: str, seconds: int) -> Column:
    """Start of the ``seconds``-wide step that holds ``ts``."""
    width = seconds * MICROS_PER_SECOND
    return F.floor(micros(ts) / F.lit(width)) * F.lit(width)


def sliding(
    df: DataFrame,
    ts: str,
    by: Sequence[str],
    sums: dict[str, Column],
    range_seconds: int = 300,
    step_seconds: int = 60,
) -> DataFrame:
    """Sliding-window sums: rows are first summed per step, and only those
    step totals are copied to the windows they belong to."""
    if range_seconds % step_seconds:
        raise ValueError("the range has to be a multiple of the step")
    steps = df.groupBy(*[quoted(b) for b in by], _tick(ts, step_seconds).alias("_tick")).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()]
    )
    copies = range_seconds // step_seconds
    if copies == 1:
        return steps.withColumn("window_start", from_micros(F.col("_tick"))).drop("_tick")
    back = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    spread = steps.withColumn("_back", back).withColumn(
        "_start", F.col("_tick") - F.col("_back").cast("long") * F.lit(step_seconds * MICROS_PER_SECOND)
    )
    return (
        spread.groupBy(*[quoted(b) for b in by], "_start")
        .agg(*[F.sum(n).alias(n) for n in sums])
        .withColumn("window_start", from_micros(F.col("_start")))
        .drop("_start")
    )


def rate_sliding(
    df: DataFrame,
    ts: str = "ts",
    by: Sequence[str] = (),
    range_seconds: int = 300,
    step_seconds: int = 60,
    amount: str | None = None,
) -> DataFrame:
    """Events (or amounts) per second over a sliding range."""
    what = quoted(amount) if amount else F.lit(1)
    return sliding(df, ts, by, {"n": what}, range_seconds, step_seconds).withColumn(
        "rate", F.col("n") / F.lit(float(range_seconds))
    )


def success_ratio_window(
    df: DataFrame, ok: Column, ts: str = "ts", range_seconds: int = 300, step_seconds: int = 60
) -> DataFrame:
    """Percentage of successful events per sliding window."""
    summed = sliding(df, ts, [], {"n_ok": ok.cast("long"), "n": F.lit(1)}, range_seconds, step_seconds)
    return summed.withColumn("success_pct", ratio(F.col("n_ok") * 100.0, F.col("n")))


def avg_window(
    df: DataFrame, value: str, ts: str = "ts", by: Sequence[str] = (), range_seconds: int = 300, step_seconds: int = 300
) -> DataFrame:
    """Average from running sum and count per window."""
    x = quoted(value).cast("double")
    summed = sliding(
        df, ts, by, {"value_sum": x, "value_count": x.isNotNull().cast("long")}, range_seconds, step_seconds
    )
    return summed.withColumn("value_avg", ratio(F.col("value_sum"), F.col("value_count")))


def histogram_quantile(
    df: DataFrame,
    value: str,
    q: float,
    buckets: Sequence[float],
    by: Sequence[str] = (),
    ts: str | None = None,
    range_seconds: int = 300,
    step_seconds: int = 300,
) -> DataFrame:
    """Quantile estimated from cumulative bucket counts by linear interpolation.

    With ``ts`` there is one estimate per sliding window (``window_start``), else
    one over all rows. A quantile beyond the last bound yields that bound.
    """
    x = quoted(value)
    bounds = sorted(buckets)
    known = df.filter(x.isNotNull() & ~F.isnan(x))
    counts = {"n": F.lit(1), **{f"_le{i}": (x <= b).cast("long") for i, b in enumerate(bounds)}}
    if ts:
        counted = sliding(known, ts, by, counts, range_seconds, step_seconds)
    else:
        counted = known.groupBy(*[quoted(b) for b in by]).agg(*[F.sum(c).alias(n) for n, c in counts.items()])
    rank = F.lit(float(q)) * F.col("n")
    estimate = None
    for i, upper in enumerate(bounds):
        low = F.lit(float(bounds[i - 1])) if i else F.lit(0.0 if upper > 0 else float(upper))
        below = F.col(f"_le{i - 1}") if i else F.lit(0)
        inside = low + (F.lit(float(upper)) - low) * ratio(rank - below, F.col(f"_le{i}") - below)
        reached = F.col(f"_le{i}") >= rank
        estimate = F.when(reached, inside) if estimate is None else estimate.when(reached, inside)
    return counted.withColumn("quantile", estimate.otherwise(F.lit(float(bounds[-1])))).drop(
        *[f"_le{i}" for i in range(len(bounds))]
    )


def _islands(points: DataFrame, by: Sequence[str], step: int) -> DataFrame:
    """Runs of evaluations (``_at``, ``_peak``) one step apart: ``_from``, ``_to``,
    ``n_evals``, ``_peak``.

    Runs are found within chunks of time; only those that touch the edge of their
    chunk, two per chunk at most, are ordered once more to be joined.
    """
    by_cols = [quoted(b) for b in by]
    width = step * CHUNK_STEPS
    chunk = F.floor(F.col("_at") / F.lit(width)).alias("_chunk")
    inside = Window.partitionBy(*by_cols, "_chunk").orderBy("_at")
    figures = (F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.sum("n_evals").alias("n_evals"), F.max("_peak").alias("_peak"))
    run = F.col("_at") - F.row_number().over(inside) * F.lit(step).cast("long")
    runs = (
        points.select(*by_cols, "_at", "_peak", chunk)
        .withColumn("_run", run)
        .groupBy(*by_cols, "_chunk", "_run")
        .agg(F.min("_at").alias("_from"), F.max("_at").alias("_to"), F.count(F.lit(1)).alias("n_evals"), F.max("_peak").alias("_peak"))
    )
    start = F.col("_chunk") * F.lit(width)
    at_edge = (F.col("_from") == start) | (F.col("_to") == start + F.lit(width - step))
    columns = [*by_cols, "_from", "_to", "n_evals", "_peak"]
    lane = Window.partitionBy(*(by_cols or [F.lit(0)])).orderBy("_from")
    apart = F.coalesce(F.col("_from") - F.lag("_to").over(lane) != step, F.lit(True)).cast("int")
    edges = runs.filter(at_edge).select(*columns).withColumn("_new", apart)
    joined = edges.withColumn("_spell", F.sum("_new").over(lane)).groupBy(*by_cols, "_spell").agg(*figures)
    return runs.filter(~at_edge).select(*columns).unionByName(joined.select(*columns))


def _spells(
    points: DataFrame, by: Sequence[str], measure: str, eval_seconds: int, for_seconds: int
) -> DataFrame:
    """Pending and firing times of runs of evaluations over a threshold."""
    wait = F.lit(for_seconds * MICROS_PER_SECOND)
    fires = F.col("_to") - F.col("_from") >= wait
    found = _islands(points.withColumnRenamed(measure, "_peak"), by, eval_seconds * MICROS_PER_SECOND)
    return found.select(
        *[quoted(b) for b in by],
        from_micros(F.col("_from")).alias("pending_from"),
        F.when(fires, from_micros(F.col("_from") + wait)).alias("firing_from"),
        from_micros(F.col("_to")).alias("last_true"),
        "n_evals",
        F.col("_peak").alias(f"peak_{measure}"),
        fires.alias("fired"),
    )


def alert_for_duration(
    df: DataFrame,
    threshold: float,
    ts: str = "ts",
    by: Sequence[str] = (),
    range_seconds: int = 300,
    eval_seconds: int = 30,
    for_seconds: int = 300,
) -> DataFrame:
    """Spells in which the rate stays over ``threshold``.

    The rate is evaluated every ``eval_seconds``; a spell fires once it has
    held for ``for_seconds``. Works on the evaluation grid, which is bounded by
    the time covered, not by the number of events.
    """
    rated = rate_sliding(df, ts, by, range_seconds, eval_seconds)
    end = micros("window_start") + F.lit(range_seconds * MICROS_PER_SECOND)
    return _spells(rated.filter(F.col("rate") > threshold).withColumn("_at", end), by, "rate", eval_seconds, for_seconds)


def quantile_alert(
    df: DataFrame,
    value: str,
    q: float,
    buckets: Sequence[float],
    threshold: float,
    ts: str = "ts",
    by: Sequence[str] = (),
    range_seconds: int = 300,
    eval_seconds: int = 30,
    for_seconds: int = 300,
) -> DataFrame:
    """Spells in which the bucket quantile of ``value`` stays over ``threshold``.

    An evaluation without values ends a spell.
    """
    rated = histogram_quantile(df, value, q, buckets, by, ts, range_seconds, eval_seconds)
    end = micros("window_start") + F.lit(range_seconds * MICROS_PER_SECOND)
    return _spells(rated.filter(F.col("quantile") > threshold).withColumn("_at", end), by, "quantile", eval_seconds, for_seconds)


def gauge_last(
    df: DataFrame, value: str, by: Sequence[str], ts: str = "ts", tie: Sequence[str] = ()
) -> DataFrame:
    """The latest value per label."""
    order = F.struct(quoted(ts), *[quoted(t) for t in tie])
    return df.groupBy(*[quoted(b) for b in by]).agg(
        F.max_by(quoted(value), order).alias("last_value"), F.max(quoted(ts)).alias("last_ts")
    )


def hourly(
    df: DataFrame, by: Sequence[str], measures: dict[str, Column], ts: str = "ts", out: str = "ts"
) -> DataFrame:
    """Tumbling one-hour roll-up."""
    grain = F.window(quoted(ts), "1 hour")
    return (
        df.groupBy(*[quoted(b) for b in by], grain.alias("_w"))
        .agg(*[c.alias(n) for n, c in measures.items()])
        .withColumn(out, F.col("_w.start"))
        .drop("_w")
    )


def sessions(
    df: DataFrame, by: Sequence[str], gap_seconds: int = 1800, ts: str = "ts", value: str | None = None
) -> DataFrame:
    """Activity sessions: events closer than the gap belong together.

    Events are first summed per gap-wide slot. Two events of one slot are
    always closer than the gap, so a slot never straddles sessions, and the
    ordered step reads at most one row per slot instead of one per event.
    """
    by_cols = [quoted(b) for b in by]
    gap = gap_seconds * MICROS_PER_SECOND
    measured = [F.sum(quoted(value)).alias("_v")] if value else []
    slots = (
        df.withColumn("_t", micros(ts))
        .groupBy(*by_cols, F.floor(F.col("_t") / F.lit(gap)).alias("_slot"))
        .agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"), F.count(F.lit(1)).alias("_n"), *measured)
    )
    lane = Window.partitionBy(*by_cols).orderBy("_slot")
    quiet = F.col("_first") - F.lag("_last").over(lane)
    opened = F.when(quiet.isNull() | (quiet >= gap), 1).otherwise(0)
    numbered = slots.withColumn("_open", opened).withColumn("_session", F.sum("_open").over(lane))
    figures = [F.sum("_v").alias("value_sum")] if value else []
    return (
        numbered.groupBy(*by_cols, "_session")
        .agg(
            from_micros(F.min("_first")).alias("session_start"),
            from_micros(F.max("_last")).alias("session_end"),
            F.sum("_n").alias("n_events"),
            *figures,
        )
        .drop("_session")
    )
