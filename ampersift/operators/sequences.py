"""Lookback windows, horizons, splits and folds over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampersift.functions.columns import quoted
from ampersift.operators.ordering import leading_share, row_numbers


def _lane(series: Sequence[str], ts: str) -> Window:
    # hourly rows: a lane is bounded by the hours covered
    return Window.partitionBy(*[quoted(s) for s in series]).orderBy(quoted(ts))


def make_sequences(
    df: DataFrame,
    value: str | Column,
    lookback: int = 24,
    series: Sequence[str] = ("series_id",),
    ts: str = "datetime",
    target: str | Column | None = None,
) -> DataFrame:
    """One row per full window: ``x`` = the previous rows, ``y`` = this row's target."""
    w = _lane(series, ts)
    past = w.rowsBetween(-lookback, -1)
    item = quoted(value) if isinstance(value, str) else value
    goal = item if target is None else (quoted(target) if isinstance(target, str) else target)
    return (
        df.withColumns(
            {
                "x": F.collect_list(item).over(past),
                "y": goal,
                "_rn": F.row_number().over(w),
            }
        )
        .filter(F.col("_rn") > lookback)
        .drop("_rn")
    )


def make_multi_horizon(
    df: DataFrame,
    value: str | Column,
    lookback: int = 24,
    horizon: int = 72,
    series: Sequence[str] = ("series_id",),
    ts: str = "datetime",
) -> DataFrame:
    """``x`` = ``lookback`` rows before, ``y`` = this and the following rows.

    Start positions run from ``lookback`` up to, not including, n - horizon.
    """
    w = _lane(series, ts)
    item = quoted(value) if isinstance(value, str) else value
    size = Window.partitionBy(*[quoted(s) for s in series])
    return (
        df.withColumns(
            {
                "x": F.collect_list(item).over(w.rowsBetween(-lookback, -1)),
                "y": F.collect_list(item).over(w.rowsBetween(0, horizon - 1)),
                "_start": F.row_number().over(w) - 1,
                "_n": F.count(F.lit(1)).over(size),
            }
        )
        .filter((F.col("_start") >= lookback) & (F.col("_start") < F.col("_n") - horizon))
        .drop("_start", "_n")
    )


def chrono_split(
    df: DataFrame, order: Sequence[str], share: float = 0.8, by: Sequence[str] = (), numbered: bool = False
) -> DataFrame:
    """``split`` = train for the first int(share·n) rows, then val.

    ``numbered`` adds the row number ``row_no`` and group size ``n_rows``, at the
    price of ordering all rows.
    """
    if numbered:
        rows = row_numbers(df, list(order), by, name="row_no", total="n_rows")
        first = F.col("row_no") <= F.floor(F.lit(share) * F.col("n_rows"))
        return rows.withColumn("split", F.when(first, "train").otherwise("val"))
    marked = leading_share(df, order, share, by, "_first")
    return marked.withColumn("split", F.when(F.col("_first"), "train").otherwise("val")).drop("_first")


def half_split(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``half`` = reference for the first n // 2 rows, then current."""
    marked = leading_share(df, order, 0.5, by, "_first")
    return marked.withColumn("half", F.when(F.col("_first"), "reference").otherwise("current")).drop("_first")


def walk_forward_folds(
    df: DataFrame, ts: str = "datetime", series: Sequence[str] = ("series_id",), window: int = 168
) -> DataFrame:
    """Position, block and the fold whose test set holds the row.

    Fold k trains on blocks 0..k and tests on block k + 1; a block that would
    run past the end belongs to no test set.
    """
    w = _lane(series, ts)
    whole = Window.partitionBy(*[quoted(s) for s in series])
    position = F.row_number().over(w) - 1
    placed = df.withColumns({"position": position, "_n": F.count(F.lit(1)).over(whole)})
    block = F.floor(F.col("position") / window)
    full = (block + 1) * window <= F.col("_n")
    return placed.withColumns(
        {
            "block": block,
            "test_fold": F.when((block >= 1) & full, block - 1),
        }
    ).drop("_n")


def fold_sizes(placed: DataFrame, series: Sequence[str] = ("series_id",), window: int = 168) -> DataFrame:
    """Train and test row counts per fold, from rows with their ``test_fold``."""
    return (
        placed.filter(F.col("test_fold").isNotNull())
        .groupBy(*series, F.col("test_fold").alias("fold"))
        .agg(
            F.count(F.lit(1)).alias("test_rows"),
            F.min("position").alias("train_rows"),
        )
    )


def forecast_calendar(
    last: DataFrame, ts: str = "datetime", steps: int = 72, hours_col: str = "step"
) -> DataFrame:
    """The hours that follow each row's timestamp, numbered from 1."""
    first = quoted(ts) + F.expr("interval 1 hour")
    final = quoted(ts) + F.expr(f"interval {steps} hours")
    hours = F.sequence(first, final, F.expr("interval 1 hour"))
    kept = [quoted(c) for c in last.columns if c != ts]
    return last.select(*kept, F.posexplode(hours).alias("_pos", "forecast_ts")).select(
        *kept,
        (F.col("_pos") + 1).alias(hours_col),
        "forecast_ts",
        F.date_format("forecast_ts", "yyyy-MM-dd HH:mm:ss").alias("forecast_date"),
    )


def forecast_requests(
    requests: DataFrame,
    features: str = "input_features",
    last_timestamp: str = "last_timestamp",
    steps: str = "steps",
) -> DataFrame:
    """Validate forecast requests and lay out their dates.

    Bad requests keep one row with empty dates and an ``error: ...`` status.
    """
    text = F.col(last_timestamp)
    parsed = F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    status = (
        F.when(F.coalesce(F.size(features), F.lit(0)) <= 0, "error: No input_features provided.")
        .when(F.coalesce(text, F.lit("")) == "", "error: Missing last_timestamp.")
        .when(parsed.isNull(), "error: last_timestamp is not yyyy-MM-dd HH:mm:ss")
        .otherwise("success")
    )
    wanted = F.coalesce(F.col(steps), F.lit(72))
    dates = F.transform(
        F.sequence(F.lit(1), F.greatest(wanted, F.lit(1))),
        lambda i: F.date_format(
            parsed + F.make_dt_interval(hours=i), "yyyy-MM-dd HH:mm:ss"
        ),
    )
    empty = F.array().cast("array<string>")
    return requests.withColumn("status", status).withColumn(
        "forecast_dates", F.when((F.col("status") == "success") & (wanted > 0), dates).otherwise(empty)
    )


def seasonal_naive(
    df: DataFrame,
    value: str,
    steps: int = 72,
    season: int = 24,
    series: Sequence[str] = ("series_id",),
    ts: str = "datetime",
) -> DataFrame:
    """Forecast each hour by the same hour of the last ``season`` hours known.

    The history is cut to the last season by time, then joined on the hour of
    the cycle, so the join reads at most ``season`` rows per series.
    """
    by = [quoted(s) for s in series]
    last = df.groupBy(*by).agg(F.max(quoted(ts)).alias(ts))
    future = forecast_calendar(last, ts, steps).withColumn(
        "_slot", F.pmod(F.col("step") - 1, F.lit(season))
    )
    history = (
        df.join(last.withColumnRenamed(ts, "_last"), list(series))
        .filter(quoted(ts) > F.col("_last") - F.expr(f"interval {season} hours"))
        .select(
            *by,
            (
                F.lit(season - 1)
                - F.floor((F.unix_seconds(F.col("_last").cast("timestamp")) - F.unix_seconds(quoted(ts).cast("timestamp"))) / 3600)
            ).alias("_slot"),
            quoted(value).alias("forecast"),
        )
    )
    return future.join(history, [*series, "_slot"], "left").drop("_slot")
