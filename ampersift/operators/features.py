"""Feature columns of the hourly energy table."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampersift.functions.columns import (
    as_col,
    clip_low,
    is_missing,
    known,
    nan_to_null,
    quoted,
    ratio,
    scale_by,
)

PRICE = "retail_price_£_per_kWh"
CARBON = "carbon_intensity_actual"
WIND = "uk_gen_wind_%"
SOLAR = "uk_gen_solar_%"
GAS = "uk_gen_gas_%"
TEMPERATURE = "temperature_C"
RADIATION = "solar_radiation_Wm2"

# Columns that get a log1p twin.
LOG_COLUMNS = (
    "so2",
    "pm2_5",
    "co",
    "no2",
    "pm10",
    "solar_radiation_Wm2",
    "uk_gen_solar_%",
    "aqi_us",
)

# Columns standardised by the daily job.
DAILY_SCALED = (
    "temperature_C",
    "wind_speed_mps",
    "humidity_%",
    "carbon_intensity_actual",
    "uk_gen_wind_%",
    "uk_gen_gas_%",
)

# Column order of the selected-feature table.
SELECTED_FEATURES = (
    "datetime",
    "scaled_renewable_pct",
    "scaled_price_lag_1h",
    "scaled_price_lag_24h",
    "hour",
    "hour_sin",
    "scaled_carbon_lag_1h",
    "hour_cos",
    "scaled_log_solar_radiation_Wm2",
    "scaled_carbon_intensity_actual",
    "scaled_log_no2",
    "scaled_uk_gen_biomass_%",
    "is_peak_hour",
    "scaled_wind_lag_24h",
    "scaled_carbon_per_price",
    "scaled_fossil_pct",
    "scaled_uk_gen_wind_%",
    "scaled_log_uk_gen_solar_%",
    "scaled_carbon_rolling_24h_mean",
    "scaled_uk_gen_nuclear_%",
    "scaled_uk_gen_gas_%",
    "scaled_carbon_intensity_forecast",
    "scaled_wind_speed_mps",
    "scaled_temperature_C",
    "scaled_price_rolling_24h_mean",
    "scaled_wind_lag_1h",
    "retail_price_£_per_kWh",
)


def temporal_features(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """Calendar parts, flags and cyclical encodings of ``ts``."""
    t = quoted(ts)
    hour, month = F.hour(t), F.month(t)
    turn = 2 * math.pi
    return df.withColumns(
        {
            "hour": hour,
            "day_of_week": F.weekday(t),
            "month": month,
            "day_of_month": F.dayofmonth(t),
            "week_of_year": F.weekofyear(t),
            "is_weekend": (F.weekday(t) >= 5).cast("int"),
            "is_peak_hour": hour.between(17, 21).cast("int"),
            "is_night": ((hour == 23) | hour.between(0, 6)).cast("int"),
            "hour_sin": F.sin(F.lit(turn) * hour / 24),
            "hour_cos": F.cos(F.lit(turn) * hour / 24),
            "month_sin": F.sin(F.lit(turn) * month / 12),
            "month_cos": F.cos(F.lit(turn) * month / 12),
        }
    )


def interaction_features(
    df: DataFrame,
    wind: str = WIND,
    solar: str = SOLAR,
    gas: str = GAS,
    temperature: str = TEMPERATURE,
    radiation: str = RADIATION,
    carbon: str = CARBON,
    price: str = PRICE,
) -> DataFrame:
    """Generation shares, degree demand and carbon per price."""
    c = quoted
    return df.withColumns(
        {
            "renewable_pct": c(wind) + c(solar),
            "fossil_pct": c(gas),
            "heating_demand": clip_low(F.lit(18.0) - c(temperature), 0.0),
            "cooling_demand": clip_low(c(temperature) - F.lit(22.0), 0.0),
            "wind_solar_combined": c(wind) * c(radiation),
            "carbon_per_price": ratio(c(carbon).cast("double"), c(price) + F.lit(1e-6)),
        }
    )


def log_transforms(
    df: DataFrame, columns: Sequence[str] = LOG_COLUMNS, missing_as_zero: bool = True
) -> DataFrame:
    """``log1p`` twins of those ``columns`` that are present."""
    def filled(name: str) -> Column:
        return F.coalesce(known(quoted(name)), F.lit(0.0)) if missing_as_zero else known(quoted(name))

    return df.withColumns({f"log_{n}": F.log1p(filled(n)) for n in columns if n in df.columns})


def standard_scale(
    df: DataFrame,
    columns: Sequence[str],
    fit_on: DataFrame | None = None,
    prefix: str = "scaled_",
) -> DataFrame:
    """Zero mean, unit population deviation; missing counts as zero.

    Statistics come from ``fit_on`` (by default the frame itself) through one
    aggregate that reaches the rows as a scalar subquery, not as a join.
    """
    present = [c for c in columns if c in df.columns]
    if not present:
        return df
    source = df if fit_on is None else fit_on

    def filled(name: str) -> Column:
        return F.coalesce(known(quoted(name)), F.lit(0.0))

    fitted = source.agg(
        F.struct(
            *[F.avg(filled(c)).alias(f"m{i}") for i, c in enumerate(present)],
            *[F.stddev_pop(filled(c)).alias(f"s{i}") for i, c in enumerate(present)],
        ).alias("fit")
    ).scalar()
    rows = df.withColumn("_fit", fitted)
    return rows.withColumns(
        {
            f"{prefix}{c}": scale_by(filled(c), F.col(f"_fit.m{i}"), F.col(f"_fit.s{i}"))
            for i, c in enumerate(present)
        }
    ).drop("_fit")


def minmax_fit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row ``fit`` with the smallest value and range of every column."""
    return df.agg(
        F.struct(
            *[F.min(known(quoted(c))).alias(f"lo{i}") for i, c in enumerate(columns)],
            *[(F.max(known(quoted(c))) - F.min(known(quoted(c)))).alias(f"range{i}") for i, c in enumerate(columns)],
        ).alias("fit")
    )


def minmax_scale(df: DataFrame, columns: Sequence[str], prefix: str = "mm_") -> DataFrame:
    """Scale to [0, 1]; a constant column becomes 0, a missing value stays missing."""
    rows = df.withColumn("_fit", minmax_fit(df, columns).scalar())
    return rows.withColumns(
        {
            f"{prefix}{c}": scale_by(known(quoted(c)), F.col(f"_fit.lo{i}"), F.col(f"_fit.range{i}"))
            for i, c in enumerate(columns)
        }
    ).drop("_fit")


def minmax_restore(
    df: DataFrame, fit: DataFrame, columns: Sequence[str], prefix: str = "mm_"
) -> DataFrame:
    """Undo ``minmax_scale`` with the row made by ``minmax_fit``."""
    rows = df.withColumn("_fit", fit.scalar())
    return rows.withColumns(
        {
            c: quoted(f"{prefix}{c}") * F.col(f"_fit.range{i}") + F.col(f"_fit.lo{i}")
            for i, c in enumerate(columns)
        }
    ).drop("_fit")


def _in_series(series: Sequence[str], ts: str) -> Window:
    # One row per hour and series is the contract of the hourly table, which
    # bounds a window partition by the hours covered (8,784 a year), not by
    # the size of the raw data behind it.
    return Window.partitionBy(*[quoted(s) for s in series]).orderBy(quoted(ts))


def lag_features(
    df: DataFrame,
    lags: dict[str, Sequence[int]],
    series: Sequence[str] = ("series_id",),
    ts: str = "datetime",
    names: dict[str, str] | None = None,
) -> DataFrame:
    """``<name>_lag_<k>h``: the value k rows earlier in the series."""
    w = _in_series(series, ts)
    labels = names or {}
    return df.withColumns(
        {
            f"{labels.get(c, c)}_lag_{k}h": F.lag(quoted(c), k).over(w)
            for c, steps in lags.items()
            for k in steps
        }
    )


def lag_by_time(
    df: DataFrame,
    lags: dict[str, Sequence[int]],
    series: Sequence[str] = ("series_id",),
    ts: str = "datetime",
) -> DataFrame:
    """Gap-safe lags: the value exactly k hours earlier, through equi-joins."""
    keys = [*series, ts]
    out = df
    for k in sorted({k for steps in lags.values() for k in steps}):
        wanted = [c for c, steps in lags.items() if k in steps]
        earlier = df.select(
            *[quoted(s) for s in series],
            (quoted(ts) + F.expr(f"interval {k} hours")).alias(ts),
            *[quoted(c).alias(f"{c}_lag_{k}h") for c in wanted],
        )
        out = out.join(earlier, keys, "left")
    return out


def rolling_features(
    df: DataFrame,
    columns: Sequence[str],
    window: int = 24,
    series: Sequence[str] = ("series_id",),
    ts: str = "datetime",
    include_current: bool = True,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Trailing mean and sample deviation, NULL until the window is full.

    ``include_current=False`` ends the window one row earlier, which keeps the
    current target out of its own feature.
    """
    end = 0 if include_current else -1
    w = _in_series(series, ts).rowsBetween(end - window + 1, end)
    labels = names or {}

    def when_full(value: Column, figure: Column) -> Column:
        return F.when(F.count(value).over(w) == window, figure)

    made = {}
    for c in columns:
        label, value = labels.get(c, c), known(quoted(c))
        made[f"{label}_rolling_{window}h_mean"] = when_full(value, F.avg(value).over(w))
        made[f"{label}_rolling_{window}h_std"] = when_full(value, F.stddev_samp(value).over(w))
    return df.withColumns(made)


def drop_incomplete(df: DataFrame, target: str) -> DataFrame:
    """Rows with a target and no missing value in any column."""
    return nan_to_null(df).na.drop(subset=[target]).na.drop("any")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """Fail with ``message`` when the frame is empty."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def select_features(df: DataFrame, contract: Sequence[str] = SELECTED_FEATURES) -> DataFrame:
    """Project to a fixed column list; a missing column is an error."""
    lost = [c for c in contract if c not in df.columns]
    if lost:
        raise ValueError(f"columns missing from the table: {lost}")
    return df.select(*[quoted(c) for c in contract])


def columns_with_prefix(df: DataFrame, prefix: str = "scaled_", also: Sequence[str] = ()) -> DataFrame:
    """Columns that start with ``prefix`` or are listed in ``also``."""
    return df.select(*[quoted(c) for c in df.columns if c.startswith(prefix) or c in also])


def last_n_days(df: DataFrame, days: int = 90, ts: str = "datetime") -> DataFrame:
    """Rows later than ``days`` before the latest timestamp (strictly)."""
    latest = df.agg(F.max(quoted(ts))).scalar()
    return df.filter(quoted(ts) > latest - F.expr(f"interval {days} days"))


def time_range(df: DataFrame, start: str, end: str, ts: str = "datetime") -> DataFrame:
    """Rows from ``start`` to ``end``, both inclusive; a bare end date is its midnight."""
    kind = df.schema[ts].dataType
    return df.filter(quoted(ts).between(F.lit(start).cast(kind), F.lit(end).cast(kind)))


def day_before(df: DataFrame, as_of: Column | str, ts: str = "datetime") -> DataFrame:
    """Rows on the calendar day before ``as_of``."""
    day = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    start = F.date_sub(day, 1).cast("timestamp_ntz")
    kind = df.schema[ts].dataType
    # a range on the raw column, so the filter can reach the scan
    return df.filter(
        (quoted(ts) >= start.cast(kind)) & (quoted(ts) < day.cast("timestamp_ntz").cast(kind))
    )


def price_category(price: str | Column) -> Column:
    p = as_col(price)
    return F.when(p < 0.3, "Low").when(p < 0.7, "Medium").when(p.isNotNull(), "High")


def day_part(hour: str | Column) -> Column:
    h = as_col(hour)
    return (
        F.when(h.between(0, 5), "night")
        .when(h.between(6, 11), "morning")
        .when(h.between(12, 17), "day")
        .otherwise("evening")
    )


def completeness(
    df: DataFrame,
    columns: Sequence[str],
    ts: str = "datetime",
    limits: dict[str, int] | None = None,
) -> DataFrame:
    """Row count, time range, missing count per column and a warning flag."""
    allowed = limits or {}
    aggregates = [
        F.count(F.lit(1)).alias("n_rows"),
        F.min(quoted(ts)).alias("first_ts"),
        F.max(quoted(ts)).alias("last_ts"),
    ] + [F.count_if(is_missing(df, c)).alias(f"missing_{c}") for c in columns]
    over = [quoted(f"missing_{c}") > n for c, n in allowed.items()]
    flag = F.lit(False)
    for test in over:
        flag = flag | test
    return df.agg(*aggregates).withColumn("warn", flag)


def missing_hours(df: DataFrame, column: str, ts: str = "datetime") -> DataFrame:
    """The timestamps where ``column`` is missing."""
    return df.filter(is_missing(df, column)).select(quoted(ts))
