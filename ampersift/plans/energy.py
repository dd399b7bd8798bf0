"""The daily and historical energy jobs as lazy DataFrame plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampersift.functions.columns import at_grain, quoted
from ampersift.operators import features as fe
from ampersift.operators.joins import (
    asof_nearest,
    attach_single_row,
    fill_from_side,
    outer_merge,
    rows_after,
    rows_not_in,
)
from ampersift.operators.upserts import append_keep_first, append_keep_last, keep_first
from ampersift.sources.daily import DailyTable

# Inputs standardised for the selected-feature table.
CONTRACT_SCALED = tuple(
    n.removeprefix("scaled_") for n in fe.SELECTED_FEATURES if n.startswith("scaled_")
)


def merge_sources(
    weather: DataFrame,
    air: DataFrame,
    carbon: DataFrame,
    mix_row: DataFrame | None,
    prices: DataFrame,
    price: str = fe.PRICE,
    ts: str = "datetime",
    tolerance_seconds: int = 1800,
) -> DataFrame:
    """Outer merge of the hourly feeds, nearest price, and the current mix on every row."""
    merged = outer_merge([weather, air, carbon], [ts])
    priced = asof_nearest(merged, prices, [price], ts, tolerance_seconds=tolerance_seconds)
    return priced if mix_row is None else attach_single_row(priced, mix_row)


def one_day(merged: DataFrame, as_of: Column | str, ts: str = "datetime") -> DataFrame:
    """Full-hour rows of the day before ``as_of``."""
    return fe.day_before(merged, as_of, ts).filter(F.minute(quoted(ts)) == 0)


def collect_day(
    existing: DataFrame | None, merged: DataFrame, as_of: Column | str, ts: str = "datetime"
) -> DataFrame:
    """Append one day's merged rows to the stored table, newest row per hour."""
    day = one_day(merged, as_of, ts)
    return day if existing is None else append_keep_last(existing, day, [ts])


def append_historical(
    existing: DataFrame | None, new: DataFrame, as_of: Column | str, ts: str = "datetime"
) -> DataFrame:
    """First run stores everything; later runs append the previous day only."""
    if existing is None:
        return new
    return append_keep_last(existing, fe.day_before(new, as_of, ts), [ts])


def append_day(table: DailyTable, new: DataFrame, as_of: Column | str) -> list[str]:
    """``append_historical`` on a table stored by day: an empty table takes
    everything, a later run the previous day only, and only that day is rewritten."""
    first = table.read().isEmpty()
    return table.append(new if first else fe.day_before(new, as_of, table.ts))


def historical_merge(
    weather: DataFrame,
    air: DataFrame,
    carbon: DataFrame,
    prices: DataFrame,
    mix: DataFrame,
    ts: str = "datetime",
) -> DataFrame:
    """Backfill: four-way outer merge, filled mix, floored to hours, first row kept."""
    merged = outer_merge([weather, air, carbon, prices], [ts])
    mixed = [c for c in mix.columns if c != ts]
    filled = fill_from_side(merged, mix, mixed, ts)
    floored = filled.withColumn("_exact", quoted(ts)).withColumn(ts, at_grain(quoted(ts), "hour"))
    return keep_first(floored, [ts], ["_exact"]).drop("_exact")


def engineer(df: DataFrame, ts: str = "datetime") -> DataFrame:
    """Calendar, interaction and log columns of the energy table."""
    return fe.log_transforms(fe.interaction_features(fe.temporal_features(df, ts)))


def update_features(
    raw: DataFrame,
    previous: DataFrame | None,
    ts: str = "datetime",
    fit_scope: str = "batch",
    series: Sequence[str] = (),
) -> DataFrame:
    """Feature rows for timestamps (of a series) not seen before, added to the stored ones.

    ``fit_scope="batch"`` standardises with the statistics of the new rows,
    ``"global"`` with those of the whole raw table.
    """
    new = raw if previous is None else rows_not_in(raw, previous, [*series, ts])
    made = engineer(new, ts)
    scaled = fe.standard_scale(made, fe.DAILY_SCALED, engineer(raw, ts) if fit_scope == "global" else None)
    return scaled if previous is None else append_keep_first(previous, scaled, [*series, ts])


def contract_features(df: DataFrame, series: Sequence[str] = (), ts: str = "datetime") -> DataFrame:
    """All columns of the selected-feature table, for every raw row.

    Lags and rolling means run over the raw history, so new rows get them too.
    """
    labels = {fe.PRICE: "price", fe.CARBON: "carbon", fe.WIND: "wind"}
    single = df.withColumn("_series", F.lit(0)) if not series else df
    by = list(series) or ["_series"]
    lagged = fe.lag_features(
        single, {fe.PRICE: [1, 24], fe.CARBON: [1], fe.WIND: [1, 24]}, by, ts, labels
    )
    rolled = fe.rolling_features(lagged, [fe.PRICE, fe.CARBON], 24, by, ts, names=labels)
    scaled = fe.standard_scale(engineer(rolled, ts), CONTRACT_SCALED)
    return scaled.select(*[quoted(s) for s in series], *[quoted(c) for c in fe.SELECTED_FEATURES])


def update_selected(
    engineered: DataFrame, selected: DataFrame | None, ts: str = "datetime", series: Sequence[str] = ()
) -> DataFrame:
    """Append engineered rows later than the stored ones (of their series), in the fixed column order."""
    contract = [*series, *fe.SELECTED_FEATURES]
    if selected is None:
        return fe.select_features(engineered, contract)
    fresh = fe.select_features(rows_after(engineered, selected, ts, series), contract)
    return append_keep_last(selected, fresh, [*series, ts])
