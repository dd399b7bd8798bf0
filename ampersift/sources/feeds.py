"""Flatteners for landed JSON feeds: weather, air quality, carbon, mix, prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampersift.functions.columns import quoted

# Payload series and their table columns.
WEATHER_SERIES = {
    "temperature_2m": "temperature_C",
    "relative_humidity_2m": "humidity_%",
    "wind_speed_10m": "wind_speed_mps",
    "cloudcover": "cloud_cover_%",
    "shortwave_radiation": "solar_radiation_Wm2",
}
AIR_QUALITY_SERIES = {
    "pm10": "pm10",
    "pm2_5": "pm2_5",
    "carbon_monoxide": "co",
    "nitrogen_dioxide": "no2",
    "sulphur_dioxide": "so2",
    "ozone": "o3",
    "us_aqi": "aqi_us",
}
FUELS = ("biomass", "imports", "gas", "nuclear", "solar", "wind")
CARBON_PAYLOAD = (
    "struct<data: array<struct<from: string, "
    "intensity: struct<actual: int, forecast: int, index: string>>>>"
)
MIX_PAYLOAD = "struct<data: struct<from: string, generationmix: array<struct<fuel: string, perc: double>>>>"
PRODUCT_PAYLOAD = "struct<results: array<struct<code: string, links: array<struct<href: string>>>>>"
RATE_PAYLOAD = "struct<results: array<struct<valid_from: string, value_inc_vat: double>>, next: string>"


def feed_time(text: Column) -> Column:
    """ISO feed times as zone-less UTC; unreadable text becomes NULL."""
    no_seconds = F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mmXXX"))
    return F.coalesce(F.try_to_timestamp(text), no_seconds).cast("timestamp_ntz")


def parallel_arrays(
    df: DataFrame, payload: str, series: dict[str, str], keep: Sequence[str] = (), ts: str = "datetime"
) -> DataFrame:
    """``hourly: {time: [...], <series>: [...]}`` payloads as one row per hour."""
    fields = ", ".join(f"`{s}`: array<double>" for s in series)
    schema = f"struct<hourly: struct<time: array<string>, {fields}>>"
    parsed = df.select(*[quoted(k) for k in keep], F.from_json(quoted(payload), schema).alias("_p"))
    none = F.array().cast("array<double>")
    values = [F.coalesce(F.col(f"_p.hourly.`{s}`"), none).alias(s) for s in series]
    zipped = F.arrays_zip(F.col("_p.hourly.time").alias("time"), *values)
    rows = parsed.select(*[quoted(k) for k in keep], F.explode(zipped).alias("_h"))
    return rows.select(
        *[quoted(k) for k in keep],
        feed_time(F.col("_h.time")).alias(ts),
        *[F.col(f"_h.`{s}`").alias(name) for s, name in series.items()],
    )


def carbon_records(
    df: DataFrame, payload: str, day: Column | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Carbon records: those without ``from`` are dropped, missing intensities
    stay NULL; ``day`` keeps one date. No records still gives the four columns."""
    parsed = df.select(*[quoted(k) for k in keep], F.from_json(quoted(payload), CARBON_PAYLOAD).alias("_p"))
    rows = parsed.select(*[quoted(k) for k in keep], F.explode("_p.data").alias("_r"))
    out = rows.filter(F.coalesce(F.length("_r.from"), F.lit(0)) > 0).select(
        *[quoted(k) for k in keep],
        feed_time(F.col("_r.from")).alias("datetime"),
        F.col("_r.intensity.actual").alias("carbon_intensity_actual"),
        F.col("_r.intensity.forecast").alias("carbon_intensity_forecast"),
        F.col("_r.intensity.index").alias("carbon_index"),
    )
    return out if day is None else out.filter(F.to_date("datetime") == day)


def pivot_mix(
    long: DataFrame,
    ts: str = "datetime",
    fuel: str = "fuel",
    share: str = "perc",
    fuels: Sequence[str] = FUELS,
    name: str = "uk_gen_{}_%",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Fuel shares as one column per listed fuel; other fuels are ignored.

    The column list is fixed, so no pass is spent on finding the fuels.
    """
    label = F.replace(F.lower(quoted(fuel)), F.lit(" "), F.lit("_"))
    return long.groupBy(*[quoted(k) for k in keep], quoted(ts)).agg(
        *[F.max(F.when(label == f, quoted(share))).alias(name.format(f)) for f in fuels]
    )


def generation_mix(df: DataFrame, payload: str, fuels: Sequence[str] = FUELS) -> DataFrame:
    """Generation-mix payloads as one wide row each."""
    parsed = df.select(F.from_json(quoted(payload), MIX_PAYLOAD).alias("_p"))
    long = parsed.select(
        feed_time(F.col("_p.data.from")).alias("datetime"), F.inline("_p.data.generationmix")
    )
    return pivot_mix(long, fuels=fuels)


def tariff_of(products: DataFrame, payload: str, family: str = "AGILE") -> DataFrame:
    """Product and tariff code of the first product of the family.

    The tariff is the next-to-last path part of the first tariff link, or is
    made from the product code. Without any such product this is an error.
    """
    parsed = products.select(F.from_json(quoted(payload), PRODUCT_PAYLOAD).alias("_p"))
    match = F.filter(F.col("_p.results"), lambda p: p["code"].contains(family))
    picked = parsed.select(F.get(match, 0).alias("p")).select(
        F.when(F.col("p").isNull(), F.raise_error(F.lit("No matching tariffs found")))
        .otherwise(F.col("p.code"))
        .alias("product_code"),
        F.get(
            F.filter(F.col("p.links"), lambda x: x["href"].contains("electricity-tariffs")), 0
        )["href"].alias("href"),
    )
    from_link = F.try_element_at(F.split("href", "/"), F.lit(-2))
    return picked.select(
        "product_code",
        F.coalesce(
            F.when(F.length(from_link) > 0, from_link),
            F.concat(F.lit("E-1R-"), F.col("product_code"), F.lit("-A")),
        ).alias("tariff_code"),
    )


def price_rates(
    df: DataFrame, payload: str, day: Column | None = None, price: str = "retail_price_£_per_kWh"
) -> DataFrame:
    """Unit-rate pages as (datetime, price per kWh); pence become pounds.

    ``df`` holds one landed page per row, so a paged result is simply many rows.
    """
    rows = df.select(F.from_json(quoted(payload), RATE_PAYLOAD).alias("_p")).select(F.inline("_p.results"))
    out = rows.select(
        feed_time(F.col("valid_from")).alias("datetime"), (F.col("value_inc_vat") / 100).alias(price)
    )
    return out if day is None else out.filter(F.to_date("datetime") == day)
