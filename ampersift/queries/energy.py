"""Feeds, joins, features and splits on the hourly roll-up of events."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ampersift.functions.columns import at_grain
from ampersift.operators import features as fe
from ampersift.operators import joins, rollups, sequences, stats, upserts
from ampersift.plans import energy as plans
from ampersift.queries import registry
from ampersift.queries.registry import HOURLY, Tables, query
from ampersift.session import freeze, scratch_path
from ampersift.sources import feeds, tables
from ampersift.sources.daily import DailyTable

# Averages of two-decimal values end on a 5 too often for six digits.
R = partial(registry.R, digits=9)
r = partial(registry.r, digits=9)
rounded = partial(registry.rounded, digits=9)

MEASURES = ("price", "carbon", "wind", "radiation", "temperature")
SQL_MEASURES = ", ".join(f"{R(m)} AS {m}" for m in MEASURES)


@query("scan_hourly", f"WITH {HOURLY} SELECT series_id, ts, {SQL_MEASURES} FROM hourly WHERE ts IS NOT NULL")
def scan_hourly(t: Tables):
    return rounded(t.hourly.filter(F.col("ts").isNotNull()), *MEASURES)


@query("sink_roundtrip", f"WITH {HOURLY} SELECT series_id, ts, {R('price')} AS price, carbon FROM hourly")
def sink_roundtrip(t: Tables):
    """Written as CSV and read back through a typed schema."""
    path = scratch_path(t.spark, "hourly-csv")
    table = t.hourly.select("series_id", "ts", r("price").alias("price"), "carbon")
    tables.write_csv(table, path, ts="ts")
    return tables.read_hourly_csv(t.spark, path, "series_id string, ts timestamp_ntz, price double, carbon double")


@query(
    "jsonl_scan",
    """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k
    FROM events WHERE trim(props) <> ''
    """,
)
def jsonl_scan(t: Tables):
    return tables.json_lines(t.events.select("event_id", "props"), "props", "k int")


@query(
    "flatten_parallel_arrays",
    f"""
    WITH {HOURLY} SELECT series_id, ts, {R('temperature')} AS "temperature_C", {R('wind')} AS wind_speed_mps
    FROM hourly
    """,
)
def flatten_parallel_arrays(t: Tables):
    """Daily payloads of parallel arrays, at most 24 entries each."""
    hours = F.sort_array(F.collect_list(F.struct("ts", "temperature", "wind")))
    day = t.hourly.groupBy("series_id", F.to_date("ts").alias("day")).agg(hours.alias("h"))
    stamp = F.transform("h", lambda x: F.date_format(x["ts"], "yyyy-MM-dd'T'HH:mm"))
    payload = F.to_json(
        F.struct(
            F.struct(
                stamp.alias("time"),
                F.col("h.temperature").alias("temperature_2m"),
                F.col("h.wind").alias("wind_speed_10m"),
            ).alias("hourly")
        )
    )
    series = {"temperature_2m": "temperature_C", "wind_speed_10m": "wind_speed_mps"}
    rows = feeds.parallel_arrays(
        day.select("series_id", payload.alias("payload")), "payload", series, keep=["series_id"], ts="ts"
    )
    return rounded(rows, "temperature_C", "wind_speed_mps")


@query(
    "flatten_nested_records",
    f"""
    WITH {HOURLY}
    SELECT series_id, ts AS datetime,
           CASE WHEN hour(ts) % 6 <> 1 AND carbon > 1 THEN CAST(carbon AS INT) END AS carbon_intensity_actual,
           CASE WHEN hour(ts) % 6 <> 1 THEN CAST(carbon AS INT) + 1 END AS carbon_intensity_forecast,
           CASE WHEN hour(ts) % 6 <> 1 THEN CASE WHEN carbon > 2 THEN 'high' ELSE 'low' END END AS carbon_index
    FROM hourly WHERE hour(ts) % 6 <> 0
    """,
)
def flatten_nested_records(t: Tables):
    """Records without ``from`` (each sixth hour) or without intensity."""
    hour, n = F.hour("ts"), F.col("carbon").cast("int")
    intensity = F.when(
        hour % 6 != 1,
        F.struct(
            F.when(n > 1, n).alias("actual"),
            (n + 1).alias("forecast"),
            F.when(n > 2, "high").otherwise("low").alias("index"),
        ),
    )
    start = F.when(hour % 6 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm'Z'"))
    record = F.struct(start.alias("from"), intensity.alias("intensity"))
    day = t.hourly.groupBy("series_id", F.to_date("ts").alias("day")).agg(F.collect_list(record).alias("data"))
    payload = F.to_json(F.struct("data"))
    return feeds.carbon_records(day.select("series_id", payload.alias("payload")), "payload", keep=["series_id"])


MIX_KINDS = ("click", "error", "purchase", "view")
SQL_MIX = ", ".join(
    f"{R(f'max(CASE WHEN event_type = {chr(39)}{k}{chr(39)} THEN 100.0 * n / total END)')} AS mix_{k}"
    for k in MIX_KINDS
)
MIX = """counts AS (
  SELECT date_trunc('hour', ts) AS ts, event_type, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2),
  shares AS (SELECT *, sum(n) OVER (PARTITION BY ts) AS total FROM counts)"""


def hourly_mix(t: Tables):
    """Percent of each hour's events by type, as (ts, fuel, perc) rows."""
    counts = rollups.hourly(t.events, ["event_type"], {"n": F.count(F.lit(1))})
    totals = counts.groupBy("ts").agg(F.sum("n").alias("total"))
    share = F.col("n") * 100.0 / F.col("total")
    return counts.join(totals, "ts").select("ts", F.upper("event_type").alias("fuel"), share.alias("perc"))


@query("pivot_mix", f"WITH {MIX} SELECT ts, {SQL_MIX} FROM shares GROUP BY ts")
def pivot_mix(t: Tables):
    """One type is not on the list and gets no column."""
    wide = feeds.pivot_mix(hourly_mix(t), ts="ts", fuels=MIX_KINDS, name="mix_{}")
    return rounded(wide, *[f"mix_{k}" for k in MIX_KINDS])


@query(
    "price_flatten",
    f"""
    WITH p AS (SELECT n_name FROM nation WHERE n_regionkey = 1 ORDER BY n_nationkey LIMIT 1),
    d AS (SELECT max(CAST(ts AS DATE)) AS day FROM events)
    SELECT 'AGILE-' || n_name AS product_code, 'E-1R-AGILE-' || n_name || '-C' AS tariff_code,
           date_trunc('second', ts) AS datetime, {R('value / 100')} AS price
    FROM events, p, d WHERE CAST(ts AS DATE) = d.day
    """,
)
def price_flatten(t: Tables):
    """Products from nations, rate pages from events, the last day kept."""
    code = F.when(F.col("n_regionkey") == 1, F.concat(F.lit("AGILE-"), "n_name")).otherwise(
        F.concat(F.lit("FIX-"), "n_name")
    )
    link = F.concat(F.lit("https://api.test/electricity-tariffs/E-1R-"), code, F.lit("-C/rates"))
    product = F.struct("n_nationkey", code.alias("code"), F.array(F.struct(link.alias("href"))).alias("links"))
    products = t.nation.agg(F.to_json(F.struct(F.sort_array(F.collect_list(product)).alias("results"))).alias("payload"))
    rate = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("valid_from"), F.col("value").alias("value_inc_vat")
    )
    pages = t.events.select("ts", F.to_json(F.struct(F.array(rate).alias("results"))).alias("payload"))
    last = t.events.agg(F.to_date(F.max("ts"))).scalar()
    prices = feeds.price_rates(pages, "payload", last, price="price")
    return joins.attach_single_row(rounded(prices, "price"), feeds.tariff_of(products, "payload"))


@query(
    "metric_upsert",
    """
    WITH h AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn, count(*) OVER () AS n FROM events)
    SELECT event_type AS key, arg_max(value, event_id) AS value
    FROM events GROUP BY event_type
    """,
)
def metric_upsert(t: Tables):
    """Two snapshots of the latest value per type; the later one wins."""
    e = t.events
    middle = e.agg(F.expr("timestamp_micros(cast((unix_micros(cast(min(ts) as timestamp)) + unix_micros(cast(max(ts) as timestamp))) / 2 as bigint))")).scalar()
    first = F.col("ts").cast("timestamp") <= middle

    def snapshot(rows):
        return rows.groupBy(F.col("event_type").alias("key")).agg(
            F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("event_id")
        )

    merged = tables.metric_upsert(snapshot(e.filter(first)), snapshot(e.filter(~first)), order=["event_id"])
    return merged.select("key", "value")


@query(
    "metric_exposition",
    """
    SELECT CASE WHEN event_type = 'error' THEN 'rmse' ELSE event_type || '_total' END AS metric,
           CASE WHEN event_type = 'error' THEN 'Root Mean Squared Error of predictions'
                ELSE 'No description available' END AS description,
           CASE WHEN event_type = 'error' THEN 'rmse' ELSE event_type || '_total' END || ' ' || CAST(count(*) AS VARCHAR) AS line
    FROM events GROUP BY event_type
    """,
)
def metric_exposition(t: Tables):
    from ampersift.operators.text import metric_exposition as expose

    key = F.when(F.col("event_type") == "error", "rmse").otherwise(F.concat(F.initcap("event_type"), F.lit("_Total")))
    return expose(t.events.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("value")))


@query(
    "temporal_features",
    f"""
    WITH {HOURLY}
    SELECT series_id, ts, hour(ts) AS hour, isodow(ts) - 1 AS day_of_week, month(ts) AS month,
           day(ts) AS day_of_month, weekofyear(ts) AS week_of_year,
           CAST(isodow(ts) >= 6 AS INT) AS is_weekend, CAST(hour(ts) BETWEEN 17 AND 21 AS INT) AS is_peak_hour,
           CAST(hour(ts) = 23 OR hour(ts) <= 6 AS INT) AS is_night,
           {R('sin(2 * pi() * hour(ts) / 24)')} AS hour_sin, {R('cos(2 * pi() * hour(ts) / 24)')} AS hour_cos,
           {R('sin(2 * pi() * month(ts) / 12)')} AS month_sin, {R('cos(2 * pi() * month(ts) / 12)')} AS month_cos
    FROM hourly
    """,
)
def temporal_features(t: Tables):
    made = fe.temporal_features(t.hourly.select("series_id", "ts"), "ts")
    return rounded(made, "hour_sin", "hour_cos", "month_sin", "month_cos")


@query(
    "interaction_features",
    f"""
    WITH {HOURLY}
    SELECT series_id, ts, {R('wind + radiation')} AS renewable_pct, carbon AS fossil_pct,
           {R('CASE WHEN temperature IS NOT NULL THEN greatest(18 - temperature, 0) END')} AS heating_demand,
           {R('CASE WHEN temperature IS NOT NULL THEN greatest(temperature - 22, 0) END')} AS cooling_demand,
           {R('wind * radiation', digits=4)} AS wind_solar_combined, {R('carbon / (price + 1e-6)')} AS carbon_per_price
    FROM hourly
    """,
)
def interaction_features(t: Tables):
    made = fe.interaction_features(
        t.hourly, "wind", "radiation", "carbon", "temperature", "radiation", "carbon", "price"
    )
    names = ("renewable_pct", "heating_demand", "cooling_demand", "carbon_per_price")
    return rounded(rounded(made, *names), "wind_solar_combined", digits=4).select(
        "series_id", "ts", "fossil_pct", "wind_solar_combined", *names
    )


@query(
    "log_transforms",
    f"""
    WITH {HOURLY}
    SELECT series_id, ts, {R('ln(1 + coalesce(CASE WHEN carbon > 1 THEN radiation END, 0))')} AS log_radiation,
           {R('ln(1 + coalesce(wind, 0))')} AS log_wind
    FROM hourly
    """,
)
def log_transforms(t: Tables):
    gappy = t.hourly.withColumn("radiation", F.when(F.col("carbon") > 1, F.col("radiation")))
    made = fe.log_transforms(gappy, ["radiation", "wind", "absent"])
    return rounded(made.select("series_id", "ts", "log_radiation", "log_wind"), "log_radiation", "log_wind")


@query(
    "filter_day",
    """
    SELECT event_id, ts FROM events
    WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events) - 1
    """,
)
def filter_day(t: Tables):
    as_of = t.events.agg(F.to_date(F.max("ts"))).scalar()
    return fe.day_before(t.events, as_of, "ts").select("event_id", "ts")


@query(
    "last_n_days",
    """
    SELECT o_orderkey, o_orderdate FROM orders
    WHERE o_orderdate > (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY
    """,
)
def last_n_days(t: Tables):
    return fe.last_n_days(t.orders, 90, "o_orderdate").select("o_orderkey", "o_orderdate")


@query(
    "range_filter",
    """
    SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem
    WHERE l_shipdate BETWEEN TIMESTAMP '1997-08-02' AND TIMESTAMP '1997-10-27'
    """,
)
def range_filter(t: Tables):
    kept = fe.time_range(t.lineitem, "1997-08-02", "1997-10-27", "l_shipdate")
    return kept.select("l_orderkey", "l_linenumber", "l_shipdate")


@query(
    "drop_incomplete",
    f"""
    WITH {HOURLY}, g AS (
      SELECT series_id, ts, price, CASE WHEN carbon > 1 THEN wind END AS wind,
             CASE WHEN hour(ts) % 5 <> 0 THEN radiation END AS radiation FROM hourly)
    SELECT series_id, ts, {R('price')} AS price, {R('wind')} AS wind, {R('radiation')} AS radiation
    FROM g WHERE price IS NOT NULL AND wind IS NOT NULL AND radiation IS NOT NULL
    """,
)
def drop_incomplete(t: Tables):
    """NULL and NaN gaps alike."""
    gappy = t.hourly.select(
        "series_id",
        "ts",
        "price",
        F.when(F.col("carbon") > 1, F.col("wind")).otherwise(F.lit(float("nan"))).alias("wind"),
        F.when(F.hour("ts") % 5 != 0, F.col("radiation")).alias("radiation"),
    )
    return rounded(fe.drop_incomplete(gappy, "price"), "price", "wind", "radiation")


@query(
    "select_features",
    f"WITH {HOURLY} SELECT ts, hour(ts) AS hour, {R('price')} AS price FROM hourly",
)
def select_features(t: Tables):
    made = fe.temporal_features(t.hourly, "ts")
    return rounded(fe.select_features(made, ["ts", "hour", "price"]), "price")


@query(
    "price_category",
    f"""
    SELECT event_id, CASE WHEN value / 100 < 0.3 THEN 'Low' WHEN value / 100 < 0.7 THEN 'Medium' ELSE 'High' END AS category,
           CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning'
                WHEN hour(ts) < 18 THEN 'day' ELSE 'evening' END AS day_part
    FROM events
    """,
)
def price_category(t: Tables):
    return t.events.select(
        "event_id",
        fe.price_category(F.col("value") / 100).alias("category"),
        fe.day_part(F.hour("ts")).alias("day_part"),
    )


FEEDS = """weather AS (SELECT ts, temperature FROM hourly WHERE series_id = 'view'),
  air AS (SELECT ts, wind AS aqi FROM hourly WHERE series_id = 'click'),
  carbon AS (SELECT ts, carbon AS carbon_actual FROM hourly WHERE series_id = 'error'),
  prices AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) + INTERVAL 15 MINUTE AS ts, avg(value) AS price
             FROM events WHERE event_type = 'purchase' GROUP BY 1)"""


def feed_frames(t: Tables):
    """Hourly feeds by event type; prices at quarter past and quarter to."""
    h = t.hourly
    half = F.window("ts", "30 minutes")
    prices = (
        t.events.filter(F.col("event_type") == "purchase")
        .groupBy(half.alias("w"))
        .agg(F.avg("value").alias("price"))
        .select((F.col("w.start") + F.expr("interval 15 minutes")).alias("ts"), "price")
    )
    return (
        h.filter("series_id = 'view'").select("ts", "temperature"),
        h.filter("series_id = 'click'").select("ts", F.col("wind").alias("aqi")),
        h.filter("series_id = 'error'").select("ts", F.col("carbon").alias("carbon_actual")),
        prices,
    )


@query(
    "outer_merge",
    f"""
    WITH {HOURLY}, {FEEDS}
    SELECT ts, {R('temperature')} AS temperature, {R('aqi')} AS aqi, carbon_actual
    FROM weather FULL JOIN air USING (ts) FULL JOIN carbon USING (ts)
    """,
)
def outer_merge(t: Tables):
    weather, air, carbon, _ = feed_frames(t)
    return rounded(joins.outer_merge([weather, air, carbon], ["ts"]), "temperature", "aqi")


@query(
    "asof_nearest",
    """
    WITH l AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase'),
    m AS (SELECT user_id, ts, value, event_id FROM events WHERE event_type = 'view'),
    c AS (SELECT l.event_id, m.ts AS matched_ts, m.value,
                 row_number() OVER (PARTITION BY l.event_id
                   ORDER BY abs(epoch_us(l.ts) - epoch_us(m.ts)), m.ts, m.event_id) AS rn
          FROM l JOIN m ON l.user_id = m.user_id
           AND m.ts BETWEEN l.ts - INTERVAL 30 MINUTE AND l.ts + INTERVAL 30 MINUTE)
    SELECT l.event_id, l.ts, c.matched_ts, c.value FROM l LEFT JOIN c ON l.event_id = c.event_id AND c.rn = 1
    """,
)
def asof_nearest(t: Tables):
    kind = F.col("event_type")
    left = t.events.filter(kind == "purchase").select("event_id", "ts", "user_id")
    right = t.events.filter(kind == "view").select("ts", "user_id", "value", F.col("event_id").alias("mark"))
    out = joins.asof_nearest(left, right, ["value"], "ts", ["user_id"], 1800, ["mark"], "matched_ts")
    return out.select("event_id", "ts", "matched_ts", "value")


FILL = """mixed AS (SELECT ts, max(CASE WHEN series_id = 'signup' THEN radiation END) AS mix FROM hourly GROUP BY ts),
  joined AS (SELECT w.ts, w.temperature, m.mix FROM weather w LEFT JOIN (SELECT * FROM mixed WHERE mix IS NOT NULL) m USING (ts))"""


@query(
    "fill_forward_back",
    f"""
    WITH {HOURLY}, {FEEDS}, {FILL}
    SELECT ts, {R('temperature')} AS temperature,
           {R('''coalesce(last_value(mix IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING),
                first_value(mix IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))''')} AS mix
    FROM joined
    """,
)
def fill_forward_back(t: Tables):
    weather = feed_frames(t)[0]
    mix = t.hourly.filter("series_id = 'signup'").select("ts", F.col("radiation").alias("mix"))
    return rounded(joins.fill_from_side(weather, mix, ["mix"], "ts"), "temperature", "mix")


@query(
    "incremental_anti",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01')",
)
def incremental_anti(t: Tables):
    seen = t.lineitem.filter(F.col("l_shipdate") < "1999-01-01").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.rows_not_in(t.orders.select("o_orderkey", "o_totalprice"), seen, ["o_orderkey"])


@query(
    "incremental_highwater",
    """
    SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem
    WHERE l_shipdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '2000-01-01')
    """,
)
def incremental_highwater(t: Tables):
    stored = t.orders.filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < "2000-01-01"))
    new = t.lineitem.select("l_orderkey", "l_linenumber", "l_shipdate")
    return joins.rows_after(new, stored.select(F.col("o_orderdate").alias("l_shipdate")), "l_shipdate")


@query(
    "completeness_check",
    f"""
    WITH {HOURLY}, {FEEDS}, m AS (SELECT * FROM weather FULL JOIN air USING (ts) FULL JOIN carbon USING (ts))
    SELECT count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts,
           count(*) - count(temperature) AS missing_temperature, count(*) - count(aqi) AS missing_aqi,
           count(*) - count(carbon_actual) AS missing_carbon_actual,
           (count(*) - count(carbon_actual) > 2) OR (count(*) - count(temperature) > 5) AS warn
    FROM m
    """,
)
def completeness_check(t: Tables):
    weather, air, carbon, _ = feed_frames(t)
    merged = joins.outer_merge([weather, air, carbon], ["ts"])
    return fe.completeness(
        merged, ["temperature", "aqi", "carbon_actual"], "ts", {"carbon_actual": 2, "temperature": 5}
    )


@query(
    "standard_scale",
    f"""
    WITH {HOURLY}, f AS (SELECT avg(price) AS mp, stddev_pop(price) AS sp, avg(carbon) AS mc, stddev_pop(carbon) AS sc FROM hourly)
    SELECT series_id, ts, {R('(price - mp) / CASE WHEN sp = 0 THEN 1 ELSE sp END')} AS scaled_price,
           {R('(carbon - mc) / CASE WHEN sc = 0 THEN 1 ELSE sc END')} AS scaled_carbon
    FROM hourly, f
    """,
)
def standard_scale(t: Tables):
    made = fe.standard_scale(t.hourly, ["price", "carbon"])
    return rounded(made.select("series_id", "ts", "scaled_price", "scaled_carbon"), "scaled_price", "scaled_carbon")


@query(
    "minmax_scale",
    """
    WITH f AS (SELECT min(value) AS lo, max(value) - min(value) AS span FROM events)
    SELECT event_id, (round((value - lo) / CASE WHEN span = 0 THEN 1 ELSE span END, 9) + 0) AS mm_value,
           (round(value, 9) + 0) AS restored FROM events, f
    """,
)
def minmax_scale(t: Tables):
    """Scaled, then scaled back."""
    scaled = fe.minmax_scale(t.events.select("event_id", "value"), ["value"])
    fit = fe.minmax_fit(t.events, ["value"])
    back = fe.minmax_restore(scaled.drop("value"), fit, ["value"])
    return back.select("event_id", r("mm_value").alias("mm_value"), r("value").alias("restored"))


LAG_COLUMNS = {"price": [1, 24], "carbon": [1, 24], "wind": [1, 24]}
SQL_LAGS = ", ".join(
    R(f"lag({c}, {k}) OVER w") + f" AS {c}_lag_{k}h" for c, ks in LAG_COLUMNS.items() for k in ks
)


@query(
    "lag_features",
    f"WITH {HOURLY} SELECT series_id, ts, {SQL_LAGS} FROM hourly WINDOW w AS (PARTITION BY series_id ORDER BY ts)",
)
def lag_features(t: Tables):
    made = fe.lag_features(t.hourly, LAG_COLUMNS, ts="ts")
    names = [f"{c}_lag_{k}h" for c, ks in LAG_COLUMNS.items() for k in ks]
    return rounded(made.select("series_id", "ts", *names), *names)


@query(
    "lag_by_time",
    f"""
    WITH {HOURLY}
    SELECT h.series_id, h.ts, {R('a.price')} AS price_lag_1h, {R('b.price')} AS price_lag_24h
    FROM hourly h LEFT JOIN hourly a ON a.series_id = h.series_id AND a.ts = h.ts - INTERVAL 1 HOUR
    LEFT JOIN hourly b ON b.series_id = h.series_id AND b.ts = h.ts - INTERVAL 24 HOUR
    """,
)
def lag_by_time(t: Tables):
    made = fe.lag_by_time(t.hourly.select("series_id", "ts", "price"), {"price": [1, 24]}, ts="ts")
    return rounded(made.drop("price"), "price_lag_1h", "price_lag_24h")


def _rolled(column: str, window: str) -> str:
    full = f"CASE WHEN count({column}) OVER {window} = 24 THEN {{}}({column}) OVER {window} END"
    mean, std = (R(full.format(f)) for f in ("avg", "stddev_samp"))
    return f"{mean} AS {column}_rolling_24h_mean, {std} AS {column}_rolling_24h_std"


@query(
    "rolling_features",
    f"""
    WITH {HOURLY} SELECT series_id, ts, {_rolled('price', 'w')}, {_rolled('carbon', 'w')}
    FROM hourly WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)
    """,
)
def rolling_features(t: Tables):
    made = fe.rolling_features(t.hourly, ["price", "carbon"], ts="ts")
    names = [f"{c}_rolling_24h_{k}" for c in ("price", "carbon") for k in ("mean", "std")]
    return rounded(made.select("series_id", "ts", *names), *names)


@query(
    "make_sequences",
    f"""
    WITH {HOURLY}, w AS (
      SELECT series_id, ts, {R('price')} AS y, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn,
             list(CAST(carbon AS BIGINT)) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS x
      FROM hourly)
    SELECT series_id, ts, y, array_to_string(x, ',') AS x FROM w WHERE rn > 24
    """,
)
def make_sequences(t: Tables):
    made = sequences.make_sequences(
        t.hourly, F.col("carbon").cast("bigint"), 24, ts="ts", target=r("price")
    )
    return made.select("series_id", "ts", "y", F.array_join("x", ",").alias("x"))


@query(
    "make_multi_horizon",
    f"""
    WITH {HOURLY}, w AS (
      SELECT series_id, ts, row_number() OVER p - 1 AS i, count(*) OVER (PARTITION BY series_id) AS n,
             list(CAST(carbon AS BIGINT)) OVER (p ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) AS x,
             list(CAST(carbon AS BIGINT)) OVER (p ROWS BETWEEN CURRENT ROW AND 71 FOLLOWING) AS y
      FROM hourly WINDOW p AS (PARTITION BY series_id ORDER BY ts))
    SELECT series_id, ts, array_to_string(x, ',') AS x, array_to_string(y, ',') AS y
    FROM w WHERE i >= 24 AND i < n - 72
    """,
)
def make_multi_horizon(t: Tables):
    made = sequences.make_multi_horizon(t.hourly, F.col("carbon").cast("bigint"), ts="ts")
    return made.select("series_id", "ts", F.array_join("x", ",").alias("x"), F.array_join("y", ",").alias("y"))


@query(
    "chrono_split",
    """
    SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS row_no,
           CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= floor(0.8 * count(*) OVER ())
                THEN 'train' ELSE 'val' END AS split
    FROM orders
    """,
)
def chrono_split(t: Tables):
    rows = t.orders.select("o_orderkey", "o_orderdate")
    made = sequences.chrono_split(rows, ["o_orderdate", "o_orderkey"], numbered=True)
    return made.select("o_orderkey", "row_no", "split")


@query(
    "train_split",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate,
           CASE WHEN row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)
                <= floor(0.8 * count(*) OVER ()) THEN 'train' ELSE 'val' END AS split
    FROM lineitem
    """,
)
def train_split(t: Tables):
    """The same rule without row numbers: many rows tie on the ship date."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    made = sequences.chrono_split(t.lineitem.select(*order), order)
    return made.select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "split")


@query(
    "half_split",
    """
    SELECT event_id, event_type,
           CASE WHEN row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) <= count(*) OVER (PARTITION BY event_type) // 2
                THEN 'reference' ELSE 'current' END AS half
    FROM events
    """,
)
def half_split(t: Tables):
    """Halves within each event type, however unequal the types are."""
    rows = t.events.select("event_id", "event_type", "ts")
    return sequences.half_split(rows, ["ts", "event_id"], ["event_type"]).select("event_id", "event_type", "half")


FOLDS = """placed AS (
  SELECT series_id, ts, price, carbon, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS position,
         count(*) OVER (PARTITION BY series_id) AS n FROM hourly),
  folds AS (SELECT *, position // 168 AS block,
         CASE WHEN position // 168 >= 1 AND (position // 168 + 1) * 168 <= n THEN position // 168 - 1 END AS test_fold FROM placed)"""


@query(
    "walk_forward_folds",
    f"""
    WITH {HOURLY}, {FOLDS}
    SELECT series_id, test_fold AS fold, count(*) AS test_rows, min(position) AS train_rows
    FROM folds WHERE test_fold IS NOT NULL GROUP BY 1, 2
    """,
)
def walk_forward_folds(t: Tables):
    return sequences.fold_sizes(sequences.walk_forward_folds(t.hourly, "ts"))


@query(
    "fold_membership",
    f"WITH {HOURLY}, {FOLDS} SELECT series_id, ts, position, block, test_fold FROM folds",
)
def fold_membership(t: Tables):
    return sequences.walk_forward_folds(t.hourly.select("series_id", "ts"), "ts")


@query(
    "tail_n",
    f"""
    WITH {HOURLY}, w AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rn FROM hourly)
    SELECT series_id, ts, {R('price')} AS price FROM w WHERE rn <= 72
    """,
)
def tail_n(t: Tables):
    return rounded(upserts.last_n(t.hourly.select("series_id", "ts", "price"), 72, ["series_id"], "ts"), "price")


@query(
    "dedup_keep_last",
    """
    SELECT l_orderkey, l_linenumber, l_shipdate, l_extendedprice FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem)
    WHERE rn = 1
    """,
)
def dedup_keep_last(t: Tables):
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    rows = t.lineitem.select("l_orderkey", *order)
    return upserts.keep_last(rows, ["l_orderkey"], order).drop("l_partkey", "l_suppkey")


@query(
    "dedup_keep_first",
    """
    SELECT user_id, event_id, ts, event_type FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1
    """,
)
def dedup_keep_first(t: Tables):
    rows = t.events.select("user_id", "event_id", "ts", "event_type")
    return upserts.keep_first(rows, ["user_id"], ["ts", "event_id"])


@query("distinct_keys", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_keys(t: Tables):
    return stats.distinct_keys(t.orders, ["o_orderstatus", "o_orderpriority"])


@query(
    "append_historical",
    """
    WITH d AS (SELECT max(CAST(ts AS DATE)) AS day FROM events),
    old AS (SELECT user_id, date_trunc('hour', ts) AS ts, 0 AS src, max(value) AS value FROM events, d
            WHERE event_type IN ('view', 'click') GROUP BY 1, 2),
    new AS (SELECT user_id, date_trunc('hour', ts) AS ts, 1 AS src, max(value) AS value FROM events, d
            WHERE event_type = 'purchase' AND CAST(ts AS DATE) = d.day - 1 GROUP BY 1, 2),
    b AS (SELECT * FROM old UNION ALL SELECT * FROM new)
    SELECT user_id, ts, arg_max(value, src) AS value FROM b GROUP BY 1, 2
    """,
)
def append_historical(t: Tables):
    """One day of new readings over the stored ones, by user and hour."""
    def readings(*kinds: str):
        hour = at_grain("ts", "hour")
        picked = t.events.filter(F.col("event_type").isin(*kinds))
        return picked.groupBy("user_id", hour.alias("ts")).agg(F.max("value").alias("value"))

    as_of = t.events.agg(F.to_date(F.max("ts"))).scalar()
    fresh = fe.day_before(readings("purchase"), as_of, "ts")
    return upserts.append_keep_last(readings("view", "click"), fresh, ["user_id", "ts"])


@query(
    "append_days",
    """
    WITH d AS (SELECT max(CAST(ts AS DATE)) AS day FROM events),
    readings AS (SELECT user_id, date_trunc('hour', ts) AS ts, event_type, value FROM events),
    first AS (SELECT user_id, ts, 0 AS src, max(value) AS value, count(*) AS n FROM readings
              WHERE event_type IN ('view', 'click') GROUP BY 1, 2),
    second AS (SELECT user_id, ts, 1 AS src, max(value) AS value, count(*) AS n FROM readings, d
               WHERE event_type = 'purchase' AND CAST(ts AS DATE) = d.day - 1 GROUP BY 1, 2),
    third AS (SELECT user_id, ts, 2 AS src, max(value) AS value, count(*) AS n FROM readings, d
              WHERE event_type = 'signup' AND CAST(ts AS DATE) = d.day - 2 GROUP BY 1, 2),
    b AS (SELECT * FROM first UNION ALL SELECT * FROM second UNION ALL SELECT * FROM third)
    SELECT user_id, ts, arg_max(value, src) AS value, arg_max(n, src) AS n FROM b GROUP BY 1, 2
    """,
)
def append_days(t: Tables):
    """Two daily appends to a table stored by day: each rewrites one day."""

    def readings(*kinds: str):
        picked = t.events.filter(F.col("event_type").isin(*kinds))
        return picked.groupBy("user_id", at_grain("ts", "hour").alias("ts")).agg(F.max("value").alias("value"), F.count(F.lit(1)).alias("n"))

    history = readings("view", "click")
    table = DailyTable(t.spark, scratch_path(t.spark, "readings-by-day"), history.schema, ["user_id", "ts"], "ts")
    as_of = t.events.agg(F.to_date(F.max("ts"))).scalar()
    plans.append_day(table, history, as_of)
    plans.append_day(table, readings("purchase"), as_of)
    plans.append_day(table, readings("signup"), F.date_sub(as_of, 1))
    return table.read()


@query(
    "collect_day",
    f"""
    WITH {HOURLY}, {FEEDS}, {MIX},
    mixrow AS (SELECT {SQL_MIX} FROM shares WHERE ts = (SELECT max(ts) FROM shares)),
    merged AS (SELECT * FROM weather FULL JOIN air USING (ts) FULL JOIN carbon USING (ts)),
    near AS (SELECT m.ts, p.price, row_number() OVER (PARTITION BY m.ts ORDER BY abs(epoch_us(m.ts) - epoch_us(p.ts)), p.ts) AS rn
             FROM merged m JOIN prices p ON p.ts BETWEEN m.ts - INTERVAL 30 MINUTE AND m.ts + INTERVAL 30 MINUTE),
    full_rows AS (SELECT m.*, n.price, x.* FROM merged m LEFT JOIN near n ON n.ts = m.ts AND n.rn = 1 CROSS JOIN mixrow x),
    d AS (SELECT max(CAST(ts AS DATE)) AS day FROM events),
    both_days AS (SELECT f.* FROM full_rows f, d WHERE CAST(f.ts AS DATE) IN (d.day - 1, d.day) AND minute(f.ts) = 0)
    SELECT ts, {R('temperature')} AS temperature, {R('aqi')} AS aqi, carbon_actual, {R('price')} AS price,
           mix_click, mix_error, mix_purchase, mix_view FROM both_days
    """,
)
def collect_day(t: Tables):
    """The last two days collected one after the other into one table."""
    weather, air, carbon, prices = feed_frames(t)
    wide = feeds.pivot_mix(hourly_mix(t), ts="ts", fuels=MIX_KINDS, name="mix_{}")
    now = wide.agg(F.max("ts")).scalar()
    mix_row = wide.filter(F.col("ts") == now).drop("ts")
    # landed once, read by both runs
    merged = freeze(plans.merge_sources(weather, air, carbon, mix_row, prices, "price", "ts"))
    last = t.events.agg(F.to_date(F.max("ts"))).scalar()
    first_day = plans.collect_day(None, merged, last, "ts")
    stored = plans.collect_day(first_day, merged, F.date_add(last, 1), "ts")
    return rounded(stored, "temperature", "aqi", "price", *[f"mix_{k}" for k in MIX_KINDS])


@query(
    "historical_merge",
    f"""
    WITH {HOURLY}, {FEEDS}, mix AS (SELECT ts, radiation AS mix FROM hourly WHERE series_id = 'signup'),
    merged AS (SELECT * FROM weather FULL JOIN air USING (ts) FULL JOIN carbon USING (ts) FULL JOIN prices USING (ts)),
    joined AS (SELECT merged.*, mix.mix FROM merged LEFT JOIN mix USING (ts)),
    filled AS (SELECT * EXCLUDE (mix), coalesce(last_value(mix IGNORE NULLS) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING),
                first_value(mix IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS mix FROM joined),
    k AS (SELECT *, date_trunc('hour', ts) AS h, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts) AS rn FROM filled)
    SELECT h AS ts, {R('temperature')} AS temperature, {R('aqi')} AS aqi, carbon_actual, {R('price')} AS price, {R('mix')} AS mix
    FROM k WHERE rn = 1
    """,
)
def historical_merge(t: Tables):
    weather, air, carbon, prices = feed_frames(t)
    mix = t.hourly.filter("series_id = 'signup'").select("ts", F.col("radiation").alias("mix"))
    merged = plans.historical_merge(weather, air, carbon, prices, mix, "ts")
    return rounded(merged, "temperature", "aqi", "price", "mix")


ENERGY_NAMES = {
    "ts": "datetime",
    "price": fe.PRICE,
    "carbon": fe.CARBON,
    "wind": fe.WIND,
    "radiation": fe.RADIATION,
    "temperature": fe.TEMPERATURE,
}


def energy_table(t: Tables):
    """The roll-up of all series under the energy table's column names."""
    base = t.hourly.withColumnsRenamed(ENERGY_NAMES)
    w, n, rad = (F.col(f"`{c}`") for c in (fe.WIND, fe.CARBON, fe.RADIATION))
    return base.withColumns(
        {
            fe.SOLAR: w / 2,
            fe.GAS: n * 3,
            "uk_gen_biomass_%": n + 1,
            "uk_gen_nuclear_%": n + 2,
            "carbon_intensity_forecast": n * 1.1,
            "wind_speed_mps": w / 10,
            "humidity_%": F.when(n > 1, n * 10),
            "no2": rad / 3,
        }
    )


ENERGY_SQL = """e AS (
  SELECT series_id, ts AS datetime, price, carbon, wind, radiation, temperature, wind / 2 AS solar, carbon * 3 AS gas,
         carbon + 1 AS biomass, carbon + 2 AS nuclear, carbon * CAST(1.1 AS DOUBLE) AS forecast, wind / 10 AS speed,
         CASE WHEN carbon > 1 THEN carbon * 10 END AS humidity, radiation / 3 AS no2
  FROM hourly)"""


def _z(column: str) -> str:
    return (
        f"(coalesce({column}, 0) - avg(coalesce({column}, 0)) OVER ()) / "
        f"CASE WHEN stddev_pop(coalesce({column}, 0)) OVER () = 0 THEN 1 ELSE stddev_pop(coalesce({column}, 0)) OVER () END"
    )


@query(
    "feature_build",
    f"""
    WITH {HOURLY}, {ENERGY_SQL}, cut AS (SELECT max(CAST(datetime AS DATE)) - 5 AS day FROM e),
    old AS (SELECT e.* FROM e, cut WHERE CAST(datetime AS DATE) < day),
    fresh AS (SELECT e.* FROM e, cut WHERE CAST(datetime AS DATE) >= day),
    done AS (SELECT *, {_z('temperature')} AS st, {_z('humidity')} AS sh, {_z('carbon')} AS sc FROM old
             UNION ALL SELECT *, {_z('temperature')}, {_z('humidity')}, {_z('carbon')} FROM fresh)
    SELECT series_id, datetime, hour(datetime) AS hour, {R('wind + solar')} AS renewable_pct, {R('ln(1 + no2)')} AS log_no2,
           {R('carbon / (price + 1e-6)')} AS carbon_per_price,
           {R('st')} AS scaled_temperature, {R('sh')} AS scaled_humidity, {R('sc')} AS scaled_carbon FROM done
    """,
)
def feature_build(t: Tables):
    """Two incremental runs over all series; each batch is standardised by itself."""
    raw = freeze(energy_table(t))
    cut = raw.agg(F.date_sub(F.to_date(F.max("datetime")), 5)).scalar()
    stored = plans.update_features(raw.filter(F.to_date("datetime") < cut), None, series=["series_id"])
    done = plans.update_features(raw, stored, series=["series_id"])
    return done.select(
        "series_id",
        "datetime",
        "hour",
        r("renewable_pct").alias("renewable_pct"),
        r("log_no2").alias("log_no2"),
        r("carbon_per_price").alias("carbon_per_price"),
        r("scaled_temperature_C").alias("scaled_temperature"),
        r("`scaled_humidity_%`").alias("scaled_humidity"),
        r("scaled_carbon_intensity_actual").alias("scaled_carbon"),
    )


CONTRACT_SQL = {
    "scaled_renewable_pct": "wind + solar",
    "scaled_price_lag_1h": "lag(price, 1) OVER o",
    "scaled_price_lag_24h": "lag(price, 24) OVER o",
    "scaled_carbon_lag_1h": "lag(carbon, 1) OVER o",
    "scaled_log_solar_radiation_Wm2": "ln(1 + coalesce(radiation, 0))",
    "scaled_carbon_intensity_actual": "carbon",
    "scaled_log_no2": "ln(1 + coalesce(no2, 0))",
    "scaled_uk_gen_biomass_pct": "biomass",
    "scaled_wind_lag_24h": "lag(wind, 24) OVER o",
    "scaled_carbon_per_price": "carbon / (price + 1e-6)",
    "scaled_fossil_pct": "gas",
    "scaled_uk_gen_wind_pct": "wind",
    "scaled_log_uk_gen_solar_pct": "ln(1 + coalesce(solar, 0))",
    "scaled_carbon_rolling_24h_mean": "CASE WHEN count(carbon) OVER r = 24 THEN avg(carbon) OVER r END",
    "scaled_uk_gen_nuclear_pct": "nuclear",
    "scaled_uk_gen_gas_pct": "gas",
    "scaled_carbon_intensity_forecast": "forecast",
    "scaled_wind_speed_mps": "speed",
    "scaled_temperature_C": "temperature",
    "scaled_price_rolling_24h_mean": "CASE WHEN count(price) OVER r = 24 THEN avg(price) OVER r END",
    "scaled_wind_lag_1h": "lag(wind, 1) OVER o",
}


@query(
    "contract_features",
    f"""
    WITH {HOURLY}, {ENERGY_SQL}, v AS (
      SELECT series_id, datetime, price, {", ".join(f"{x} AS v{i}" for i, x in enumerate(CONTRACT_SQL.values()))}
      FROM e WINDOW o AS (PARTITION BY series_id ORDER BY datetime),
                    r AS (PARTITION BY series_id ORDER BY datetime ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
    SELECT series_id, datetime, hour(datetime) AS hour, CAST(hour(datetime) BETWEEN 17 AND 21 AS INT) AS is_peak_hour,
           {R('sin(2 * pi() * hour(datetime) / 24)')} AS hour_sin, {R('cos(2 * pi() * hour(datetime) / 24)')} AS hour_cos,
           {R('price')} AS price, {", ".join(f'{R(_z(f"v{i}"))} AS "{n}"' for i, n in enumerate(CONTRACT_SQL))}
    FROM v
    """,
)
def contract_features(t: Tables):
    """All columns of the selected-feature contract, for all series."""
    made = plans.contract_features(energy_table(t), ["series_id"])
    plain = made.withColumnsRenamed(
        {c: "price" if c == fe.PRICE else c.replace("%", "pct") for c in made.columns}
    )
    return rounded(plain, "price", "hour_sin", "hour_cos", *CONTRACT_SQL)


@query(
    "update_selected",
    f"""
    WITH {HOURLY}, {ENERGY_SQL} SELECT series_id, datetime, {R('price')} AS price, {R('carbon')} AS carbon FROM e
    """,
)
def update_selected(t: Tables):
    """Stored rows up to a cut, then everything later than the stored maximum of the series."""
    raw = freeze(energy_table(t))
    full = freeze(plans.contract_features(raw, ["series_id"]))
    cut = full.agg(F.date_sub(F.to_date(F.max("datetime")), 5)).scalar()
    stored = plans.update_selected(full.filter(F.to_date("datetime") < cut), None, series=["series_id"])
    done = plans.update_selected(full, stored, series=["series_id"])
    base = raw.select("series_id", "datetime", F.col(fe.CARBON).alias("carbon"))
    return done.join(base, ["series_id", "datetime"]).select("series_id", "datetime", r(f"`{fe.PRICE}`").alias("price"), r("carbon").alias("carbon"))


@query(
    "forecast_calendar",
    f"""
    WITH {HOURLY}, l AS (SELECT series_id, max(ts) AS ts FROM hourly GROUP BY 1)
    SELECT series_id, CAST(i AS INT) AS step, ts + INTERVAL 1 HOUR * i AS forecast_ts,
           strftime(ts + INTERVAL 1 HOUR * i, '%Y-%m-%d %H:%M:%S') AS forecast_date
    FROM l, range(1, 73) AS g(i)
    """,
)
def forecast_calendar(t: Tables):
    last = t.hourly.groupBy("series_id").agg(F.max("ts").alias("ts"))
    return sequences.forecast_calendar(last, "ts")


@query(
    "forecast_seasonal_naive",
    f"""
    WITH {HOURLY}, l AS (SELECT series_id, max(ts) AS last FROM hourly GROUP BY 1),
    f AS (SELECT series_id, last, i, last + INTERVAL 1 HOUR * i AS forecast_ts,
                 last + INTERVAL 1 HOUR * ((i - 1) % 24 + 1) - INTERVAL 24 HOUR AS source_ts FROM l, range(1, 73) AS g(i))
    SELECT f.series_id, CAST(i AS INT) AS step, forecast_ts, {R('h.price')} AS forecast
    FROM f LEFT JOIN hourly h ON h.series_id = f.series_id AND h.ts = f.source_ts
    """,
)
def forecast_seasonal_naive(t: Tables):
    made = sequences.seasonal_naive(t.hourly, "price", ts="ts")
    return made.select("series_id", "step", "forecast_ts", r("forecast").alias("forecast"))


@query(
    "daily_price_summary",
    f"""
    WITH {HOURLY}, d AS (
      SELECT series_id, CAST(ts AS DATE) AS day, avg(price) AS avg_price, max(price) AS peak_price, min(price) AS low_price,
             sum(price) AS total_price, dense_rank() OVER (PARTITION BY series_id ORDER BY CAST(ts AS DATE)) AS dr FROM hourly GROUP BY 1, 2),
    p AS (SELECT series_id, CAST(ts AS DATE) AS day, ts, row_number() OVER (PARTITION BY series_id, CAST(ts AS DATE) ORDER BY price DESC, ts) AS hi,
                 row_number() OVER (PARTITION BY series_id, CAST(ts AS DATE) ORDER BY price, ts) AS lo FROM hourly)
    SELECT d.series_id, strftime(d.day, '%Y-%m-%d') AS date, strftime(d.day, '%A, %B %d, %Y') AS day_name,
           {R('avg_price')} AS avg_price, {R('peak_price')} AS peak_price, strftime(a.ts, '%H:%M') AS peak_time,
           {R('low_price')} AS low_price, strftime(b.ts, '%H:%M') AS low_time, {R('total_price')} AS total_price
    FROM d JOIN p a ON a.series_id = d.series_id AND a.day = d.day AND a.hi = 1
    JOIN p b ON b.series_id = d.series_id AND b.day = d.day AND b.lo = 1 WHERE dr <= 3
    """,
)
def daily_price_summary(t: Tables):
    made = stats.daily_price_summary(t.hourly, "price", "ts", ["series_id"])
    return rounded(made, "avg_price", "peak_price", "low_price", "total_price")
