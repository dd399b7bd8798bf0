"""Drift, event-time metrics, alerts and their streaming forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampersift.operators import drift, rollups, sequences
from ampersift.operators import guardrails as gr
from ampersift.operators.stats import unpivot
from ampersift.queries.registry import AB_LOG, HOURLY, LoggedStream, R, Tables, query, rounded
from ampersift.queries.safety import VERDICT
from ampersift.session import scratch_path
from ampersift.sources.daily import DailyTable
from ampersift.streaming import jobs, stateful

WINDOWS = """w AS (SELECT e.*, CASE WHEN ts >= m - INTERVAL 7 DAY THEN 'current'
    WHEN ts BETWEEN m - INTERVAL 37 DAY AND m - INTERVAL 8 DAY THEN 'reference' END AS side FROM events e, (SELECT max(ts) AS m FROM events)),
  lab AS (SELECT * FROM w WHERE side IS NOT NULL)"""


def _windows(t: Tables):
    return drift.drift_windows(t.events, "ts")


@query("drift_windows", f"WITH {WINDOWS} SELECT event_id, ts, side AS \"window\" FROM lab")
def drift_windows(t: Tables):
    return _windows(t).select("event_id", "ts", "window")


def _drift_sql(long: str, side: str = "side") -> str:
    """Statements over ``long(column, v, side)``."""
    return f"""{long},
    cnt AS (SELECT "column", v, count(*) FILTER ({side} = 'reference') AS r, count(*) FILTER ({side} <> 'reference') AS c FROM long GROUP BY 1, 2),
    cum AS (SELECT *, sum(r) OVER (PARTITION BY "column" ORDER BY v) AS cr, sum(c) OVER (PARTITION BY "column" ORDER BY v) AS cc,
            sum(r) OVER (PARTITION BY "column") AS nr, sum(c) OVER (PARTITION BY "column") AS nc, lead(v) OVER (PARTITION BY "column" ORDER BY v) - v AS step FROM cnt),
    sp AS (SELECT "column", stddev_pop(v) FILTER ({side} = 'reference') AS sd FROM long GROUP BY 1),
    dist AS (SELECT "column", CAST(any_value(nr) AS BIGINT) AS n_reference, CAST(any_value(nc) AS BIGINT) AS n_current, max(abs(cr / nr - cc / nc)) AS ks,
            sum(abs(cr / nr - cc / nc) * coalesce(step, 0)) AS area FROM cum GROUP BY 1),
    res AS (SELECT dist.*, area / greatest(sd, 0.001) AS wd, sqrt(CAST(n_reference AS DOUBLE) * n_current / (n_reference + n_current)) * ks AS root FROM dist JOIN sp USING ("column")),
    pv AS (SELECT *, least(1, greatest(0, CASE WHEN root < 1 THEN 1 - sqrt(2 * pi()) / root * (SELECT sum(exp(-power(pi(), 2) / (8 * root * root) * power(2 * k - 1, 2))) FROM range(1, 21) g(k))
              ELSE 2 * (SELECT sum(power(-1, k - 1) * exp(-2.0 * k * k * root * root)) FROM range(1, 101) g(k)) END)) AS p FROM res)"""


DRIFT_COLUMNS = f"""n_reference, n_current, {R('ks')} AS ks_statistic, {R('p')} AS ks_pvalue, {R('wd')} AS wasserstein,
  CASE WHEN n_reference <= 1000 THEN 'ks' ELSE 'wasserstein' END AS method, CASE WHEN n_reference <= 1000 THEN p < 0.05 ELSE wd >= 0.1 END AS drifted"""
FIGURES = ("ks_statistic", "ks_pvalue", "wasserstein")
VALUE_LONG = f"""{WINDOWS}, long AS (SELECT 'value' AS "column", value AS v, side FROM lab UNION ALL SELECT 'user_id', CAST(user_id AS DOUBLE), side FROM lab)"""


def _numeric(t: Tables):
    return rounded(drift.numeric_drift(unpivot(_windows(t), ["value", "user_id"], ["window"])), *FIGURES)


@query("drift_ks", f'WITH {_drift_sql(VALUE_LONG)} SELECT "column", n_reference, n_current, {R("ks")} AS ks_statistic, {R("p")} AS ks_pvalue FROM pv')
def drift_ks(t: Tables):
    return _numeric(t).select("column", "n_reference", "n_current", "ks_statistic", "ks_pvalue")


@query("drift_wasserstein", f'WITH {_drift_sql(VALUE_LONG)} SELECT "column", {DRIFT_COLUMNS} FROM pv')
def drift_wasserstein(t: Tables):
    return _numeric(t)


@query(
    "drift_ks_exact",
    f"""
    WITH RECURSIVE first AS (SELECT min(CAST(ts AS DATE)) AS day FROM events),
    long AS (SELECT event_type AS "column", avg(value) AS v, CASE WHEN CAST(ts AS DATE) < any_value(day) + 18 THEN 'reference' ELSE 'current' END AS side FROM events, first GROUP BY event_type, CAST(ts AS DATE)),
    cum AS (SELECT "column", sum(CASE WHEN side = 'reference' THEN 1 ELSE 0 END) OVER w AS r, sum(CASE WHEN side = 'current' THEN 1 ELSE 0 END) OVER w AS c FROM long WINDOW w AS (PARTITION BY "column" ORDER BY v)),
    d AS (SELECT "column", CAST(max(r) AS BIGINT) AS n, CAST(max(c) AS BIGINT) AS m FROM cum GROUP BY 1),
    ks AS (SELECT "column", any_value(n) AS n, any_value(m) AS m, CAST(max(abs(r * m - c * n)) AS BIGINT) AS h FROM cum JOIN d USING ("column") GROUP BY 1),
    walk AS (
      SELECT "column", n, m, h, 0 AS s, list_transform(range(0, n + 1), lambda i: 0::DOUBLE) AS q FROM ks
      UNION ALL
      SELECT "column", n, m, h, s + 1, list_transform(range(0, n + 1), lambda i: CASE WHEN i > s + 1 OR s + 1 - i > m THEN 0::DOUBLE WHEN abs(i * m - (s + 1 - i) * n) >= h THEN 1::DOUBLE
        ELSE (i * coalesce(q[i], 0) + (s + 1 - i) * q[i + 1]) / (s + 1) END) FROM walk WHERE s < n + m)
    SELECT "column", n AS n_reference, m AS n_current, {R('h / CAST(n * m AS DOUBLE)')} AS ks_statistic, {R('q[n + 1]')} AS ks_pvalue, q[n + 1] < 0.05 AS drifted FROM walk WHERE s = n + m
    """,
)
def drift_ks_exact(t: Tables):
    """Daily means of every event type, 18 days against the rest: too few for the limit law."""
    daily = t.events.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    first = t.events.agg(F.to_date(F.min("ts"))).scalar()
    side = F.when(F.col("day") < F.date_add(first, 18), "reference").otherwise("current")
    long = daily.select(F.col("event_type").alias("column"), "value", side.alias("window"))
    made = drift.numeric_drift(long, method="ks")
    return rounded(made, "ks_statistic", "ks_pvalue").select("column", "n_reference", "n_current", "ks_statistic", "ks_pvalue", "drifted")


CATEGORY = f"""{WINDOWS}, k AS (SELECT event_type, CAST(count(*) FILTER (side = 'reference') AS DOUBLE) AS r, CAST(count(*) FILTER (side = 'current') AS DOUBLE) AS c FROM lab GROUP BY 1),
  n AS (SELECT *, sum(r) OVER () AS nr, sum(c) OVER () AS nc FROM k),
  s AS (SELECT *, r / nr AS p, c / nc AS q, (r / nr + c / nc) / 2 AS m FROM n),
  cat AS (SELECT CAST(max(nr) AS BIGINT) AS n_reference, CAST(max(nc) AS BIGINT) AS n_current, count(*) AS n_levels, sum(power(c - p * nc, 2) / (p * nc)) AS chi2,
    sqrt(sum(CASE WHEN p > 0 THEN p * ln(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / m) ELSE 0 END) / 2) AS js FROM s)"""


@query(
    "drift_categorical",
    f"""
    WITH {CATEGORY} SELECT 'event_type' AS "column", n_reference, n_current, n_levels, {R('chi2')} AS chi2, {R('js')} AS js_distance,
      {R('exp(-chi2 / 2) * (1 + chi2 / 2)')} AS chi2_pvalue, CASE WHEN n_reference <= 1000 THEN 'chisquare' ELSE 'jensenshannon' END AS method,
      CASE WHEN n_reference <= 1000 THEN exp(-chi2 / 2) * (1 + chi2 / 2) < 0.05 ELSE js >= 0.1 END AS drifted FROM cat
    """,
)
def drift_categorical(t: Tables):
    """Five levels: with four degrees of freedom the tail has a closed form."""
    made = drift.categorical_drift(_windows(t), "event_type")
    return rounded(made, "chi2", "chi2_pvalue", "js_distance")


@query(
    "dataset_drift",
    f"""
    WITH {_drift_sql(VALUE_LONG)}, {CATEGORY.removeprefix(WINDOWS + ', ')}, d AS (SELECT CASE WHEN n_reference <= 1000 THEN p < 0.05 ELSE wd >= 0.1 END AS drifted FROM pv
      UNION ALL SELECT CASE WHEN n_reference <= 1000 THEN exp(-chi2 / 2) * (1 + chi2 / 2) < 0.05 ELSE js >= 0.1 END FROM cat)
    SELECT count(*) AS n_columns, count(*) FILTER (drifted) AS n_drifted, {R('avg(CAST(drifted AS INT))')} AS share_drifted, avg(CAST(drifted AS INT)) >= 0.5 AS dataset_drift FROM d
    """,
)
def dataset_drift(t: Tables):
    made = drift.dataset_drift(_windows(t), ["value", "user_id"], ["event_type"])
    return rounded(made, "share_drifted")


@query(
    "data_quality",
    f"""
    WITH {HOURLY}, g AS (SELECT CASE WHEN carbon > 1 THEN wind END AS wind, price FROM hourly), l AS (SELECT 'wind' AS "column", wind AS v FROM g UNION ALL SELECT 'price', price FROM g)
    SELECT "column", count(*) AS n, count(*) - count(v) AS missing, {R('(count(*) - count(v)) / count(*)')} AS missing_share, count(v) AS count, {R('avg(v)')} AS mean, {R('stddev_samp(v)')} AS std,
      {R('min(v)')} AS min, {R('max(v)')} AS max, {R('quantile_cont(v, 0.25)')} AS q25, {R('quantile_cont(v, 0.5)')} AS q50, {R('quantile_cont(v, 0.75)')} AS q75 FROM l GROUP BY 1
    """,
)
def data_quality(t: Tables):
    gappy = t.hourly.select(F.when(F.col("carbon") > 1, F.col("wind")).alias("wind"), "price")
    made = drift.data_quality(gappy, ["wind", "price"])
    return rounded(made, "missing_share", "mean", "std", "min", "max", "q25", "q50", "q75")


@query(
    "column_distribution",
    f"""
    WITH {WINDOWS}, e AS (SELECT min(value) AS lo, max(value) AS hi FROM lab),
    b AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 10)), 9) AS INT) AS bin, count(*) FILTER (side = 'reference') AS n_reference, count(*) FILTER (side = 'current') AS n_current FROM lab, e GROUP BY 1)
    SELECT *, {R('n_reference / sum(n_reference) OVER ()')} AS share_reference, {R('n_current / sum(n_current) OVER ()')} AS share_current FROM b
    """,
)
def column_distribution(t: Tables):
    return rounded(drift.column_distribution(_windows(t), "value"), "share_reference", "share_current")


EMBEDDING_LONG = """halves AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY vec_id) <= count(*) OVER () // 2 THEN 'reference' ELSE 'current' END AS side FROM embeddings),
  flat AS (SELECT side, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM halves),
  long AS (SELECT 'dim_' || i AS "column", CAST(x AS DOUBLE) AS v, side FROM flat)"""


@query("embedding_drift", f'WITH {_drift_sql(EMBEDDING_LONG)} SELECT "column", {DRIFT_COLUMNS} FROM pv')
def embedding_drift(t: Tables):
    """The earlier half of the vectors against the later half."""
    halves = sequences.half_split(t.embeddings.select("vec_id", "embedding"), ["vec_id"])
    return rounded(drift.embedding_drift(halves), *FIGURES)


RETRIEVAL_LONG = f"""{AB_LOG}, halves AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY ts, result_id) <= count(*) OVER () // 2 THEN 'reference' ELSE 'current' END AS side FROM ab),
  long AS (SELECT 'latency' AS "column", latency AS v, side FROM halves UNION ALL SELECT 'num_results', CAST(tokens_input AS DOUBLE), side FROM halves
    UNION ALL SELECT 'avg_score', 1 / (1 + latency), side FROM halves)"""


@query("retrieval_drift", f'WITH {_drift_sql(RETRIEVAL_LONG)} SELECT "column", {DRIFT_COLUMNS} FROM pv')
def retrieval_drift(t: Tables):
    """The log's first half against its second half, column by column."""
    log = t.ab_log.select(
        "ts", "result_id", "latency", F.col("tokens_input").alias("num_results"), (1 / (1 + F.col("latency"))).alias("avg_score")
    )
    halves = sequences.half_split(log, ["ts", "result_id"])
    long = unpivot(halves, ["latency", "num_results", "avg_score"], ["half"])
    return rounded(drift.numeric_drift(long, "half"), *FIGURES)


@query(
    "counter_by_label",
    f"WITH {AB_LOG} SELECT variant_id, CAST(sum(tokens_output) AS BIGINT) AS total FROM ab GROUP BY 1",
)
def counter_by_label(t: Tables):
    return rollups.counter_by_label(t.ab_log, ["variant_id"], "tokens_output")


RANGES = "make_timestamp((epoch_us(ts) // 60000000 - i) * 60000000)"


@query(
    "rate_sliding",
    f"SELECT event_type, {RANGES} AS window_start, count(*) AS n, {R('count(*) / 300.0', 9)} AS rate FROM events, range(5) g(i) GROUP BY 1, 2",
)
def rate_sliding(t: Tables):
    return rounded(rollups.rate_sliding(t.events, "ts", ["event_type"]), "rate", digits=9)


@query(
    "success_ratio_window",
    f"""
    SELECT {RANGES} AS window_start, count(*) FILTER (event_type <> 'error') AS n_ok, count(*) AS n, {R("count(*) FILTER (event_type <> 'error') * 100.0 / count(*)")} AS success_pct
    FROM events, range(5) g(i) GROUP BY 1
    """,
)
def success_ratio_window(t: Tables):
    return rounded(rollups.success_ratio_window(t.events, F.col("event_type") != "error"), "success_pct")


@query(
    "avg_latency_window",
    f"""
    WITH {AB_LOG} SELECT variant_id, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, {R('sum(latency)')} AS value_sum, count(latency) AS value_count, {R('avg(latency)')} AS value_avg FROM ab GROUP BY 1, 2
    """,
)
def avg_latency_window(t: Tables):
    made = rollups.avg_window(t.ab_log, "latency", "ts", ["variant_id"])
    return rounded(made, "value_sum", "value_avg")


BOUNDS = (0.5, 1.0, 2.5, 5.0, 10.0, 25.0)


@query(
    "histogram_quantile",
    f"""
    WITH {AB_LOG}, le AS (SELECT variant_id, b, count(*) FILTER (latency <= b) AS c, count(*) AS n FROM ab, (SELECT unnest([{", ".join(map(str, BOUNDS))}]::DOUBLE[]) AS b) GROUP BY 1, 2),
    st AS (SELECT *, lag(b, 1, 0) OVER w AS lo, lag(c, 1, 0) OVER w AS below, 0.95 * n AS rk FROM le WINDOW w AS (PARTITION BY variant_id ORDER BY b)),
    hit AS (SELECT variant_id, any_value(n) AS n, min(b) FILTER (c >= rk) AS upper FROM st GROUP BY 1)
    SELECT h.variant_id, h.n, {R('CASE WHEN upper IS NULL THEN 25.0 ELSE lo + (b - lo) * (rk - below) / (c - below) END')} AS quantile
    FROM hit h LEFT JOIN st ON st.variant_id = h.variant_id AND st.b = h.upper
    """,
)
def histogram_quantile(t: Tables):
    made = rollups.histogram_quantile(t.ab_log, "latency", 0.95, BOUNDS, ["variant_id"])
    return rounded(made, "quantile")


@query(
    "alert_for_duration",
    f"""
    WITH ticks AS (SELECT event_type, epoch_us(ts) // 30000000 AS k, count(*) AS n FROM events GROUP BY 1, 2),
    ev AS (SELECT event_type, k - i + 10 AS k2, sum(n) AS n FROM ticks, range(10) g(i) GROUP BY 1, 2),
    hot AS (SELECT *, k2 - row_number() OVER (PARTITION BY event_type ORDER BY k2) AS isl FROM ev WHERE n / 300.0 > 0.005),
    sp AS (SELECT event_type, min(k2) AS a, max(k2) AS z, count(*) AS n_evals, max(n / 300.0) AS peak FROM hot GROUP BY event_type, isl)
    SELECT event_type, make_timestamp(a * 30000000) AS pending_from, CASE WHEN z - a >= 10 THEN make_timestamp((a + 10) * 30000000) END AS firing_from,
      make_timestamp(z * 30000000) AS last_true, n_evals, {R('peak')} AS peak_rate, z - a >= 10 AS fired FROM sp
    """,
)
def alert_for_duration(t: Tables):
    return rounded(rollups.alert_for_duration(t.events, 0.005, "ts", ["event_type"]), "peak_rate")


def _toxicity_sql(step: int, copies: int, label: str) -> str:
    """Bucket quantiles (tox) of made-up toxicity scores per label and window, k steps after the epoch."""
    bounds = ", ".join(map(str, rollups.TOXICITY_BUCKETS))
    return f"""le AS (SELECT {label} AS label, epoch_us(ts) // {step * 1000000} - i AS k, b, count(*) FILTER (value / 200 <= b) AS c, count(*) AS n
      FROM events, range({copies}) g(i), (SELECT unnest([{bounds}]::DOUBLE[]) AS b) GROUP BY 1, 2, 3),
    st AS (SELECT *, lag(b, 1, 0) OVER w AS lo, lag(c, 1, 0) OVER w AS below, 0.95 * n AS rk FROM le WINDOW w AS (PARTITION BY label, k ORDER BY b)),
    hit AS (SELECT label, k, any_value(n) AS n, min(b) FILTER (c >= rk) AS upper FROM st GROUP BY 1, 2),
    tox AS (SELECT h.label, h.k, h.n, CASE WHEN upper IS NULL THEN 1.0 ELSE lo + (b - lo) * (rk - below) / (c - below) END AS q
      FROM hit h LEFT JOIN st ON st.label = h.label AND st.k = h.k AND st.b = h.upper)"""


def _toxicity(t: Tables):
    return t.events.withColumn("toxicity", F.col("value") / 200)


@query(
    "toxicity_quantile_window",
    f"""
    WITH {_toxicity_sql(300, 1, 'event_type')}
    SELECT label AS event_type, make_timestamp(k * 300000000) AS window_start, n, {R('q')} AS quantile FROM tox
    """,
)
def toxicity_quantile_window(t: Tables):
    """95th percentile of toxicity per label and five minutes."""
    made = rollups.histogram_quantile(_toxicity(t), "toxicity", 0.95, rollups.TOXICITY_BUCKETS, ["event_type"], "ts")
    return rounded(made, "quantile")


@query(
    "toxicity_alert",
    f"""
    WITH {_toxicity_sql(60, 60, "'all'")},
    hot AS (SELECT *, k + 60 AS k2, k - row_number() OVER (ORDER BY k) AS isl FROM tox WHERE q > 0.4),
    sp AS (SELECT min(k2) AS a, max(k2) AS z, count(*) AS n_evals, max(q) AS peak FROM hot GROUP BY isl)
    SELECT make_timestamp(a * 60000000) AS pending_from, CASE WHEN z - a >= 5 THEN make_timestamp((a + 5) * 60000000) END AS firing_from,
      make_timestamp(z * 60000000) AS last_true, n_evals, {R('peak')} AS peak_quantile, z - a >= 5 AS fired FROM sp
    """,
)
def toxicity_alert(t: Tables):
    """Spells of a high hourly toxicity percentile over all labels, evaluated every minute."""
    made = rollups.quantile_alert(
        _toxicity(t), "toxicity", 0.95, rollups.TOXICITY_BUCKETS, 0.4, "ts", range_seconds=3600, eval_seconds=60
    )
    return rounded(made, "peak_quantile")


@query(
    "gauge_last",
    "SELECT user_id, arg_max(value, struct_pack(ts, event_id)) AS last_value, max(ts) AS last_ts FROM events GROUP BY 1",
)
def gauge_last(t: Tables):
    return rollups.gauge_last(t.events, "value", ["user_id"], "ts", ["event_id"])


@query(
    "tumbling_hourly",
    f"SELECT event_type, date_trunc('hour', ts) AS ts, count(*) AS n, {R('sum(value)')} AS total FROM events GROUP BY 1, 2",
)
def tumbling_hourly(t: Tables):
    made = rollups.hourly(t.events, ["event_type"], {"n": F.count(F.lit(1)), "total": F.sum("value")})
    return rounded(made, "total")


@query(
    "session_activity",
    f"""
    WITH o AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opened FROM events),
    s AS (SELECT *, sum(opened) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events, {R('sum(value)')} AS value_sum FROM s GROUP BY user_id, k
    """,
)
def session_activity(t: Tables):
    return rounded(rollups.sessions(t.events, ["user_id"], 1800, "ts", "value"), "value_sum")


def _stream(t: Tables, name: str):
    schema = getattr(t, name).schema
    # a pattern fits a single file and a folder of files alike
    return jobs.stream_table(t.spark, f"{t.folder}/{name}.parquet*", schema)


@query(
    "stream_rates",
    "SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2",
)
def stream_rates(t: Tables):
    """Windowed counts kept up by micro-batches, whose shares are added up."""
    target = scratch_path(t.spark, "rates")
    jobs.count_stream(_stream(t, "events"), target, scratch_path(t.spark, "rates-state"), ["event_type"])
    return jobs.read_sums(t.spark, target, ["window_start", "event_type"])


@query(
    "stream_upsert",
    "SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id, arg_max(value, ts) AS value FROM events GROUP BY 1",
)
def stream_upsert(t: Tables):
    target = scratch_path(t.spark, "upsert")
    rows = _stream(t, "events").select("user_id", "ts", "event_id", "value")
    jobs.upsert_stream(rows, target, scratch_path(t.spark, "upsert-state"), ["user_id"], ["ts", "event_id"])
    return jobs.read_latest(t.spark, target, ["user_id"], ["ts", "event_id"])


@query(
    "stream_days",
    """
    SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value
    FROM events GROUP BY user_id, CAST(ts AS DATE)
    """,
)
def stream_days(t: Tables):
    """The latest event of each user and day, kept up in a table stored by day."""
    rows = _stream(t, "events").select("user_id", "ts", "event_id", "value")
    target = scratch_path(t.spark, "latest-by-day")
    table = DailyTable(t.spark, target, rows.schema, ["user_id"], "ts", order=["ts", "event_id"])
    table.append_stream(rows, scratch_path(t.spark, "latest-by-day-state"))
    return table.read()


@query(
    "stream_guardrails",
    f"""
    WITH asked AS (SELECT doc_id, text, make_timestamp((1704067200 + doc_id * 60) * 1000000) AS moment FROM documents), {VERDICT}
    SELECT time_bucket(INTERVAL 1 HOUR, moment) AS window_start, coalesce(violation, 'PASSED') AS outcome, count(*) AS n FROM verdicts GROUP BY 1, 2
    """,
)
def stream_guardrails(t: Tables):
    """Documents as a stream of inputs, one a minute."""
    target = scratch_path(t.spark, "violations")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    asked = _stream(t, "documents").withColumn("at", at)
    jobs.violation_stream(asked, target, scratch_path(t.spark, "violations-state"), "text", "at")
    return jobs.read_sums(t.spark, target, ["window_start", "outcome"])


# Violations of any kind and personal data, as two labels; thresholds a second and
# seconds to hold. A document a minute is asked, so a violation in five minutes is
# over the first threshold, and three in five minutes are over the second.
RULES = {"violation": (0.002, 300), "pii": (0.008, 600)}
LATE_SECONDS = 300


def _document_inputs(documents):
    """Documents as inputs, one a minute."""
    return documents.withColumn("at", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60))


@query(
    "stream_alerts",
    f"""
    WITH asked AS (SELECT doc_id, text, 1704067200 + doc_id * 60 AS moment FROM documents), {VERDICT},
    hit AS (SELECT 'violation' AS label, moment FROM verdicts WHERE violation IS NOT NULL UNION ALL SELECT 'pii', moment FROM verdicts WHERE violation = 'PII_DETECTED'),
    rules AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}::DOUBLE, {w})" for k, (v, w) in RULES.items())}) r(label, threshold, wait)),
    ticks AS (SELECT label, moment // 30 AS k, count(*) AS n FROM hit GROUP BY 1, 2),
    ev AS (SELECT label, k - i + 10 AS k2, sum(n) AS n FROM ticks, range(10) g(i) GROUP BY 1, 2),
    hot AS (SELECT ev.*, wait, k2 - row_number() OVER (PARTITION BY label ORDER BY k2) AS isl FROM ev JOIN rules USING (label) WHERE n / 300.0::DOUBLE > threshold),
    sp AS (SELECT label, min(k2) AS a, max(k2) AS z, any_value(wait) // 30 AS w FROM hot GROUP BY label, isl)
    SELECT label, make_timestamp(a * 30000000) AS pending_from, make_timestamp((a + w) * 30000000) AS firing_from FROM sp
    WHERE z - a >= w AND (a + w) * 30 <= (SELECT max(moment) - {LATE_SECONDS} FROM hit)
    """,
)
def stream_alerts(t: Tables):
    """Alerts on violations and personal data, fired by timers as the watermark moves."""
    spark = stateful.stateful_session(t.spark)
    asked = _document_inputs(_stream(Tables(spark, t.folder), "documents"))
    verdicts = jobs.outcomes(gr.validate_input(asked, "text"), "at").filter("outcome <> 'PASSED'")
    first = F.array(F.lit("violation"), F.when(F.col("outcome") == "PII_DETECTED", F.lit("pii")))
    hits = verdicts.select("at", F.explode(F.array_compact(first)).alias("label"))
    target = scratch_path(t.spark, "alerts")
    jobs.drain(stateful.alert_stream(hits, RULES, "label", "at", late=f"{LATE_SECONDS} seconds"), target, scratch_path(t.spark, "alerts-state"))
    return t.spark.read.parquet(target).drop("batch")


@query(
    "stream_sessions",
    f"""
    WITH o AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opened FROM events),
    s AS (SELECT *, sum(opened) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
    SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events, {R('sum(value)')} AS value_sum FROM s GROUP BY user_id, k
    HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTE FROM events)
    """,
)
def stream_sessions(t: Tables):
    """Sessions that the watermark has closed, from merging windows."""
    spark = stateful.stateful_session(t.spark)
    target = scratch_path(t.spark, "sessions")
    rows = _stream(Tables(spark, t.folder), "events").select("user_id", "ts", "value")
    jobs.drain(stateful.session_stream(rows, ["user_id"], value="value"), target, scratch_path(t.spark, "sessions-state"))
    return rounded(t.spark.read.parquet(target).drop("batch"), "value_sum")


@query(
    "stream_feedback",
    f"""
    WITH {AB_LOG}, fb AS (SELECT query, variant_id, result_id AS no, ts + INTERVAL 5 MINUTE AS given_at, CAST(result_id % 6 AS DOUBLE) AS score FROM ab WHERE tokens_input % 3 = 0),
    met AS (SELECT f.no, f.score, arg_max(a.result_id, (a.ts, a.result_id)) AS result_id FROM fb f JOIN ab a ON a.query = f.query AND a.variant_id = f.variant_id
      AND a.ts BETWEEN f.given_at - INTERVAL 30 DAY AND f.given_at GROUP BY 1, 2),
    upd AS (SELECT result_id, arg_max(score, no) AS score FROM met GROUP BY 1)
    SELECT result_id, query, variant_id, CAST(coalesce(upd.score, satisfaction_score) AS DOUBLE) AS satisfaction_score FROM ab LEFT JOIN upd USING (result_id)
    """,
)
def stream_feedback(t: Tables):
    """Feedback five minutes after a rated answer, joined with the answers as a
    stream; each goes to the newest answer of its query and variant."""
    spark = stateful.stateful_session(t.spark)
    own = Tables(spark, t.folder)

    def log():
        rows = LoggedStream(own, _stream(own, "events")).ab_log
        return rows.select("result_id", F.col("ts").alias("timestamp"), "query", "variant_id", "satisfaction_score", "tokens_input")

    feedback = log().filter(F.col("tokens_input") % 3 == 0).select(
        "query",
        "variant_id",
        F.col("result_id").alias("feedback_no"),
        (F.col("timestamp") + F.expr("INTERVAL 5 MINUTES")).alias("given_at"),
        (F.col("result_id") % 6).cast("double").alias("satisfaction_score"),
    )
    target = scratch_path(t.spark, "feedback")
    stateful.feedback_stream(feedback, log().drop("satisfaction_score", "tokens_input"), target, scratch_path(t.spark, "feedback-state"), ["query", "variant_id"], within="30 days")
    results = t.ab_log.select("result_id", F.col("ts").alias("timestamp"), "query", "variant_id", "satisfaction_score")
    updated, _ = stateful.read_feedback(t.spark, target, results)
    return updated.drop("timestamp")
