"""Experiment logs, significance tests and general statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampersift.operators import experiments as ab
from ampersift.operators import sketches, stats, text, upserts
from ampersift.queries.registry import AB_LOG, HOURLY, R, Tables, query, r, rounded
from ampersift.session import scratch_path

VARIANTS = ("control", "concise", "detailed", "conversational")

# numeric integration in the statements that need a tail probability
T_TAIL = """(SELECT 1 - 2 * sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
      * exp(lgamma((dof + 1) / 2) - lgamma(dof / 2) - ln(dof * pi()) / 2
            - (dof + 1) / 2 * ln(1 + power(abs(t) * i / 4000, 2) / dof))) * abs(t) / 4000 / 3 FROM range(4001) g(i))"""


@query(
    "assign_variant",
    """
    SELECT event_id, CASE WHEN event_type = 'error' THEN (CASE WHEN user_id % 2 = 0 THEN 'technical' END)
             WHEN b <= 40 THEN 'control' WHEN b <= 60 THEN 'concise' WHEN b <= 80 THEN 'detailed'
             ELSE 'conversational' END AS variant_id,
           event_type = 'error' AND user_id % 2 = 1 AS rejected
    FROM (SELECT *, CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS b FROM events)
    """,
)
def assign_variant(t: Tables):
    """By user, unless an override names a known or an unknown variant."""
    asked = F.when(
        F.col("event_type") == "error", F.when(F.col("user_id") % 2 == 0, "technical").otherwise("poetic")
    )
    rows = t.events.withColumn("asked", asked)
    return ab.assign_variant(rows, "user_id", "asked").select("event_id", "variant_id", "rejected")


@query(
    "token_cost",
    f"""
    WITH q AS (SELECT conv_id, turn, length(text) // 4 AS n FROM conversations WHERE role = 'user'),
    a AS (SELECT conv_id, turn - 1 AS turn, length(text) // 4 AS n FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, q.n AS tokens_input, a.n AS tokens_output,
           {R('q.n * (0.075::DOUBLE / 1000000) + a.n * (0.30::DOUBLE / 1000000)', 9)} AS cost
    FROM q JOIN a USING (conv_id, turn)
    """,
)
def token_cost(t: Tables):
    """Question and answer of the following turn."""
    said = t.conversations
    asked = said.filter("role = 'user'").select(
        "conv_id", "turn", ab.estimate_tokens("text").alias("tokens_input")
    )
    told = said.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), ab.estimate_tokens("text").alias("tokens_output")
    )
    cost = ab.token_cost(F.col("tokens_input"), F.col("tokens_output"))
    return asked.join(told, ["conv_id", "turn"]).withColumn("cost", r(cost, 9))


def _even(expression: str) -> str:
    return f"CAST(round_even({expression}, 4) AS DOUBLE)"


@query(
    "ab_summary",
    f"""
    WITH {AB_LOG}
    SELECT variant_id, {_even('avg(latency)')} AS latency_mean, {_even('stddev_samp(latency)')} AS latency_std,
           count(latency) AS latency_count, CAST(sum(tokens_input) AS BIGINT) AS tokens_input_sum,
           CAST(sum(tokens_output) AS BIGINT) AS tokens_output_sum, {_even('sum(cost)')} AS cost_sum,
           {_even('avg(cost)')} AS cost_mean, {_even('avg(satisfaction_score)')} AS satisfaction_mean,
           {_even('stddev_samp(satisfaction_score)')} AS satisfaction_std, count(satisfaction_score) AS satisfaction_count
    FROM ab GROUP BY variant_id
    """,
)
def ab_summary(t: Tables):
    return ab.ab_summary(t.ab_log)


STATS = f"""stats AS (
  SELECT variant_id, count(*) AS total_queries, avg(latency) AS avg_latency,
         avg(tokens_input + tokens_output) AS avg_tokens, sum(cost) AS total_cost,
         coalesce(avg(CASE WHEN satisfaction_score <> 0 THEN satisfaction_score END), 0) AS avg_satisfaction
  FROM ab GROUP BY variant_id),
  dim AS (SELECT * FROM (VALUES (0, 'control', 'Control (Original)', CAST(0.7 AS DOUBLE), 2048, CAST(40 AS DOUBLE)), (1, 'concise', 'Concise Variant', 0.5, 512, 20),
    (2, 'detailed', 'Detailed Variant', 0.8, 3072, 20), (3, 'conversational', 'Conversational Variant', 0.9, 2048, 20),
    (4, 'technical', 'Technical Variant', 0.3, 2048, 0)) AS v(ordinal, variant_id, name, temperature, max_tokens, traffic_pct)),
  report AS (SELECT dim.*, coalesce(total_queries, 0) AS total_queries, coalesce(avg_latency, 0) AS avg_latency,
         coalesce(avg_tokens, 0) AS avg_tokens, coalesce(total_cost, 0) AS total_cost, coalesce(avg_satisfaction, 0) AS avg_satisfaction,
         0.3 / (avg_latency + 0.1) + 0.3 / (total_cost / total_queries + 0.001) + avg_satisfaction * 0.4 AS score
         FROM dim LEFT JOIN stats USING (variant_id))"""
EVERYONE = ab.Experiment(ab.VARIANTS, ab.TRAFFIC_SPLIT)


@query(
    "ab_variant_stats",
    f"""
    WITH {AB_LOG}, {STATS}
    SELECT variant_id, total_queries, {R('avg_latency')} AS avg_latency, {R('avg_tokens')} AS avg_tokens,
           {R('total_cost')} AS total_cost, {R('avg_satisfaction')} AS avg_satisfaction FROM report
    """,
)
def ab_variant_stats(t: Tables):
    """The variant without traffic shows zeros."""
    made = ab.variant_stats(t.ab_log, EVERYONE)
    figures = ("avg_latency", "avg_tokens", "total_cost", "avg_satisfaction")
    return rounded(made.select("variant_id", "total_queries", *figures), *figures)


@query(
    "variant_report",
    f"""
    WITH {AB_LOG}, {STATS}
    SELECT variant_id, name, temperature, max_tokens, {R('traffic_pct')} AS traffic_pct, total_queries, {R('score', 4)} AS score FROM report
    """,
)
def variant_report(t: Tables):
    made = ab.variant_report(t.ab_log, EVERYONE)
    return made.select(
        "variant_id",
        "name",
        "temperature",
        "max_tokens",
        r("traffic_pct").alias("traffic_pct"),
        "total_queries",
        r("score", 4).alias("score"),
    )


@query(
    "ab_winner_report",
    f"WITH {AB_LOG}, {STATS} SELECT variant_id AS winner, {R('score', 4)} AS score FROM report WHERE score > 0 ORDER BY report.score DESC, ordinal LIMIT 1",
)
def ab_winner_report(t: Tables):
    return rounded(ab.comparison_winner(t.ab_log, EVERYONE), "score", digits=4)


@query(
    "ab_recommend",
    f"""
    WITH {AB_LOG}, s AS (SELECT variant_id, avg(latency) AS latency, avg(cost) AS cost, coalesce(avg(satisfaction_score), 0) AS satisfaction FROM ab GROUP BY 1),
    t AS (SELECT *, 0.30 / (latency + 0.1) + 0.20 / (cost + 0.001) + satisfaction * 0.50 AS total_score FROM s)
    SELECT variant_id, {R('latency')} AS latency, {R('cost', 9)} AS cost, {R('satisfaction')} AS satisfaction, {R('total_score', 4)} AS total_score,
           CAST(row_number() OVER (ORDER BY t.total_score DESC, variant_id) AS INT) AS rank,
           row_number() OVER (ORDER BY t.total_score DESC, variant_id) = 1 AS is_winner FROM t
    """,
)
def ab_recommend(t: Tables):
    made = rounded(ab.recommend(t.ab_log), "latency", "satisfaction")
    return rounded(rounded(made, "cost", digits=9), "total_score", digits=4)


PAIR_STATS = """m AS (SELECT variant_id AS g, count({x}) AS n, avg({x}) AS mean, var_samp({x}) AS var, var_pop({x}) AS var_pop
    FROM ab WHERE {x} IS NOT NULL GROUP BY 1),
  pairs AS (SELECT a.g AS variant_a, b.g AS variant_b, a.n AS n_a, b.n AS n_b, a.mean AS mean_a, b.mean AS mean_b,
      CAST(a.n + b.n - 2 AS DOUBLE) AS dof, a.var AS var_a, b.var AS var_b, a.var_pop AS vp_a, b.var_pop AS vp_b
      FROM m a JOIN m b ON a.g < b.g),
  tests AS (SELECT *, (mean_a - mean_b) / sqrt(((n_a - 1) * var_a + (n_b - 1) * var_b) / dof * (1.0 / n_a + 1.0 / n_b)) AS t FROM pairs)"""


def _ttest_sql(metric: str, where: str = "") -> str:
    return f"""
    WITH {AB_LOG}, {PAIR_STATS.format(x=metric)},
    p AS (SELECT *, {T_TAIL} AS p FROM tests {where})
    SELECT variant_a, variant_b, n_a, n_b, {R('mean_a')} AS mean_a, {R('mean_b')} AS mean_b, {R('mean_a - mean_b')} AS diff,
           {R('(mean_a - mean_b) / mean_a * 100')} AS diff_pct, {R('t')} AS t_statistic, dof, {R('p')} AS p_value, p < 0.05 AS significant
    FROM p
    """


def _ttest_columns(made):
    shown = rounded(made.drop("error"), "mean_a", "mean_b", "diff", "diff_pct", "t_statistic", "p_value")
    return shown


@query("ab_ttest", _ttest_sql("latency", "WHERE variant_a = 'concise' AND variant_b = 'control'"))
def ab_ttest(t: Tables):
    return _ttest_columns(stats.ttest(t.ab_log, "variant_id", "latency", "concise", "control"))


@query("ab_pairwise", _ttest_sql("satisfaction_score"))
def ab_pairwise(t: Tables):
    made = stats.pairwise_ttest(t.ab_log, "variant_id", "satisfaction_score")
    return _ttest_columns(made.filter(F.col("error").isNull()))


@query(
    "ab_anova",
    f"""
    WITH {AB_LOG}, g AS (SELECT variant_id, count(*) AS n, avg(latency) AS mean, sum(latency) AS s FROM ab GROUP BY 1),
    o AS (SELECT avg(latency) AS mean, count(*) AS n FROM ab),
    b AS (SELECT sum(g.n * power(g.mean - o.mean, 2)) AS ssb, count(*) AS k, any_value(o.n) AS n FROM g, o),
    w AS (SELECT sum(power(latency - g.mean, 2)) AS ssw FROM ab JOIN g USING (variant_id)),
    f AS (SELECT k, n, CAST(k - 1 AS DOUBLE) AS d1, CAST(n - k AS DOUBLE) AS d2, ssb, ssw, (ssb / (k - 1)) / (ssw / (n - k)) AS f FROM b, w),
    x AS (SELECT *, sqrt(1 - d2 / (d2 + d1 * f)) AS top FROM f),
    p AS (SELECT *, (SELECT 1 - sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
        * CASE WHEN i = 0 THEN 0 ELSE 2 * power(top * i / 4000, d1 - 1) * power(1 - power(top * i / 4000, 2), d2 / 2 - 1) END)
        * top / 4000 / 3 * exp(lgamma((d1 + d2) / 2) - lgamma(d1 / 2) - lgamma(d2 / 2)) FROM range(4001) g(i)) AS p FROM x)
    SELECT k, n, d1 AS df_between, d2 AS df_within, {R('ssb', 4)} AS ssb, {R('ssw', 4)} AS ssw, {R('f')} AS f_statistic, {R('p')} AS p_value, p < 0.05 AS significant FROM p
    """,
)
def ab_anova(t: Tables):
    made = stats.anova(t.ab_log, "variant_id", "latency")
    return rounded(rounded(made, "ssb", "ssw", digits=4), "f_statistic", "p_value")


@query(
    "ab_effect_size",
    f"""
    WITH {AB_LOG}, {PAIR_STATS.format(x='latency')},
    w AS (SELECT variant_a, variant_b, (mean_a - mean_b) / sqrt((vp_a + vp_b) / 2) AS d, (mean_a - mean_b) / sqrt(var_a / n_a + var_b / n_b) AS t,
          power(var_a / n_a + var_b / n_b, 2) / (power(var_a / n_a, 2) / (n_a - 1) + power(var_b / n_b, 2) / (n_b - 1)) AS dof FROM pairs),
    p AS (SELECT *, {T_TAIL} AS p FROM w)
    SELECT variant_a, variant_b, {R('d')} AS cohens_d, {R('t')} AS welch_t, {R('dof')} AS welch_dof, {R('p')} AS p_value, p < 0.05 AS significant FROM p
    """,
)
def ab_effect_size(t: Tables):
    made = stats.effect_sizes(t.ab_log, "variant_id", "latency")
    return rounded(made, "cohens_d", "welch_t", "welch_dof", "p_value")


@query(
    "ab_mann_whitney",
    f"""
    WITH {AB_LOG}, s AS (SELECT variant_id AS v, satisfaction_score AS x FROM ab WHERE satisfaction_score IS NOT NULL),
    names AS (SELECT DISTINCT v FROM s),
    pairs AS (SELECT a.v AS variant_a, b.v AS variant_b FROM names a JOIN names b ON a.v < b.v),
    pooled AS (SELECT variant_a, variant_b, s.v, x FROM pairs JOIN s ON s.v IN (variant_a, variant_b)),
    ranked AS (SELECT *, rank() OVER (PARTITION BY variant_a, variant_b ORDER BY x) + (count(*) OVER (PARTITION BY variant_a, variant_b, x) - 1) / 2.0 AS rk,
                      count(*) OVER (PARTITION BY variant_a, variant_b, x) AS ties FROM pooled),
    u AS (SELECT variant_a, variant_b, CAST(count(*) FILTER (v = variant_a) AS DOUBLE) AS n_a, CAST(count(*) FILTER (v = variant_b) AS DOUBLE) AS n_b,
                 sum(rk) FILTER (v = variant_a) AS r_a, sum(ties * ties - 1.0) AS tie_sum FROM ranked GROUP BY 1, 2),
    z AS (SELECT *, r_a - n_a * (n_a + 1) / 2 AS u, n_a + n_b AS n FROM u),
    zz AS (SELECT *, greatest(abs(u - n_a * n_b / 2) - 0.5, 0) / sqrt(n_a * n_b / 12 * ((n + 1) - tie_sum / (n * (n - 1)))) AS zs FROM z),
    p AS (SELECT *, (SELECT 1 - 2 * sum(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-power(zs * i / 2000, 2) / 2)) / sqrt(2 * pi()) * zs / 2000 / 3 FROM range(2001) g(i)) AS p FROM zz)
    SELECT variant_a, variant_b, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, CAST(u AS DOUBLE) AS u_statistic, {R('zs')} AS z, {R('p')} AS p_value, p < 0.05 AS significant FROM p
    """,
)
def ab_mann_whitney(t: Tables):
    made = stats.mann_whitney(t.ab_log, "variant_id", "satisfaction_score", VARIANTS)
    return rounded(made, "z", "p_value")


@query(
    "ab_mann_whitney_exact",
    f"""
    WITH {AB_LOG}, days AS (SELECT max(CAST(ts AS DATE)) AS last FROM ab),
    s AS (SELECT variant_id AS v, CAST(ts AS DATE) AS day, avg(latency) AS x FROM ab, days WHERE CAST(ts AS DATE) > last - 7 GROUP BY 1, 2),
    u AS (SELECT a.v AS variant_a, b.v AS variant_b, count(DISTINCT a.day) AS n_a, count(DISTINCT b.day) AS n_b, CAST(sum(CASE WHEN a.x > b.x THEN 1.0 WHEN a.x = b.x THEN 0.5 ELSE 0 END) AS DOUBLE) AS u
      FROM s a JOIN s b ON a.v < b.v GROUP BY 1, 2),
    sizes AS (SELECT DISTINCT n_a, n_b FROM u),
    orders AS (SELECT n_a, n_b, list_sum(list_transform(list_filter(range(0, n_a + n_b), lambda i: (mask >> i) & 1 = 1), lambda i: i + 1)) - n_a * (n_a + 1) // 2 AS w
      FROM sizes, (SELECT unnest(range(0, 16384)) AS mask) WHERE mask < 1 << (n_a + n_b) AND bit_count(mask) = n_a),
    tails AS (SELECT variant_a, variant_b, n_a, n_b, u, least(1, 2.0::DOUBLE * least(count(*) FILTER (w <= u), count(*) FILTER (w >= u)) / count(*)) AS p FROM u JOIN orders USING (n_a, n_b) GROUP BY 1, 2, 3, 4, 5)
    SELECT variant_a, variant_b, n_a, n_b, u AS u_statistic, {R('p')} AS p_value, p < 0.05 AS significant FROM tails
    """,
)
def ab_mann_whitney_exact(t: Tables):
    """Mean latencies of the last seven days by variant, seven against seven."""
    log = t.ab_log
    last = log.agg(F.to_date(F.max("ts"))).scalar()
    daily = log.filter(F.to_date("ts") > F.date_sub(last, 7)).groupBy("variant_id", F.to_date("ts").alias("day")).agg(F.avg("latency").alias("latency"))
    made = stats.mann_whitney(daily, "variant_id", "latency", VARIANTS)
    return rounded(made, "p_value").drop("z")


@query(
    "feedback_upsert",
    f"""
    WITH {AB_LOG}, fb AS (SELECT query, variant_id, max(result_id) % 6 AS score FROM ab WHERE tokens_input % 3 = 0 GROUP BY 1, 2),
    newest AS (SELECT query, variant_id, arg_max(result_id, ts) AS result_id FROM ab GROUP BY 1, 2),
    upd AS (SELECT result_id, score FROM newest JOIN fb USING (query, variant_id))
    SELECT result_id, query, variant_id, CAST(coalesce(upd.score, satisfaction_score) AS DOUBLE) AS satisfaction_score
    FROM ab LEFT JOIN upd USING (result_id)
    """,
)
def feedback_upsert(t: Tables):
    """One feedback per rated (query, variant), written to its latest result."""
    log = t.ab_log.withColumnRenamed("ts", "timestamp")
    given = (
        log.filter(F.col("tokens_input") % 3 == 0)
        .groupBy("query", "variant_id")
        .agg((F.max("result_id") % 6).cast("double").alias("satisfaction_score"))
        .withColumn("feedback_no", F.lit(1))
    )
    rows = log.select("result_id", "timestamp", "query", "variant_id", "satisfaction_score")
    return upserts.feedback_upsert(rows, given).drop("timestamp")


@query(
    "traffic_share",
    f"""
    WITH {AB_LOG} SELECT variant_id, count(*) AS queries, {R('avg(satisfaction_score)')} AS avg_satisfaction,
           {R('count(*) * 100.0 / (SELECT count(*) FROM ab)')} AS share_pct FROM ab GROUP BY 1
    """,
)
def traffic_share(t: Tables):
    return rounded(ab.traffic_share(t.ab_log), "avg_satisfaction", "share_pct")


@query(
    "describe_numeric",
    f"""
    WITH l AS (SELECT 'l_quantity' AS "column", l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
               UNION ALL SELECT 'l_discount', l_discount FROM lineitem)
    SELECT "column", count(v) AS count, {R('avg(v)', 4)} AS mean, {R('stddev_samp(v)', 4)} AS std, min(v) AS min, max(v) AS max,
           {R('quantile_cont(v, 0.25)')} AS q25, {R('quantile_cont(v, 0.5)')} AS q50, {R('quantile_cont(v, 0.75)')} AS q75 FROM l GROUP BY 1
    """,
)
def describe_numeric(t: Tables):
    made = stats.describe_numeric(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"])
    return rounded(rounded(made, "mean", "std", digits=4), "q25", "q50", "q75")


@query(
    "skewness_rank",
    f"""
    WITH {HOURLY} SELECT 'price' AS "column", {R('skewness(price)')} AS skewness FROM hourly UNION ALL SELECT 'carbon', {R('skewness(carbon)')} FROM hourly
    UNION ALL SELECT 'wind', {R('skewness(wind)')} FROM hourly UNION ALL SELECT 'radiation', {R('skewness(radiation)')} FROM hourly
    """,
)
def skewness_rank(t: Tables):
    return rounded(stats.skewness_rank(t.hourly, ["price", "carbon", "wind", "radiation"]), "skewness")


def _histogram_sql(column: str, source: str, bins: int = 30) -> str:
    return f"""SELECT '{column}' AS "column", CAST(least(floor(({column} - lo) / ((hi - lo) / {bins})), {bins - 1}) AS INT) AS bin, count(*) AS n,
      {R(f"min(lo + least(floor(({column} - lo) / ((hi - lo) / {bins})), {bins - 1}) * ((hi - lo) / {bins}))")} AS bin_start
      FROM {source}, (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}) GROUP BY 1, 2"""


@query("histogram", f"{_histogram_sql('o_totalprice', 'orders')}")
def histogram(t: Tables):
    return rounded(stats.histogram(t.orders, ["o_totalprice"]), "bin_start")


ORDER_NUMBERS = ("o_orderkey", "o_custkey", "o_totalprice")


@query("histogram_columns", " UNION ALL ".join(_histogram_sql(c, "orders") for c in ORDER_NUMBERS))
def histogram_columns(t: Tables):
    """Bins of every numeric column of the orders."""
    return rounded(stats.histogram(t.orders, ORDER_NUMBERS), "bin_start")


@query(
    "regression_metrics",
    f"""
    WITH {HOURLY}, p AS (SELECT series_id, wind AS y, lag(wind) OVER (PARTITION BY series_id ORDER BY ts) AS f FROM hourly),
    k AS (SELECT *, CASE WHEN f < 3 THEN 0 ELSE y END AS yy FROM p WHERE f IS NOT NULL)
    SELECT series_id, count(*) AS n, {R('avg(power(yy - f, 2))', 4)} AS mse, {R('sqrt(avg(power(yy - f, 2)))')} AS rmse, {R('avg(abs(yy - f))')} AS mae,
           {R('1 - avg(power(yy - f, 2)) / var_pop(yy)')} AS r2, count(*) FILTER (yy = 0) AS n_zero_target,
           CASE WHEN count(*) FILTER (yy = 0) > 0 THEN -1 ELSE {R('avg(abs(yy - f) / abs(yy))')} END AS mape FROM k GROUP BY 1
    """,
)
def regression_metrics(t: Tables):
    """The hour before as forecast; an infinite MAPE is shown as -1."""
    from ampersift.operators.features import lag_features

    rows = lag_features(t.hourly, {"wind": [1]}, ts="ts").withColumn(
        "y", F.when(F.col("wind_lag_1h") < 3, F.lit(0.0)).otherwise(F.col("wind"))
    )
    made = stats.regression_metrics(rows, "y", "wind_lag_1h", ["series_id"])
    mape = F.when(F.col("mape") == float("inf"), F.lit(-1.0)).otherwise(r("mape"))
    return rounded(rounded(made.withColumn("mape", mape), "mse", digits=4), "rmse", "mae", "r2")


@query(
    "best_model",
    f"""
    WITH {HOURLY}, p AS (SELECT series_id, ts, price AS y, lag(price, 1) OVER w AS persistence, lag(price, 24) OVER w AS daily,
        CASE WHEN count(price) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) = 24 THEN avg(price) OVER (w ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING) END AS rolling
        FROM hourly WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
    m AS (SELECT 'persistence' AS model, avg(abs(y - persistence)) AS mae FROM p WHERE persistence IS NOT NULL
          UNION ALL SELECT 'daily', avg(abs(y - daily)) FROM p WHERE daily IS NOT NULL UNION ALL SELECT 'rolling', avg(abs(y - rolling)) FROM p WHERE rolling IS NOT NULL)
    SELECT model AS best_model, {R('mae')} AS mae FROM m ORDER BY m.mae, model LIMIT 1
    """,
)
def best_model(t: Tables):
    """Three baselines compared by mean absolute error in one pass."""
    from ampersift.operators import features as fe

    rows = fe.lag_features(t.hourly.select("series_id", "ts", "price"), {"price": [1, 24]}, ts="ts")
    rows = fe.rolling_features(rows, ["price"], ts="ts", include_current=False)
    guesses = {"persistence": "price_lag_1h", "daily": "price_lag_24h", "rolling": "price_rolling_24h_mean"}
    long = rows.select(
        "price",
        F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("guess")) for m, c in guesses.items()])),
    )
    metrics = stats.regression_metrics(long, "price", "guess", ["model"])
    return rounded(stats.best_by(metrics, "model", "mae"), "mae")


@query(
    "success_rate",
    """
    SELECT user_id, count(*) AS total, CAST(round_even(avg(CAST(event_type <> 'error' AS INT)), 2) AS DOUBLE) AS success_rate,
           CAST(round_even(avg(CASE WHEN event_type <> 'error' THEN floor(value) END), 3) AS DOUBLE) AS avg_duration
    FROM events GROUP BY 1
    """,
)
def success_rate(t: Tables):
    ok = F.col("event_type") != "error"
    return stats.success_rate(t.events, ok, F.floor("value"), ["user_id"])


@query(
    "latency_percentiles",
    f"""
    WITH {AB_LOG} SELECT variant_id, {R('quantile_cont(latency, 0.5)')} AS p50, {R('quantile_cont(latency, 0.95)')} AS p95, {R('quantile_cont(latency, 0.99)')} AS p99
    FROM ab GROUP BY 1
    """,
)
def latency_percentiles(t: Tables):
    return rounded(stats.latency_percentiles(t.ab_log, "latency", ["variant_id"]), "p50", "p95", "p99")


SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query(
    "latency_sketches",
    f"""
    WITH {AB_LOG} SELECT variant_id, count(latency) AS n, TRUE AS p50, TRUE AS p95, TRUE AS p99 FROM ab WHERE latency IS NOT NULL GROUP BY 1
    """,
)
def latency_sketches(t: Tables):
    """Latency sketches of five minutes, stored and merged per variant: whether the
    rank of each estimate among all latencies is within the bound."""
    path = scratch_path(t.spark, "latency-sketches")
    sketches.quantile_sketches(t.ab_log, "latency", ["variant_id"]).write.parquet(path)
    merged = sketches.merge_sketches(t.spark.read.parquet(path), ["variant_id"])
    guessed = sketches.sketch_quantiles(merged, SHARES)
    both = t.ab_log.select("variant_id", "latency").join(guessed, "variant_id")
    # an estimate is a value: its rank lies between the shares below and up to it
    below = {k: F.avg((F.col("latency") < F.col(k)).cast("double")) for k in SHARES}
    up_to = {k: F.avg((F.col("latency") <= F.col(k)).cast("double")) for k in SHARES}
    close = [((below[k] <= p + sketches.RANK_ERROR) & (up_to[k] >= p - sketches.RANK_ERROR)).alias(k) for k, p in SHARES.items()]
    return both.groupBy("variant_id", "n").agg(*close)


@query(
    "category_crosstab",
    f"""
    SELECT o_orderpriority, count(*) AS total, {R("avg(CAST(o_orderstatus = 'F' AS INT))")} AS "share_F", {R("avg(CAST(o_orderstatus = 'O' AS INT))")} AS "share_O",
           {R("avg(CAST(o_orderstatus = 'P' AS INT))")} AS "share_P" FROM orders GROUP BY 1
    """,
)
def category_crosstab(t: Tables):
    made = stats.category_crosstab(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])
    return rounded(made, "share_F", "share_O", "share_P")


@query(
    "judge_score_parse",
    """
    WITH d AS (SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS d FROM documents), z AS (SELECT doc_id, d, ltrim(d, '0') AS v FROM d)
    SELECT doc_id, CASE WHEN d = '' THEN 3 WHEN length(v) > 1 THEN 5 ELSE greatest(1, least(5, coalesce(TRY_CAST(v AS INT), 0))) END AS score FROM z
    """,
)
def judge_score_parse(t: Tables):
    return t.documents.select("doc_id", text.judge_score("text").alias("score"))


@query(
    "composite_quality",
    f"""
    SELECT l_orderkey, l_linenumber, {R('l_discount * 0.4 + l_tax * 0.3 + l_quantity / 50 * 0.2 + l_extendedprice / 100000 * 0.1', 8)} AS quality FROM lineitem
    """,
)
def composite_quality(t: Tables):
    c = F.col
    score = text.composite_quality(
        c("l_discount"), c("l_tax"), c("l_quantity") / 50, c("l_extendedprice") / 100000
    )
    return t.lineitem.select("l_orderkey", "l_linenumber", r(score, 8).alias("quality"))


STRATEGY = """s AS (SELECT event_id, event_type AS strategy, 'question ' || CAST(user_id AS VARCHAR) AS question, 'answer ' || props AS generated_answer,
  1 / (1 + value) AS cosine_similarity,
  CASE WHEN regexp_replace(props, '[^0-9]', '', 'g') = '' THEN 3 ELSE greatest(1, least(5, CAST(regexp_replace(props, '[^0-9]', '', 'g') AS INT))) END AS quality_score FROM events)"""


def _answers(t: Tables):
    return t.events.select(
        "event_id",
        F.col("event_type").alias("strategy"),
        F.concat(F.lit("question "), "user_id").alias("question"),
        F.concat(F.lit("answer "), "props").alias("generated_answer"),
        (F.lit(1.0) / (F.col("value") + 1)).alias("cosine_similarity"),
        text.judge_score("props").alias("quality_score"),
    )


@query(
    "strategy_report",
    f"WITH {STRATEGY} SELECT strategy, {R('avg(cosine_similarity)')} AS avg_cosine_similarity, {R('avg(quality_score)')} AS avg_quality_score FROM s GROUP BY 1",
)
def strategy_report(t: Tables):
    return rounded(text.strategy_report(_answers(t)), "avg_cosine_similarity", "avg_quality_score")


@query(
    "strategy_examples",
    f"""
    WITH {STRATEGY}, k AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY event_id) AS rn FROM s)
    SELECT strategy, event_id, '**Q:** ' || question || chr(10) || '**Generated:** ' || generated_answer || chr(10) || '**Score:** '
      || CAST(quality_score AS VARCHAR) || '/5' || chr(10) || '---' || chr(10) AS report_text FROM k WHERE rn <= 2
    """,
)
def strategy_examples(t: Tables):
    return text.strategy_examples(_answers(t), "event_id").select("strategy", "event_id", "report_text")
