"""Models on hourly features. Fitted results depend on the learner, so only their rows are checked."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampersift.operators import features as fe
from ampersift.operators import models, regression, sequences
from ampersift.queries.registry import HOURLY, R, Tables, query, rounded

INPUTS = ("hour", "day_of_week", "is_weekend", "hour_sin", "hour_cos", "price_lag_1h", "price_lag_24h", "carbon", "wind")
SMALL = {"numTrees": 10, "maxDepth": 4}
BOOSTED = {"maxIter": 5, "maxDepth": 3}


def training_rows(t: Tables):
    """Complete feature rows of all series with a chronological split."""
    rows = fe.temporal_features(fe.lag_features(t.hourly, {"price": [1, 24]}, ts="ts"), "ts")
    known = fe.drop_incomplete(rows.select("series_id", "ts", "price", *INPUTS), "price")
    return sequences.chrono_split(known, ["ts"], by=["series_id"])


def _parts(t: Tables):
    rows = training_rows(t)
    return rows.filter("split = 'train'"), rows.filter("split = 'val'")


@query("rf_importance")
def rf_importance(t: Tables):
    train, _ = _parts(t)
    return models.importances(models.fit_regressor(train, INPUTS, "price", "rf", **SMALL), train, INPUTS)


@query("gbt_importance")
def gbt_importance(t: Tables):
    train, _ = _parts(t)
    return models.importances(models.fit_regressor(train, INPUTS, "price", "gbt", **BOOSTED), train, INPUTS)


@query("importance_topk")
def importance_topk(t: Tables):
    return models.importance_topk(rf_importance(t), 5)


@query("importance_compare")
def importance_compare(t: Tables):
    train, _ = _parts(t)
    forest = models.importances(models.fit_regressor(train, INPUTS, "price", "rf", **SMALL), train, INPUTS)
    boosted = models.importances(models.fit_regressor(train, INPUTS, "price", "gbt", **BOOSTED), train, INPUTS)
    return models.importance_compare(forest, boosted)


@query("param_search")
def param_search(t: Tables):
    train, val = _parts(t)
    grid = {"numTrees": [5, 10], "maxDepth": [3, 5]}
    return models.param_search(train, val, INPUTS, "price", "rf", grid)


@query("model_selection")
def model_selection(t: Tables):
    train, val = _parts(t)
    metrics = models.compare_models(train, val, INPUTS, "price", {"rf": SMALL, "gbt": BOOSTED, "lr": {"regParam": 0.01}})
    return models.best_model(metrics)


@query(
    "training_rows",
    f"""
    WITH {HOURLY}, l AS (SELECT series_id, ts, lag(price, 24) OVER (PARTITION BY series_id ORDER BY ts) AS day_before FROM hourly),
    k AS (SELECT series_id, ts, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY series_id) AS n FROM l WHERE day_before IS NOT NULL)
    SELECT series_id, ts, CASE WHEN rn <= floor(0.8 * n) THEN 'train' ELSE 'val' END AS split FROM k
    """,
)
def labelled_rows(t: Tables):
    return training_rows(t).select("series_id", "ts", "split")


@query(
    "training_metadata",
    f"""
    WITH {HOURLY}, l AS (SELECT series_id, ts, lag(price, 24) OVER (PARTITION BY series_id ORDER BY ts) AS day_before FROM hourly)
    SELECT 'rf' AS model_type, {len(INPUTS)} AS n_features, count(*) AS n_rows, min(ts) AS data_from, max(ts) AS data_to FROM l WHERE day_before IS NOT NULL
    """,
)
def training_metadata(t: Tables):
    rows = training_rows(t)
    return models.training_metadata(rows, INPUTS, "price", "ts", "rf").select(
        "model_type", "n_features", "n_rows", "data_from", "data_to"
    )


@query("forecast_direct")
def forecast_direct(t: Tables):
    rows = fe.lag_features(t.hourly, {"price": [1, 23]}, ts="ts")
    made = models.forecast_direct(
        rows, ["price", "price_lag_1h", "price_lag_23h"], "price", ts="ts", horizon=72, numTrees=5, maxDepth=4
    )
    return rounded(made, "forecast")


@query("forecast_summary")
def forecast_summary(t: Tables):
    return models.forecast_summary(forecast_direct(t), ["series_id"])


@query("walk_forward_eval")
def walk_forward_eval(t: Tables):
    rows = fe.temporal_features(fe.lag_features(t.hourly, {"price": [1, 24]}, ts="ts"), "ts")
    placed = sequences.walk_forward_folds(rows, "ts")
    made = models.walk_forward_eval(placed, ["price_lag_1h", "price_lag_24h", "hour_sin", "hour_cos", "carbon"], "price")
    return made.withColumn("rmse", F.round("rmse", 6))


@query(
    "walk_forward_line",
    f"""
    WITH {HOURLY}, l AS (SELECT series_id, ts, price, lag(price, 24) OVER (PARTITION BY series_id ORDER BY ts) AS x,
      row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS p, count(*) OVER (PARTITION BY series_id) AS n FROM hourly),
    k AS (SELECT *, p // 168 AS block, CASE WHEN p // 168 >= 1 AND (p // 168 + 1) * 168 <= n THEN p // 168 - 1 END AS fold FROM l),
    wanted AS (SELECT DISTINCT series_id, fold FROM k WHERE fold IS NOT NULL),
    lines AS (SELECT w.series_id, w.fold, count(*) AS train_rows, regr_slope(price, x) AS slope, regr_intercept(price, x) AS intercept
      FROM wanted w JOIN k ON k.series_id = w.series_id AND k.block <= w.fold WHERE x IS NOT NULL GROUP BY 1, 2)
    SELECT series_id, CAST(fold AS BIGINT) AS fold, train_rows, count(*) AS test_rows, {R('any_value(slope)')} AS slope, {R('any_value(intercept)')} AS intercept,
      {R('sqrt(avg((price - intercept - slope * x) ** 2))')} AS rmse, {R('avg(abs(price - intercept - slope * x))')} AS mae
    FROM lines JOIN k USING (series_id, fold) WHERE x IS NOT NULL GROUP BY 1, 2, 3
    """,
)
def walk_forward_line(t: Tables):
    """Every series' price by that of the day before, refitted for each week."""
    rows = fe.lag_features(t.hourly, {"price": [24]}, ts="ts")
    placed = sequences.walk_forward_folds(rows, "ts")
    made = regression.walk_forward(placed, ["price_lag_24h"], "price", by=["series_id"])
    out = made.select("series_id", "fold", "train_rows", "test_rows", F.col("slopes")[0].alias("slope"), "intercept", "rmse", "mae")
    return rounded(out, "slope", "intercept", "rmse", "mae")
