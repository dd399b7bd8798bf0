"""Tree and linear models on engineered features, with Spark ML."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import product
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampersift.functions.columns import quoted
from ampersift.operators.regression import walk_forward
from ampersift.operators.sequences import forecast_calendar
from ampersift.operators.stats import best_by, regression_metrics
from ampersift.session import freeze

SEED = 42
CONCURRENT_FITS = 4


def _side_by_side(task: Callable, items: Iterable) -> list:
    """Run a few fits at a time; each is a distributed job, the threads only wait."""
    with ThreadPool(CONCURRENT_FITS) as pool:
        return pool.map(inheritable_thread_target(SparkSession.active())(task), list(items))


def fit_regressor(
    train: DataFrame, features: Sequence[str], target: str, regressor: str = "rf", **params
) -> PipelineModel:
    """Assemble the features and fit a forest (rf), boosted trees (gbt) or a line (lr)."""
    kinds = {"rf": RandomForestRegressor, "gbt": GBTRegressor, "lr": LinearRegression}
    seed = {} if regressor == "lr" else {"seed": SEED}
    model = kinds[regressor](
        featuresCol="_features", labelCol=target, predictionCol="prediction", **seed, **params
    )
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_features"), model]).fit(train)


def importances(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Feature importances as rows; as many as there are features."""
    weights = model.stages[-1].featureImportances.toArray().tolist()
    return df.sparkSession.createDataFrame(
        list(zip(features, weights)), "feature string, importance double"
    )


def importance_topk(ranked: DataFrame, k: int = 25) -> DataFrame:
    return ranked.orderBy(F.col("importance").desc(), "feature").limit(k)


def importance_compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """Importances of two models side by side with their mean, largest first."""
    a = first.withColumnRenamed("importance", "rf_importance")
    b = second.withColumnRenamed("importance", "gbt_importance")
    return (
        a.join(b, "feature")
        .withColumn("avg_importance", (F.col("rf_importance") + F.col("gbt_importance")) / 2)
        .orderBy(F.col("avg_importance").desc(), "feature")
    )


def evaluate(model: PipelineModel, rows: DataFrame, target: str, by: Sequence[str] = ()) -> DataFrame:
    return regression_metrics(model.transform(rows), target, "prediction", by)


def param_search(
    train: DataFrame,
    holdout: DataFrame,
    features: Sequence[str],
    target: str,
    regressor: str,
    grid: dict[str, Sequence],
) -> DataFrame:
    """Hold-out error of every parameter combination, best first.

    The hold-out is later in time than the training rows.
    """

    def trial(numbered: tuple) -> tuple:
        number, values = numbered
        params = dict(zip(grid, values))
        model = fit_regressor(train, features, target, regressor, **params)
        row = evaluate(model, holdout, target).select("mse", "rmse", "mae", "r2").first()
        return (number, ", ".join(f"{k}={v}" for k, v in params.items()), *map(float, row))

    scored = _side_by_side(trial, enumerate(product(*grid.values())))
    return train.sparkSession.createDataFrame(
        scored, "trial int, params string, mse double, rmse double, mae double, r2 double"
    ).orderBy("mse", "trial")


def compare_models(
    train: DataFrame, holdout: DataFrame, features: Sequence[str], target: str, candidates: dict[str, dict]
) -> DataFrame:
    """Hold-out metrics of several regressors."""
    parts = []
    for kind, params in candidates.items():
        model = fit_regressor(train, features, target, kind, **params)
        parts.append(evaluate(model, holdout, target).withColumn("model", F.lit(kind)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def best_model(metrics: DataFrame, metric: str = "mae") -> DataFrame:
    return best_by(metrics, "model", metric)


def training_metadata(
    rows: DataFrame, features: Sequence[str], target: str, ts: str, model_type: str, seq_length: int = 24
) -> DataFrame:
    """The one-row record kept beside a saved model."""
    return rows.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(quoted(ts)).alias("data_from"),
        F.max(quoted(ts)).alias("data_to"),
    ).select(
        F.lit(model_type).alias("model_type"),
        F.lit(seq_length).alias("seq_length"),
        F.lit(len(features)).alias("n_features"),
        F.array(*[F.lit(f) for f in features]).alias("features"),
        F.lit(target).alias("target"),
        "n_rows",
        "data_from",
        "data_to",
    )


def horizon_rows(
    origins: DataFrame, horizon: int, ts: str, keep: Sequence[str]
) -> DataFrame:
    """One row per origin and hour ahead, with the calendar of the target hour."""
    future = forecast_calendar(origins.select(*[quoted(c) for c in keep], quoted(ts)), ts, horizon)
    return future.withColumns(
        {"target_hour": F.hour("forecast_ts"), "target_dow": F.weekday("forecast_ts")}
    )


def forecast_direct(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    series: Sequence[str] = ("series_id",),
    ts: str = "datetime",
    horizon: int = 72,
    regressor: str = "rf",
    **params,
) -> DataFrame:
    """Forecast the next ``horizon`` hours of every series with one model.

    The hour ahead is a feature, so all steps are predicted at once and no
    prediction is fed back. Training pairs join each origin to the actual value
    of its target hours.
    """
    by = list(series)
    actual = df.select(*by, quoted(ts).alias("forecast_ts"), quoted(target).alias("_y"))
    known = df.na.drop(subset=list(features))
    pairs = horizon_rows(known, horizon, ts, [*by, *features]).join(actual, [*by, "forecast_ts"])
    inputs = [*features, "step", "target_hour", "target_dow"]
    model = fit_regressor(pairs.filter(F.col("_y").isNotNull()), inputs, "_y", regressor, **params)
    payload = F.struct(*[quoted(f) for f in features])
    last = known.groupBy(*by).agg(F.max(quoted(ts)).alias(ts), F.max_by(payload, quoted(ts)).alias("_f"))
    latest = last.select(*by, quoted(ts), "_f.*")
    return model.transform(horizon_rows(latest, horizon, ts, [*by, *features])).select(
        *by, "step", "forecast_ts", F.col("prediction").alias("forecast")
    )


def forecast_summary(forecast: DataFrame, by: Sequence[str] = (), value: str = "forecast") -> DataFrame:
    return forecast.groupBy(*by).agg(
        F.avg(value).alias("avg_forecast"), F.min(value).alias("min_forecast"), F.max(value).alias("max_forecast")
    )


def walk_forward_eval(
    folds: DataFrame,
    features: Sequence[str],
    target: str,
    ridge: float = 0.0,
) -> DataFrame:
    """RMSE per fold of a linear model trained on everything before the fold.

    ``folds`` carries ``block`` and ``test_fold``. All folds are solved from the
    running normal equations of their blocks. A fold without training rows has no
    figures and says so; any other failure ends the job.
    """
    made = walk_forward(folds, features, target, ridge=ridge)
    return made.select(F.col("fold").cast("int").alias("fold"), "test_rows", "rmse", "mae", "error")
