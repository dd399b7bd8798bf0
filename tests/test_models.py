import datetime as dt

import pytest
from pyspark.sql import functions as F

from ampersift.operators import models
from ampersift.operators.features import lag_features
from ampersift.operators.sequences import chrono_split, walk_forward_folds

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def table(spark):
    rows = [("a", T0 + dt.timedelta(hours=i), float(i % 24), float((i * 7) % 5)) for i in range(24 * 25)]
    df = spark.createDataFrame(rows, "series_id string, datetime timestamp_ntz, price double, noise double")
    return lag_features(df, {"price": [23]}).cache()


def test_importances_find_the_signal(table):
    rows = chrono_split(table.na.drop(), ["datetime"])
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    model = models.fit_regressor(train, ["price_lag_23h", "noise"], "price", "rf", numTrees=5, maxDepth=5)
    ranked = models.importances(model, train, ["price_lag_23h", "noise"])
    assert models.importance_topk(ranked, 1).first().feature == "price_lag_23h"
    assert models.evaluate(model, val, "price").first().r2 > 0.9
    both = models.importance_compare(ranked, ranked).collect()
    assert both[0].avg_importance == both[0].rf_importance


def test_search_and_selection(table):
    rows = chrono_split(table.na.drop(), ["datetime"])
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    trials = models.param_search(train, val, ["price_lag_23h", "noise"], "price", "rf", {"maxDepth": [1, 5], "numTrees": [3]}).collect()
    assert trials[0].params == "maxDepth=5, numTrees=3" and trials[0].mse < trials[1].mse
    metrics = models.compare_models(train, val, ["price_lag_23h"], "price", {"rf": {"maxDepth": 5, "numTrees": 3}, "lr": {}})
    assert models.best_model(metrics).first().best_model == "rf"
    meta = models.training_metadata(train, ["price_lag_23h"], "price", "datetime", "rf").first()
    assert meta.n_features == 1 and meta.n_rows == train.count()


def test_direct_forecast_has_every_hour(table):
    out = models.forecast_direct(table, ["price", "price_lag_23h"], "price", horizon=6, numTrees=3, maxDepth=6)
    rows = out.orderBy("step").collect()
    assert [r.step for r in rows] == list(range(1, 7))
    assert rows[0].forecast_ts == T0 + dt.timedelta(hours=600)
    summary = models.forecast_summary(out).first()
    assert summary.min_forecast <= summary.avg_forecast <= summary.max_forecast


def test_walk_forward_reports_failed_folds(table):
    placed = walk_forward_folds(table)
    rows = models.walk_forward_eval(placed, ["price_lag_23h", "noise"], "price").orderBy("fold").collect()
    assert [r.fold for r in rows] == [0, 1] and all(r.error is None and r.test_rows == 168 for r in rows)
    empty = placed.withColumn("noise", F.when(F.col("block") > 0, F.col("noise")))
    broken = models.walk_forward_eval(empty, ["price_lag_23h", "noise"], "price").orderBy("fold").collect()
    assert [r.fold for r in broken] == [0, 1]
    assert broken[0].error and broken[0].rmse is None and broken[1].error is None
