import datetime as dt

import pytest
from pyspark.sql import functions as F

from ampersift.operators import sequences
from ampersift.operators.upserts import last_n

START = dt.datetime(2024, 12, 1)


def series(spark, n, name="a"):
    rows = [(name, START + dt.timedelta(hours=i), float(i)) for i in range(n)]
    return spark.createDataFrame(rows, "series_id string, datetime timestamp_ntz, p double")


def test_sequences_count_and_content(spark):
    rows = sequences.make_sequences(series(spark, 30), "p", 24).orderBy("datetime").collect()
    assert len(rows) == 6
    assert list(rows[0].x) == [float(i) for i in range(24)] and rows[0].y == 24.0


def test_multi_horizon_starts(spark):
    rows = sequences.make_multi_horizon(series(spark, 100), "p", 24, 72).orderBy("datetime").collect()
    assert len(rows) == 100 - 72 - 24
    assert len(rows[0].x) == 24 and len(rows[0].y) == 72 and rows[0].y[0] == 24.0


def test_folds_are_disjoint_and_expand(spark):
    placed = sequences.walk_forward_folds(series(spark, 168 * 3 + 10))
    sizes = {r.fold: (r.train_rows, r.test_rows) for r in sequences.fold_sizes(placed).collect()}
    assert sizes == {0: (168, 168), 1: (336, 168)}
    assert placed.filter("test_fold is null").count() == 168 + 10


def test_last_rows_per_series(spark):
    both = series(spark, 5).unionByName(series(spark, 2, "b"))
    kept = last_n(both, 3, ["series_id"], "datetime")
    assert sorted((r.series_id, r.p) for r in kept.collect()) == [("a", 2.0), ("a", 3.0), ("a", 4.0), ("b", 0.0), ("b", 1.0)]


def test_calendar_crosses_leap_day_and_year(spark):
    df = spark.createDataFrame([(1, dt.datetime(2024, 2, 28, 23)), (2, dt.datetime(2024, 12, 31, 22))], "id int, datetime timestamp_ntz")
    rows = sequences.forecast_calendar(df, steps=3).orderBy("id", "step").collect()
    assert rows[0].forecast_date == "2024-02-29 00:00:00"
    assert [r.forecast_date for r in rows[3:]] == ["2024-12-31 23:00:00", "2025-01-01 00:00:00", "2025-01-01 01:00:00"]


def test_request_statuses(spark):
    rows = [
        (1, [[1.0]], 2, "2024-02-28 23:00:00"),
        (2, [], 2, "2024-02-28 23:00:00"),
        (3, [[1.0]], 2, ""),
        (4, [[1.0]], 2, "yesterday"),
        (5, [[1.0]], None, "2024-01-01 00:00:00"),
    ]
    df = spark.createDataFrame(rows, "id int, input_features array<array<double>>, steps int, last_timestamp string")
    out = {r.id: r for r in sequences.forecast_requests(df).collect()}
    assert list(out[1].forecast_dates) == ["2024-02-29 00:00:00", "2024-02-29 01:00:00"] and out[1].status == "success"
    assert out[2].status == "error: No input_features provided." and list(out[2].forecast_dates) == []
    assert out[3].status == "error: Missing last_timestamp."
    assert out[4].status.startswith("error:") and len(out[5].forecast_dates) == 72


def test_seasonal_naive_repeats_the_last_day(spark):
    out = sequences.seasonal_naive(series(spark, 50), "p").orderBy("step").collect()
    assert len(out) == 72
    assert [r.forecast for r in out[:24]] == [float(i) for i in range(26, 50)]
    assert out[24].forecast == out[0].forecast
    with_gap = sequences.seasonal_naive(series(spark, 50).filter(F.col("p") != 30), "p").orderBy("step").collect()
    assert with_gap[4].forecast is None and with_gap[5].forecast == 31.0


def test_empty_series(spark):
    assert sequences.make_sequences(series(spark, 30).limit(0), "p").count() == 0
    with pytest.raises(Exception):
        sequences.make_sequences(series(spark, 3), "absent").count()
