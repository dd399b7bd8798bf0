import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from ampersift.operators import features as fe
from ampersift.operators import stats
from ampersift.operators.ordering import exact_quantiles
from ampersift.plans import energy as plans
from ampersift.sources.tables import ENERGY_SCHEMA, to_utc


def hours(n, start=dt.datetime(2024, 10, 29)):
    return [start + dt.timedelta(hours=i) for i in range(n)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_calendar_parts(spark):
    stamps = [dt.datetime(2024, 10, 26, 17), dt.datetime(2024, 12, 30, 23), dt.datetime(2024, 10, 28, 6)]
    rows = fe.temporal_features(frame(spark, [(s,) for s in stamps], "datetime timestamp_ntz")).collect()
    sat, year_end, mon = rows
    assert (sat.day_of_week, sat.is_weekend, sat.is_peak_hour, sat.is_night) == (5, 1, 1, 0)
    assert year_end.week_of_year == 1 and year_end.is_night == 1
    assert (mon.day_of_week, mon.is_night, mon.day_of_month) == (0, 1, 28)
    assert mon.hour_sin == pytest.approx(1.0)
    assert mon.month_cos == pytest.approx(math.cos(2 * math.pi * 10 / 12))


def test_interactions_keep_missing_values_missing(spark):
    names = [fe.WIND, fe.SOLAR, fe.GAS, fe.TEMPERATURE, fe.RADIATION, fe.CARBON, fe.PRICE]
    schema = ", ".join(f"`{n}` double" for n in names)
    df = frame(spark, [(30.0, 5.0, 45.0, 10.0, 100.0, 200.0, 0.25), (1.0, None, 2.0, None, 3.0, 4.0, -1e-6)], schema)
    first, gap = fe.interaction_features(df).collect()
    assert first.renewable_pct == 35.0 and first.heating_demand == 8.0 and first.cooling_demand == 0.0
    assert first.wind_solar_combined == 3000.0 and first.carbon_per_price == pytest.approx(200 / 0.250001)
    assert gap.heating_demand is None and gap.cooling_demand is None and gap.renewable_pct is None
    assert gap.carbon_per_price is None


def test_log_transforms_only_where_present(spark):
    df = frame(spark, [(None, 1.0), (math.e - 1, 2.0)], "so2 double, other double")
    out = fe.log_transforms(df)
    assert "log_other" not in out.columns
    assert [r.log_so2 for r in out.collect()] == [0.0, pytest.approx(1.0)]
    assert fe.log_transforms(df, missing_as_zero=False).first().log_so2 is None


def test_standard_scale_population_deviation(spark):
    df = frame(spark, [(10.0, 5.0), (20.0, 5.0), (30.0, 5.0)], "temperature_C double, `humidity_%` double")
    rows = fe.standard_scale(df, fe.DAILY_SCALED).orderBy("temperature_C").collect()
    assert [r["scaled_temperature_C"] for r in rows] == pytest.approx([-1.224745, 0, 1.224745], abs=1e-6)
    assert [r["scaled_humidity_%"] for r in rows] == [0, 0, 0]


def test_minmax_roundtrip_and_constant(spark):
    df = frame(spark, [(2.0, 7.0), (4.0, 7.0), (3.0, 7.0)], "a double, b double")
    scaled = fe.minmax_scale(df, ["a", "b"])
    assert sorted(r.mm_a for r in scaled.collect()) == [0.0, 0.5, 1.0]
    assert {r.mm_b for r in scaled.collect()} == {0.0}
    back = fe.minmax_restore(scaled.drop("a", "b"), fe.minmax_fit(df, ["a", "b"]), ["a", "b"])
    assert sorted((r.a, r.b) for r in back.collect()) == [(2.0, 7.0), (3.0, 7.0), (4.0, 7.0)]


def test_lags_by_row_and_by_time_differ_over_a_gap(spark):
    stamps = [s for i, s in enumerate(hours(6)) if i != 2]
    df = frame(spark, [("a", s, float(i)) for i, s in enumerate(stamps)], "series_id string, datetime timestamp_ntz, p double")
    by_row = [r.p_lag_1h for r in fe.lag_features(df, {"p": [1]}).orderBy("datetime").collect()]
    by_time = [r.p_lag_1h for r in fe.lag_by_time(df, {"p": [1]}).orderBy("datetime").collect()]
    assert by_row == [None, 0, 1, 2, 3]
    assert by_time == [None, 0, None, 2, 3]


def test_rolling_needs_a_full_window(spark):
    df = frame(spark, [("a", s, float(i)) for i, s in enumerate(hours(25))], "series_id string, datetime timestamp_ntz, p double")
    rows = fe.rolling_features(df, ["p"]).orderBy("datetime").collect()
    assert [r.p_rolling_24h_mean for r in rows[:23]] == [None] * 23
    assert rows[23].p_rolling_24h_mean == pytest.approx(11.5)
    assert rows[23].p_rolling_24h_std == pytest.approx(math.sqrt(50))
    leak_free = fe.rolling_features(df, ["p"], include_current=False).orderBy("datetime").collect()
    assert leak_free[23].p_rolling_24h_mean is None and leak_free[24].p_rolling_24h_mean == pytest.approx(11.5)


def test_drop_incomplete_treats_nan_as_missing(spark):
    df = frame(spark, [(1.0, 1.0), (float("nan"), 1.0), (1.0, None), (None, 2.0)], "y double, x double")
    assert fe.drop_incomplete(df, "y").count() == 1
    with pytest.raises(ValueError, match="empty"):
        fe.require_rows(df.limit(0), "empty table")


def test_time_filters(spark):
    stamps = [dt.datetime(2025, 8, 1, 23), dt.datetime(2025, 8, 2), dt.datetime(2025, 10, 27), dt.datetime(2025, 10, 27, 1)]
    df = frame(spark, [(s,) for s in stamps], "datetime timestamp_ntz")
    assert fe.time_range(df, "2025-08-02", "2025-10-27").count() == 2
    last = fe.last_n_days(frame(spark, [(dt.datetime(2025, 1, 1),), (dt.datetime(2025, 1, 2),), (dt.datetime(2025, 4, 1),)], "datetime timestamp_ntz"))
    assert [r.datetime.day for r in last.orderBy("datetime").collect()] == [2, 1]
    day = fe.day_before(df, "2025-10-28")
    assert day.count() == 2


def test_price_bands_and_day_parts(spark):
    df = frame(spark, [(0.29, 5), (0.3, 6), (0.69, 12), (0.7, 18)], "p double, h int")
    rows = df.select(fe.price_category("p"), fe.day_part("h")).collect()
    assert [tuple(r) for r in rows] == [("Low", "night"), ("Medium", "morning"), ("Medium", "day"), ("High", "evening")]


def test_completeness_flags_and_lists_missing_hours(spark):
    df = frame(spark, [(h, None if i < 3 else 1.0) for i, h in enumerate(hours(5))], "datetime timestamp_ntz, c double")
    row = fe.completeness(df, ["c"], limits={"c": 2}).first()
    assert (row.n_rows, row.missing_c, row.warn) == (5, 3, True)
    assert not fe.completeness(df, ["c"], limits={"c": 3}).first().warn
    assert fe.missing_hours(df, "c").count() == 3


def test_feature_contract_is_complete_and_enforced(spark):
    names = [f.name for f in ENERGY_SCHEMA if f.name not in ("datetime", "carbon_index")]
    rows = [(h, *[float(i + j) for j in range(len(names))]) for i, h in enumerate(hours(30))]
    df = frame(spark, rows, "datetime timestamp_ntz, " + ", ".join(f"`{n}` double" for n in names))
    made = plans.contract_features(df)
    assert tuple(made.columns) == fe.SELECTED_FEATURES and made.count() == 30
    with pytest.raises(ValueError, match="missing"):
        fe.select_features(df)
    prefixed = fe.columns_with_prefix(made, also=["hour"])
    assert all(c.startswith("scaled_") or c == "hour" for c in prefixed.columns)


def test_incremental_feature_runs_scale_their_own_batch(spark):
    names = list(fe.DAILY_SCALED) + [fe.SOLAR, fe.RADIATION, fe.PRICE]
    schema = "datetime timestamp_ntz, " + ", ".join(f"`{n}` double" for n in names)
    all_rows = [(h, *[float(i * (j + 1)) for j in range(len(names))]) for i, h in enumerate(hours(6))]
    first = plans.update_features(frame(spark, all_rows[:3], schema), None)
    both = plans.update_features(frame(spark, all_rows, schema), first).orderBy("datetime").collect()
    expected = [-1.224745, 0, 1.224745] * 2
    assert [r["scaled_temperature_C"] for r in both] == pytest.approx(expected, abs=1e-6)
    whole = plans.update_features(frame(spark, all_rows, schema), first, fit_scope="global").orderBy("datetime").collect()
    assert whole[5]["scaled_temperature_C"] == pytest.approx(1.46385, abs=1e-5)


def test_selected_table_appends_later_rows(spark):
    schema = ", ".join(f"`{c}` " + ("timestamp_ntz" if c == "datetime" else "double") for c in fe.SELECTED_FEATURES)
    rows = [(h, *[float(i)] * 26) for i, h in enumerate(hours(5))]
    full = frame(spark, rows, schema).withColumn("extra", F.lit(1))
    assert plans.update_selected(full, None).count() == 5
    out = plans.update_selected(full, frame(spark, rows[:3], schema))
    assert out.count() == 5 and tuple(out.columns) == fe.SELECTED_FEATURES


def test_zone_normalisation(spark):
    df = frame(spark, [(dt.datetime(2024, 7, 1, 12),)], "t timestamp_ntz")
    assert df.select(to_utc("t", "Europe/London")).first()[0] == dt.datetime(2024, 7, 1, 11)


def test_nan_counts_as_missing(spark):
    rows = [("a", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), v) for i, v in enumerate([1.0, float("nan"), 3.0, None])]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, v double")
    scaled = [r.scaled_v for r in fe.standard_scale(df, ["v"]).orderBy("ts").collect()]
    assert scaled[1] == scaled[3] == pytest.approx(-1 / 1.5**0.5)
    assert [r.mm_v for r in fe.minmax_scale(df, ["v"]).orderBy("ts").collect()] == [0.0, None, 1.0, None]
    assert [r.log_v for r in fe.log_transforms(df, ["v"]).orderBy("ts").collect()][1] == 0.0
    rolled = fe.rolling_features(df, ["v"], 2, ts="ts").orderBy("ts").collect()
    assert [r.v_rolling_2h_mean for r in rolled] == [None] * 4
    assert {(r.bin, r.n) for r in stats.histogram(df, ["v"], 2).collect()} == {(0, 1), (1, 1)}
    assert exact_quantiles(df, "v", {"p50": 0.5}).first().p50 == 2.0
