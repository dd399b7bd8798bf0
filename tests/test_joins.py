import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ampersift.operators import joins, upserts
from ampersift.plans import energy as plans

T0 = dt.datetime(2024, 1, 1)

DAY = dt.datetime(2024, 10, 29)


def at(minutes, seconds=0):
    return DAY + dt.timedelta(minutes=minutes, seconds=seconds)


def test_outer_merge_of_shifted_feeds_has_gaps(spark):
    weather = spark.createDataFrame([(at(60 * i), 12.0 + i) for i in range(3)], "datetime timestamp_ntz, t double")
    air = spark.createDataFrame([(at(60 * (i + 1)), 9.0) for i in range(3)], "datetime timestamp_ntz, pm10 double")
    rows = joins.outer_merge([weather, air]).orderBy("datetime").collect()
    assert [(r.t is None, r.pm10 is None) for r in rows] == [(False, True), (False, False), (False, False), (True, False)]


def test_asof_ties_and_tolerance(spark):
    left = spark.createDataFrame([(1, at(600)), (2, at(700)), (3, at(800)), (4, None)], "id int, datetime timestamp_ntz")
    right = spark.createDataFrame(
        [(at(585), 1.0), (at(615), 2.0), (at(730), 3.0), (at(831), 4.0)], "datetime timestamp_ntz, price double"
    )
    out = {r.id: r.price for r in joins.asof_nearest(left, right, ["price"]).collect()}
    assert out == {1: 1.0, 2: 3.0, 3: None, 4: None}


def test_asof_picks_smallest_tie_break_and_exact_match(spark):
    left = spark.createDataFrame([(1, at(10))], "id int, datetime timestamp_ntz")
    right = spark.createDataFrame([(at(10), 5.0, 2), (at(10), 7.0, 1), (at(9), 1.0, 0)], "datetime timestamp_ntz, price double, no int")
    row = joins.asof_nearest(left, right, ["price"], tie=["no"], matched_ts="hit").first()
    assert row.price == 7.0 and row.hit == at(10)


def test_asof_matches_brute_force_with_a_hot_key(spark):
    rng = random.Random(5)
    pick = lambda: "hot" if rng.random() < 0.5 else rng.choice("abc")
    left = [(i, pick(), at(0, rng.randrange(0, 200_000))) for i in range(400)]
    right = [(pick(), at(0, rng.randrange(0, 200_000)), float(i)) for i in range(300)]
    l = spark.createDataFrame(left, "id int, k string, datetime timestamp_ntz")
    r = spark.createDataFrame(right, "k string, datetime timestamp_ntz, v double")
    got = {x.id: x.v for x in joins.asof_nearest(l, r, ["v"], by=["k"]).collect()}
    for i, k, t in left:
        near = [(abs((t - u).total_seconds()), u, v) for kk, u, v in right if kk == k and abs((t - u).total_seconds()) <= 1800]
        assert got[i] == (min(near)[2] if near else None)


def test_fill_forward_then_back(spark):
    df = spark.createDataFrame([(at(i), v) for i, v in enumerate([None, 2.0, None, 4.0, None])], "datetime timestamp_ntz, m double")
    rows = joins.fill_forward_back(df, ["m"]).orderBy("datetime").collect()
    assert [r.m for r in rows] == [2.0, 2.0, 2.0, 4.0, 4.0]


def test_single_row_attach_rejects_two_rows(spark):
    df = spark.range(3)
    one = spark.createDataFrame([(8.0, 45.0)], "`uk_gen_biomass_%` double, gas double")
    assert {tuple(r)[1:] for r in joins.attach_single_row(df, one).collect()} == {(8.0, 45.0)}
    with pytest.raises(Exception):
        joins.attach_single_row(df, one.union(one)).collect()


def test_rows_after_an_empty_table_are_all(spark):
    new = spark.createDataFrame([(at(i),) for i in range(3)], "datetime timestamp_ntz")
    assert joins.rows_after(new, new.limit(0)).count() == 3
    assert joins.rows_after(new, new.filter(F.col("datetime") < at(1))).count() == 2
    assert joins.rows_not_in(new, new.limit(0)).count() == 3


def test_upsert_keeps_the_newer_reading(spark):
    old = spark.createDataFrame([(at(0), 10.0), (at(60), 11.0)], "datetime timestamp_ntz, temperature_C double")
    new = spark.createDataFrame([(at(0), 15.0), (at(60), 16.0)], "datetime timestamp_ntz, temperature_C double")
    rows = plans.append_historical(old, new, "2024-10-30").orderBy("datetime").collect()
    assert [r.temperature_C for r in rows] == [15.0, 16.0]
    assert plans.append_historical(None, new, "2024-10-30").count() == 2
    assert plans.append_historical(old, new, "2024-11-05").orderBy("datetime").first().temperature_C == 10.0


def test_keep_first_and_last_with_three_copies(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, None), ("k", 3, "c")], "key string, n int, v string")
    assert upserts.keep_last(df, ["key"], ["n"]).first().v == "c"
    assert upserts.keep_first(df, ["key"], ["n"]).first().v == "a"
    assert upserts.keep_last(df.filter("n < 3"), ["key"], ["n"]).first().v is None


def test_stack_fills_absent_columns(spark):
    a = spark.createDataFrame([(1, 2)], "x int, y int")
    b = spark.createDataFrame([(3,)], "x int")
    assert [tuple(r) for r in upserts.stack([a, b]).orderBy("x").collect()] == [(1, 2), (3, None)]


def test_feedback_goes_to_the_latest_result_once(spark):
    results = spark.createDataFrame(
        [(1, at(0), "q", "control", None), (2, at(1), "q", "control", 1.0), (3, at(2), "q", "concise", None)],
        "result_id int, timestamp timestamp_ntz, query string, variant_id string, satisfaction_score double",
    )
    feedback = spark.createDataFrame(
        [("q", "control", 3.0, "fine", 1), ("q", "control", 5.0, "great", 2), ("zzz", "control", 1.0, "", 3)],
        "query string, variant_id string, satisfaction_score double, comment string, feedback_no int",
    )
    out = upserts.feedback_upsert(results, feedback, comment="comment")
    assert {r.result_id: (r.satisfaction_score, r.comment) for r in out.collect()} == {1: (None, None), 2: (5.0, "great"), 3: (None, None)}
    assert [r.query for r in upserts.unmatched_feedback(results, feedback).collect()] == ["zzz"]


def test_collect_day_keeps_full_hours_of_the_day(spark):
    weather = spark.createDataFrame([(at(60 * i), 1.0 * i) for i in range(30)], "datetime timestamp_ntz, temperature_C double")
    carbon = spark.createDataFrame([(at(30 * i), i) for i in range(50)], "datetime timestamp_ntz, carbon int")
    air = weather.withColumnRenamed("temperature_C", "pm10")
    prices = spark.createDataFrame([(at(30 * i + 10), i / 100) for i in range(48)], "datetime timestamp_ntz, price double")
    mix = spark.createDataFrame([(45.0,)], "gas double")
    merged = plans.merge_sources(weather, air, carbon, mix, prices, "price")
    day = plans.collect_day(None, merged, "2024-10-30").orderBy("datetime").collect()
    assert len(day) == 24 and all(r.datetime.minute == 0 and r.gas == 45.0 for r in day)
    assert day[1].price == 0.02


def test_fill_reaches_over_chunks(spark):
    day = [0, 1, 40, 41, 200, 201, 400]
    value = [None, 1.0, None, float("nan"), None, 7.0, None]
    rows = [(s, T0 + dt.timedelta(days=d), v) for s in ("a", None) for d, v in zip(day, value)]
    df = spark.createDataFrame([*rows, ("b", T0, None)], "s string, ts timestamp_ntz, v double")
    out = joins.fill_forward_back(df, ["v"], "ts", ["s"]).orderBy("ts").collect()
    wanted = [1.0, 1.0, 1.0, 1.0, 1.0, 7.0, 7.0]
    assert [r.v for r in out if r.s == "a"] == wanted and [r.v for r in out if r.s is None] == wanted
    assert [r.v for r in out if r.s == "b"] == [None]
    alone = joins.fill_forward_back(df.filter("s = 'a'"), ["v"], "ts").orderBy("ts").collect()
    assert [r.v for r in alone] == wanted


def test_rows_after_the_latest_of_their_series(spark):
    at = lambda h: T0 + dt.timedelta(hours=h)
    seen = spark.createDataFrame([("a", at(5)), ("b", at(1))], "s string, datetime timestamp_ntz")
    new = spark.createDataFrame([("a", at(5)), ("a", at(6)), ("b", at(2)), ("c", at(0))], "s string, datetime timestamp_ntz")
    got = {(r.s, r.datetime) for r in joins.rows_after(new, seen, by=["s"]).collect()}
    assert got == {("a", at(6)), ("b", at(2)), ("c", at(0))}
