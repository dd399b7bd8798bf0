import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ampersift.operators import rollups

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["u", "u", "u", "v"]), T0 + dt.timedelta(seconds=rng.randrange(0, 40_000)), float(i)) for i in range(300)]
    return rows, spark.createDataFrame(rows, "user string, ts timestamp_ntz, value double")


def test_sessions_match_a_scan(events):
    rows, df = events
    got = sorted(tuple(r) for r in rollups.sessions(df, ["user"], 600, "ts", "value").collect())
    want = []
    for user in ("u", "v"):
        current = []
        for t, v in sorted((t, v) for u, t, v in rows if u == user):
            if current and (t - current[-1][0]).total_seconds() >= 600:
                want.append((user, current[0][0], current[-1][0], len(current), sum(x for _, x in current)))
                current = []
            current.append((t, v))
        want.append((user, current[0][0], current[-1][0], len(current), sum(x for _, x in current)))
    assert got == sorted(want)


def test_sliding_rate_counts_every_window(events):
    rows, df = events
    got = {(r.user, r.window_start): r.n for r in rollups.rate_sliding(df, "ts", ["user"], 300, 60).collect()}
    for (user, start), n in got.items():
        end = start + dt.timedelta(seconds=300)
        assert n == sum(u == user and start <= t < end for u, t, _ in rows)
    assert sum(got.values()) == 300 * 5
    with pytest.raises(ValueError):
        rollups.rate_sliding(df, "ts", [], 300, 70)


def test_long_ranges_with_short_steps(events):
    _, df = events
    assert rollups.rate_sliding(df, "ts", [], 7200, 1).agg(F.sum("n")).first()[0] == 300 * 7200


def test_bucket_quantile_interpolates(spark):
    df = spark.createDataFrame([(0.05,)] * 5 + [(0.2,)] * 5 + [(5.0,)] * 0, "x double")
    q = lambda p, d=df: rollups.histogram_quantile(d, "x", p, rollups.TOXICITY_BUCKETS).first()
    assert q(0.5).quantile == pytest.approx(0.1) and q(0.95).quantile == pytest.approx(0.28)
    beyond = spark.createDataFrame([(0.2,), (7.0,)], "x double")
    assert q(0.95, beyond).quantile == 1.0


def test_alert_fires_only_after_holding(spark):
    steady = [("a", T0 + dt.timedelta(seconds=s)) for s in range(0, 1200, 5)]
    burst = [("b", T0 + dt.timedelta(seconds=s)) for s in range(0, 60)]
    df = spark.createDataFrame(steady + burst, "label string, ts timestamp_ntz")
    out = {r.label: r for r in rollups.alert_for_duration(df, 0.15, "ts", ["label"]).collect()}
    assert out["a"].fired and out["a"].firing_from == out["a"].pending_from + dt.timedelta(seconds=300)
    assert not out["b"].fired and out["b"].firing_from is None


def test_gauge_takes_the_latest(spark):
    df = spark.createDataFrame([("a", T0, 1, 5.0), ("a", T0, 2, 6.0)], "k string, ts timestamp_ntz, n int, v double")
    assert rollups.gauge_last(df, "v", ["k"], "ts", ["n"]).first().last_value == 6.0


def test_success_ratio_and_average(spark):
    df = spark.createDataFrame([(T0, True, 1.0), (T0, False, None)], "ts timestamp_ntz, ok boolean, v double")
    assert {r.success_pct for r in rollups.success_ratio_window(df, F.col("ok")).collect()} == {50.0}
    row = rollups.avg_window(df, "v").first()
    assert (row.value_count, row.value_avg) == (1, 1.0)
    assert rollups.counter_by_label(df, ["ok"]).count() == 2


def test_spells_go_on_over_chunks_of_time(spark, monkeypatch):
    monkeypatch.setattr(rollups, "CHUNK_STEPS", 4)
    hot = [*range(3, 17), 20, 21, 23, 24, *range(28, 32)]
    rows = [(label, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=30 * i)) for i in hot for label in "ab"]
    events = spark.createDataFrame(rows, "label string, ts timestamp_ntz")
    for by in ([], ["label"]):
        made = rollups.alert_for_duration(events, 0, "ts", by, 30, 30, 90).collect()
        runs = sorted((r.n_evals, r.fired) for r in made)
        single = [(2, False), (2, False), (4, True), (14, True)]
        assert runs == sorted(single * (2 if by else 1))
        assert all((r.last_true - r.pending_from).seconds == 30 * (r.n_evals - 1) for r in made)


def test_windowed_quantile_and_its_alert(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(minutes=m), s) for m in range(4) for s in ((0.05, 0.95) if m < 3 else (0.05, None))]
    scores = spark.createDataFrame([*rows, (start, float("nan"))], "ts timestamp_ntz, s double")
    made = rollups.histogram_quantile(scores, "s", 0.5, (0.5, 1.0), (), "ts", 60, 60).orderBy("window_start").collect()
    assert [(r.n, r.quantile) for r in made] == [(2, 0.5), (2, 0.5), (2, 0.5), (1, 0.25)]
    spells = rollups.quantile_alert(scores, "s", 0.9, (0.5, 1.0), 0.7, "ts", (), 60, 60, 120).collect()
    assert [(r.n_evals, r.fired, r.peak_quantile) for r in spells] == [(3, True, 0.9)]
