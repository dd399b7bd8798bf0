import math
import random

import numpy as np
import pytest

from ampersift.functions import pvalues as pv
from ampersift.operators import drift, stats


def test_tail_probabilities_against_closed_forms():
    assert pv.student_two_sided(1.0, 1.0) == pytest.approx(0.5)
    assert pv.student_two_sided(2.0, 2.0) == pytest.approx(1 - 2 / math.sqrt(6))
    assert pv.f_upper(3.0, 2.0, 4.0) == pytest.approx((1 + 3.0 * 2 / 4) ** -2)
    assert pv.chi2_upper(5.0, 2.0) == pytest.approx(math.exp(-2.5))
    assert pv.chi2_upper(30.0, 4.0) == pytest.approx(math.exp(-15) * 16)
    assert pv.normal_two_sided(1.959963985) == pytest.approx(0.05)
    assert pv.kolmogorov_upper(1.3580986) == pytest.approx(0.05, abs=1e-6)
    low, high = pv.kolmogorov_upper(0.9999999), pv.kolmogorov_upper(1.0)
    assert low == pytest.approx(high, abs=1e-6)


@pytest.fixture(scope="module")
def log(spark):
    rng = random.Random(3)
    rows = [(v, rng.gauss(m, 1), float(rng.randrange(5)) if rng.random() < 0.5 else None)
            for v, m in (("control", 3.4), ("concise", 2.1), ("detailed", 3.5)) for _ in range(60)]
    rows.append(("lonely", 1.0, 2.0))
    return rows, spark.createDataFrame(rows, "variant_id string, latency double, satisfaction_score double")


def test_pooled_t_and_too_few_values(log):
    rows, df = log
    out = {(r.variant_a, r.variant_b): r for r in stats.pairwise_ttest(df, "variant_id", "latency").collect()}
    a = np.array([x for v, x, _ in rows if v == "concise"])
    b = np.array([x for v, x, _ in rows if v == "control"])
    sp = math.sqrt((59 * a.var(ddof=1) + 59 * b.var(ddof=1)) / 118)
    row = out["concise", "control"]
    assert row.t_statistic == pytest.approx((a.mean() - b.mean()) / (sp * math.sqrt(2 / 60)))
    assert row.significant and row.error is None
    assert out["control", "lonely"].error and out["control", "lonely"].t_statistic is None
    assert len(out) == 6
    flipped = stats.ttest(df, "variant_id", "latency", "control", "concise").first()
    assert flipped.diff == pytest.approx(-row.diff) and flipped.t_statistic == pytest.approx(-row.t_statistic)


def test_anova(log):
    rows, df = log
    groups = [np.array([x for v, x, _ in rows if v == g]) for g in ("control", "concise", "detailed", "lonely")]
    every = np.concatenate(groups)
    ssb = sum(len(g) * (g.mean() - every.mean()) ** 2 for g in groups)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    row = stats.anova(df, "variant_id", "latency").first()
    assert row.f_statistic == pytest.approx((ssb / 3) / (ssw / (len(every) - 4)))


def test_mann_whitney_counts_pairs(log):
    rows, df = log
    out = stats.mann_whitney(df, "variant_id", "satisfaction_score", ["control", "concise", "detailed"])
    for r in out.collect():
        a = [s for v, _, s in rows if v == r.variant_a and s is not None]
        b = [s for v, _, s in rows if v == r.variant_b and s is not None]
        assert r.u_statistic == sum((x > y) + 0.5 * (x == y) for x in a for y in b)
        assert 0 <= r.p_value <= 1


def test_describe_and_skewness(spark):
    values = [1.0, 2.0, 2.0, 3.0, 9.0]
    df = spark.createDataFrame([(v, float("nan") if v == 9 else v) for v in values], "x double, y double")
    row = {r.column: r for r in stats.describe_numeric(df, ["x", "y"]).collect()}
    assert (row["x"].q25, row["x"].q50, row["x"].q75) == (2.0, 2.0, 3.0)
    assert row["y"]["count"] == 4
    n, x = 5, np.array(values)
    m3 = ((x - x.mean()) ** 3).mean() / x.std() ** 3
    assert stats.skewness_rank(df, ["x"]).first().skewness == pytest.approx(m3 * math.sqrt(n * (n - 1)) / (n - 2))


def test_histogram_last_edge_and_constant(spark):
    df = spark.createDataFrame([(float(i), 5.0) for i in range(11)], "x double, c double")
    bins = {(r.column, r.bin): r.n for r in stats.histogram(df, ["x", "c"], 10).collect()}
    assert bins["x", 9] == 2 and bins["x", 0] == 1 and bins["c", 0] == 11


def test_regression_metrics_with_a_zero_target(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 2.0), (4.0, 3.0), (None, 1.0)], "y double, f double")
    row = stats.regression_metrics(df, "y", "f").first()
    assert row.n == 3 and row.mse == pytest.approx(2 / 3) and row.mae == pytest.approx(2 / 3)
    assert row.r2 == pytest.approx(1 - 2 / 8) and math.isinf(row.mape) and row.n_zero_target == 1


def test_daily_summary_needs_three_days(spark):
    import datetime as dt

    rows = [(dt.datetime(2026, 2, 2) + dt.timedelta(hours=i), float((i * 7) % 24)) for i in range(72)]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz, p double")
    out = stats.require_days(stats.daily_price_summary(df, "p")).orderBy("date").collect()
    assert len(out) == 3 and out[0].day_name == "Monday, February 02, 2026" and out[0].low_time == "00:00"
    with pytest.raises(ValueError):
        stats.require_days(stats.daily_price_summary(df.limit(30), "p"))


def test_success_rate_without_success(spark):
    df = spark.createDataFrame([(False, 1.0), (False, None)], "ok boolean, d double")
    row = stats.success_rate(df, df.ok, df.d).first()
    assert row.success_rate == 0.0 and row.avg_duration is None


def test_numeric_drift_matches_brute_force(spark):
    rng = random.Random(9)
    rows = [("reference", round(rng.gauss(0, 1), 1)) for _ in range(300)] + [("current", round(rng.gauss(0.4, 1), 1)) for _ in range(200)]
    df = spark.createDataFrame(rows, "window string, x double")
    row = drift.numeric_drift(stats.unpivot(df, ["x"], ["window"])).first()
    a, b = (np.sort([v for w, v in rows if w == side]) for side in ("reference", "current"))
    grid = np.unique(np.concatenate([a, b]))
    fa, fb = (np.searchsorted(s, grid, side="right") / len(s) for s in (a, b))
    assert row.ks_statistic == pytest.approx(np.abs(fa - fb).max())
    area = (np.abs(fa - fb)[:-1] * np.diff(grid)).sum()
    assert row.wasserstein == pytest.approx(area / a.std())
    assert row.method == "ks" and row.drifted


def test_the_deciding_test_can_be_named(spark):
    df = spark.createDataFrame([(w, float(x)) for w in ("reference", "current") for x in range(5)], "window string, x double")
    long = stats.unpivot(df, ["x"], ["window"])
    for method in ("ks", "wasserstein"):
        row = drift.numeric_drift(long, method=method).first()
        assert (row.method, row.drifted, row.ks_statistic, row.wasserstein) == (method, False, 0.0, 0.0)
    assert drift.categorical_drift(df, "x", method="jensenshannon").first().method == "jensenshannon"
    with pytest.raises(ValueError):
        drift.numeric_drift(long, method="chisquare")


def test_categorical_drift_with_a_new_level(spark):
    rows = [("reference", "a")] * 50 + [("reference", "b")] * 50 + [("current", "a")] * 40 + [("current", "c")] * 10
    df = spark.createDataFrame(rows, "window string, k string")
    row = drift.categorical_drift(df, "k").first()
    p, q = np.array([0.5, 0.5, 0]), np.array([0.8, 0, 0.2])
    m = (p + q) / 2
    kl = lambda x: sum(xi * math.log(xi / mi) for xi, mi in zip(x, m) if xi)
    assert row.js_distance == pytest.approx(math.sqrt((kl(p) + kl(q)) / 2))
    assert row.n_levels == 3


def test_drift_windows_have_a_gap(spark):
    import datetime as dt

    end = dt.datetime(2025, 6, 30)
    rows = [(end - dt.timedelta(days=d),) for d in (0, 7, 7.5, 8, 37, 38)]
    df = spark.createDataFrame(rows, "datetime timestamp_ntz")
    got = drift.drift_windows(df)
    assert {(r.datetime, r.window) for r in got.collect()} == {
        (rows[0][0], "current"), (rows[1][0], "current"), (rows[3][0], "reference"), (rows[4][0], "reference")}
    assert drift.comparable(got) and not drift.comparable(drift.drift_windows(df.limit(1)))


def test_missing_values_and_dataset_share(spark):
    rows = [("reference", float(i), 1.0) for i in range(100)] + [("current", float(i + 90), 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "window string, moved double, same double")
    row = drift.dataset_drift(df, ["moved", "same"]).first()
    assert (row.n_columns, row.n_drifted, row.dataset_drift) == (2, 1, True)
    gaps = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "x double")
    assert drift.missing_values(gaps, ["x"]).first().missing == 2


def test_registered_histogram_covers_every_numeric_column(spark, small_dir):
    import __spark_entry__ as entry

    orders = spark.read.parquet(f"{small_dir}/orders.parquet")
    numeric = {c for c, kind in orders.dtypes if kind in ("bigint", "int", "double", "float") or kind.startswith("decimal")}
    rows = entry.queries()["histogram_columns"](spark, small_dir).collect()
    assert {r["column"] for r in rows} == numeric
    assert all(sum(r["n"] for r in rows if r["column"] == c) == orders.where(f"{c} IS NOT NULL").count() for c in numeric)
