"""Merged quantile sketches against exact ranks."""

import datetime as dt

import numpy as np
import pytest

from ampersift.operators import sketches

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(1)
    rows = [("ab"[i % 2], T0 + dt.timedelta(seconds=7 * i), float(x)) for i, x in enumerate(rng.lognormal(0, 1, 20_000))]
    rows += [("a", T0, None), ("b", T0, float("nan")), ("c", T0, 5.0)]
    return spark.createDataFrame(rows, "label string, ts timestamp_ntz, x double"), rows


def share(values, limit):
    return np.mean(np.array(values) <= limit)


def test_merged_ranks_stay_within_the_bound(spark, events, out_dir):
    df, rows = events
    sketches.quantile_sketches(df, "x", ["label"]).write.parquet(out_dir)
    stored = spark.read.parquet(out_dir)
    assert stored.filter("label = 'a'").count() == len({r[1].timestamp() // 300 for r in rows if r[0] == "a"})
    made = sketches.sketch_quantiles(sketches.merge_sketches(stored, ["label"]), {"p10": 0.1, "p50": 0.5, "p99": 0.99})
    out = {r["label"]: r for r in made.collect()}
    for label in "ab":
        own = [r[2] for r in rows if r[0] == label and r[2] is not None and r[2] == r[2]]
        assert out[label]["n"] == len(own)
        for name, p in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
            assert abs(share(own, out[label][name]) - p) <= sketches.RANK_ERROR
    assert (out["c"]["n"], out["c"]["p50"]) == (1, 5.0)


def test_longer_windows_and_no_labels(spark, events):
    df, rows = events
    stored = sketches.quantile_sketches(df, "x", ["label"])
    hours = sketches.sketch_quantiles(sketches.merge_sketches(stored, window_seconds=3600), {"p50": 0.5}).collect()
    assert sum(r["n"] for r in hours) == 20_001 and all(r["window_start"].minute == 0 for r in hours)
    first = [r[2] for r in rows if r[1] < T0 + dt.timedelta(hours=1) and r[2] is not None and r[2] == r[2]]
    (hour,) = [r for r in hours if r["window_start"] == T0]
    assert hour["n"] == len(first) and abs(share(first, hour["p50"]) - 0.5) <= sketches.RANK_ERROR


def test_empty_table(spark, events):
    made = sketches.merge_sketches(sketches.quantile_sketches(events[0].limit(0), "x", ["label"]), ["label"])
    assert sketches.sketch_quantiles(made, {"p50": 0.5}).count() == 0
