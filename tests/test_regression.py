"""Models from running normal equations against direct solves."""

import numpy as np
import pytest

from ampersift.operators import regression, sequences

FEATURES = ["a", "b", "c"]


def made(spark, seed, hours=1000, offset=0.0, groups=("x", "y")):
    rng = np.random.default_rng(seed)
    rows = []
    for g in groups:
        for i in range(hours):
            a, b, c = (float(v) for v in rng.normal(offset, 2.0, 3))
            rows.append((g, i, a, b, c, 3.0 + 2 * a - b + 0.5 * c + float(rng.normal(0, 0.3))))
    df = spark.createDataFrame(rows, "g string, t long, a double, b double, c double, y double")
    return df, rows


def direct(rows, k, window=168, ridge=0.0):
    train = np.array([r[2:] for r in rows if r[1] // window <= k])
    x, y = train[:, :-1], train[:, -1]
    m, s = x.mean(0), x.std(0)
    z = (x - m) / s
    beta = np.linalg.solve(z.T @ z / len(z) + ridge * np.eye(z.shape[1]), z.T @ (y - y.mean()) / len(z)) / s
    return len(train), y.mean() - beta @ m, beta


@pytest.mark.parametrize(("offset", "ridge"), [(0.0, 0.0), (1e6, 0.0), (5.0, 0.1)])
def test_every_fold_equals_a_direct_solve(spark, offset, ridge):
    df, rows = made(spark, 1, offset=offset)
    placed = sequences.walk_forward_folds(df, "t", ["g"])
    found = regression.walk_forward(placed, FEATURES, "y", ["g"], ridge).collect()
    assert {(r["g"], r["fold"]) for r in found} == {(g, k) for g in "xy" for k in range(4)}
    for r in found:
        own = [x for x in rows if x[0] == r["g"]]
        n, intercept, beta = direct(own, r["fold"], ridge=ridge)
        test = np.array([x[2:] for x in own if x[1] // 168 == r["fold"] + 1])
        gap = test[:, -1] - intercept - test[:, :-1] @ beta
        assert (r["train_rows"], r["test_rows"], r["error"]) == (n, 168, None)
        assert r["slopes"] == pytest.approx(beta.tolist(), rel=1e-6)
        assert r["intercept"] == pytest.approx(intercept, rel=1e-6, abs=1e-6)
        assert r["rmse"] == pytest.approx(np.sqrt((gap**2).mean()), rel=1e-6)
        assert r["mae"] == pytest.approx(np.abs(gap).mean(), rel=1e-6)


def test_features_that_say_nothing_or_the_same(spark):
    df, _ = made(spark, 2, 400, groups=("x",))
    wide = df.selectExpr("*", "2 * a + 1 AS twin", "7D AS flat")
    placed = sequences.walk_forward_folds(wide, "t", ["g"])
    plain = regression.walk_forward(placed, ["a", "b", "c"], "y").first()
    more = regression.walk_forward(placed, ["a", "twin", "b", "c", "flat"], "y").first()
    assert more["slopes"][4] == 0.0 and more["rmse"] == pytest.approx(plain["rmse"], rel=1e-6)
    assert more["slopes"][0] + 2 * more["slopes"][1] == pytest.approx(plain["slopes"][0], rel=1e-6)


def test_gaps_and_missing_values(spark):
    rows = [("x", 0, 0, None, 1.0, 1.0), ("x", 1, None, 0, 2.0, 3.0), ("x", 3, None, 2, 3.0, 5.0)]
    rows += [("x", 0, 0, None, float(i), 2.0 * i + 1) for i in range(5)] + [("x", 0, None, None, None, 9.0), ("y", 1, None, 0, 1.0, 1.0)]
    df = spark.createDataFrame(
        [(g, b, t, a, y) for g, b, _, t, a, y in rows], "g string, block long, test_fold long, a double, y double"
    )
    out = {(r["g"], r["fold"]): r for r in regression.walk_forward(df, ["a"], "y", ["g"]).collect()}
    assert set(out) == {("x", 0), ("x", 2), ("y", 0)}
    # block 2 is missing: fold 2 learns from blocks 0 and 1
    assert out["x", 2]["train_rows"] == out["x", 0]["train_rows"] + 1
    assert out["y", 0]["error"] == "no training rows" and out["y", 0]["rmse"] is None and out["y", 0]["test_rows"] == 0
    assert regression.walk_forward(df.limit(0), ["a"], "y", ["g"]).count() == 0


def test_rows_are_read_once_for_all_folds(spark):
    """The plan of the models holds one aggregation of the rows, however many folds there are."""
    df, _ = made(spark, 3, 2000, groups=("x",))
    placed = sequences.walk_forward_folds(df, "t", ["g"])
    assert regression.fold_models(placed, ["a"], "y", ["g"]).count() == 12
