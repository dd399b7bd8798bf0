"""Exact small-sample p-values against enumeration and tabulated values."""

import itertools
from fractions import Fraction
from math import comb

import pytest

from ampersift.functions import pvalues
from ampersift.operators import drift, stats


def ks_by_counting(n, m, reach):
    """Share of lattice paths that reach |i m - j n| >= reach, in fractions."""
    inside = {(0, 0): 1}
    for i in range(n + 1):
        for j in range(m + 1):
            if i or j:
                ok = abs(i * m - j * n) < reach
                inside[i, j] = (inside.get((i - 1, j), 0) + inside.get((i, j - 1), 0)) if ok else 0
    return 1 - Fraction(inside[n, m], comb(n + m, n))


@pytest.mark.parametrize(("n", "m"), [(1, 1), (2, 5), (7, 7), (8, 12), (20, 30), (50, 49), (50, 50)])
def test_kolmogorov_equals_path_counts(n, m):
    if reaches := sorted({abs(i * m - j * n) for i in range(n + 1) for j in range(m + 1)} - {0}):
        for reach in reaches[:: max(1, len(reaches) // 12)] + [reaches[-1]]:
            want = float(ks_by_counting(n, m, reach))
            assert pvalues.kolmogorov_exact(n, m, reach / (n * m)) == pytest.approx(want, abs=1e-9, rel=1e-9)


# Tabulated: the least distance (times n, for equal samples) that is significant
# at 5 %, from the usual tables of the two-sample statistic.
@pytest.mark.parametrize(("n", "critical"), [(4, 4), (5, 5), (6, 5), (7, 6), (8, 6), (10, 7), (12, 7), (15, 8), (20, 9), (25, 10), (30, 11)])
def test_kolmogorov_tables(n, critical):
    assert pvalues.kolmogorov_exact(n, n, critical / n) <= 0.05
    assert pvalues.kolmogorov_exact(n, n, (critical - 1) / n) > 0.05


def test_kolmogorov_ends():
    assert pvalues.kolmogorov_exact(5, 7, 0.0) == 1.0 and pvalues.kolmogorov_exact(0, 7, 0.5) == 1.0
    assert pvalues.kolmogorov_exact(40, 40, 1.0) == pytest.approx(2 / comb(80, 40), rel=1e-12)


@pytest.mark.parametrize(("n", "m"), [(n, m) for n in range(1, 9) for m in (1, 4, 8)])
def test_mann_whitney_equals_enumeration(n, m):
    values = []
    for chosen in itertools.combinations(range(n + m), n):
        values.append(sum(chosen) - n * (n - 1) // 2)
    for u in range(n * m + 1):
        low, high = sum(v <= u for v in values), sum(v >= u for v in values)
        assert pvalues.mann_whitney_exact(n, m, u) == pytest.approx(min(1, 2 * min(low, high) / len(values)), abs=1e-12)


def test_groups_with_ties_or_many_values_keep_the_approximation(spark):
    few = [("a", 1.0), ("a", 2.0), ("a", 4.5), ("b", 3.0), ("b", 5.0), ("b", 6.0), ("c", 3.0), ("c", 3.0), ("c", 9.0)]
    many = [("d", i + 0.5) for i in range(60)]
    df = spark.createDataFrame(few + many, "g string, x double")
    out = {(r["variant_a"], r["variant_b"]): r for r in stats.mann_whitney(df, "g", "x", ["a", "b", "c", "d"]).collect()}
    assert out["a", "b"]["p_value"] == pytest.approx(pvalues.mann_whitney_exact(3, 3, 1.0))
    for pair in (("a", "c"), ("a", "d")):
        assert out[pair]["p_value"] == pytest.approx(pvalues.normal_two_sided(out[pair]["z"]))


def test_drift_takes_the_exact_law_for_few_rows(spark):
    rows = [("x", "reference", float(i)) for i in range(12)] + [("x", "current", i + 6.5) for i in range(10)]
    long = spark.createDataFrame(rows, "column string, window string, value double")
    exact = drift.numeric_drift(long).first()
    limit = drift.numeric_drift(long, exact_cells=0).first()
    assert exact["ks_pvalue"] == pytest.approx(float(ks_by_counting(12, 10, round(exact["ks_statistic"] * 120))), abs=1e-9)
    assert exact["ks_statistic"] == limit["ks_statistic"] and exact["ks_pvalue"] != pytest.approx(limit["ks_pvalue"], abs=1e-3)
