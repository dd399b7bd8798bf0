"""Summary statistics and significance tests from grouped moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampersift.functions.columns import known, quoted, ratio
from ampersift.functions.pvalues import f_pvalue, mann_whitney_exact_pvalue, normal_pvalue, t_pvalue
from ampersift.operators.ordering import exact_quantiles, prefix_sums
from ampersift.operators.upserts import first_n

# Values of a group up to which Mann-Whitney orders are counted.
EXACT_GROUP = 50


def moments(df: DataFrame, group: str, metric: str) -> DataFrame:
    """n, mean, sample and population variance of the known values per group."""
    x = quoted(metric).cast("double")
    return (
        df.filter(x.isNotNull())
        .groupBy(quoted(group).alias("g"))
        .agg(
            F.count(x).alias("n"),
            F.avg(x).alias("mean"),
            F.var_samp(x).alias("var"),
            F.var_pop(x).alias("var_pop"),
        )
    )


def _pairs(stats: DataFrame) -> DataFrame:
    """Each unordered pair of groups once, from one row of figures per group.

    Every group is sent to its pairs and the two sides meet in a grouping, so no
    row is compared with all others.
    """
    figures = [c for c in stats.columns if c != "g"]
    everyone = stats.agg(F.sort_array(F.collect_set("g"))).scalar()
    sent = stats.withColumn("_other", F.explode(everyone)).filter(F.col("_other") != F.col("g"))
    side = F.struct(*figures)
    met = sent.groupBy(F.least("g", "_other").alias("g_a"), F.greatest("g", "_other").alias("g_b")).agg(
        F.max(F.when(F.col("g") < F.col("_other"), side)).alias("_a"),
        F.max(F.when(F.col("g") > F.col("_other"), side)).alias("_b"),
    )
    return met.select(
        "g_a",
        "g_b",
        *[F.col(f"_a.{c}").alias(f"{c}_a") for c in figures],
        *[F.col(f"_b.{c}").alias(f"{c}_b") for c in figures],
    )


def pairwise_ttest(df: DataFrame, group: str, metric: str, min_n: int = 2) -> DataFrame:
    """Pooled two-sample t-test for every pair of groups.

    Pairs with fewer than ``min_n`` values on a side carry an ``error`` and no
    statistic.
    """
    p = _pairs(moments(df, group, metric))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    dof = (n_a + n_b - 2).cast("double")
    pooled = ratio((n_a - 1) * F.col("var_a") + (n_b - 1) * F.col("var_b"), dof)
    spread = F.sqrt(pooled * (F.lit(1.0) / n_a + F.lit(1.0) / n_b))
    enough = (n_a >= min_n) & (n_b >= min_n)
    diff = F.col("mean_a") - F.col("mean_b")
    out = p.select(
        F.col("g_a").alias("variant_a"),
        F.col("g_b").alias("variant_b"),
        n_a,
        n_b,
        F.col("mean_a"),
        F.col("mean_b"),
        diff.alias("diff"),
        (ratio(diff, F.col("mean_a")) * 100).alias("diff_pct"),
        F.when(enough, ratio(diff, spread)).alias("t_statistic"),
        F.when(enough, dof).alias("dof"),
        F.when(~enough, F.lit("Insufficient data for t-test")).alias("error"),
    )
    return _judged(out, t_pvalue(F.col("t_statistic"), F.col("dof")))


def _judged(df: DataFrame, p: Column, level: float = 0.05) -> DataFrame:
    return df.withColumn("p_value", p).withColumn("significant", F.col("p_value") < level)


def ttest(df: DataFrame, group: str, metric: str, a: str, b: str) -> DataFrame:
    """The pooled t-test of one pair, with ``a`` first."""
    one = pairwise_ttest(df.filter(quoted(group).isin(a, b)), group, metric)
    if a < b:
        return one
    return one.select(
        F.col("variant_b").alias("variant_a"),
        F.col("variant_a").alias("variant_b"),
        F.col("n_b").alias("n_a"),
        F.col("n_a").alias("n_b"),
        F.col("mean_b").alias("mean_a"),
        F.col("mean_a").alias("mean_b"),
        (-F.col("diff")).alias("diff"),
        (ratio(-F.col("diff"), F.col("mean_b")) * 100).alias("diff_pct"),
        (-F.col("t_statistic")).alias("t_statistic"),
        "dof",
        "error",
        "p_value",
        "significant",
    )


def anova(df: DataFrame, group: str, metric: str) -> DataFrame:
    """One-way analysis of variance over all groups."""
    m = moments(df, group, metric)
    grand = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    total = m.agg(
        F.count(F.lit(1)).alias("k"),
        F.sum("n").alias("n"),
        grand.alias("grand_mean"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("sq_mean"),
        F.sum(F.col("n") * F.col("var_pop")).alias("ssw"),
    )
    ssb = F.col("sq_mean") - F.col("n") * F.col("grand_mean") * F.col("grand_mean")
    out = total.select(
        "k",
        "n",
        (F.col("k") - 1).cast("double").alias("df_between"),
        (F.col("n") - F.col("k")).cast("double").alias("df_within"),
        ssb.alias("ssb"),
        "ssw",
    ).withColumn(
        "f_statistic",
        ratio(ratio(F.col("ssb"), F.col("df_between")), ratio(F.col("ssw"), F.col("df_within"))),
    )
    return _judged(out, f_pvalue(F.col("f_statistic"), F.col("df_between"), F.col("df_within")))


def effect_sizes(df: DataFrame, group: str, metric: str) -> DataFrame:
    """Cohen's d (population deviations) and Welch's t for every pair."""
    p = _pairs(moments(df, group, metric))
    diff = F.col("mean_a") - F.col("mean_b")
    pooled = F.sqrt((F.col("var_pop_a") + F.col("var_pop_b")) / 2)
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    dof = ratio(
        (va + vb) * (va + vb),
        ratio(va * va, F.col("n_a") - 1) + ratio(vb * vb, F.col("n_b") - 1),
    )
    out = p.select(
        F.col("g_a").alias("variant_a"),
        F.col("g_b").alias("variant_b"),
        ratio(diff, pooled).alias("cohens_d"),
        ratio(diff, F.sqrt(va + vb)).alias("welch_t"),
        dof.alias("welch_dof"),
    )
    return _judged(out, t_pvalue(F.col("welch_t"), F.col("welch_dof")))


def mann_whitney(df: DataFrame, group: str, metric: str, groups: Sequence[str]) -> DataFrame:
    """Mann-Whitney U for every pair of ``groups``. Two groups of ``EXACT_GROUP``
    values at most without ties have the exact p-value, others that of the
    tie-corrected normal approximation (continuity-corrected).

    Values are counted per group first; one ordered pass of running counts then
    gives all pairs: U_a sums, over the distinct values, the a-count times the
    b-values below plus half of those equal.
    """
    x = quoted(metric)
    counts = (
        df.filter(x.isNotNull() & quoted(group).isin(*groups))
        .groupBy(x.alias("_v"))
        .agg(*[F.count_if(quoted(group) == g).alias(f"c{i}") for i, g in enumerate(groups)])
    )
    columns = [f"c{i}" for i in range(len(groups))]
    running = prefix_sums(counts, ["_v"], columns)

    def pair(i: int, j: int) -> Column:
        a, b = F.col(f"c{i}").cast("double"), F.col(f"c{j}").cast("double")
        below = F.col(f"cum_c{j}") - F.col(f"c{j}")
        ties = a + b
        return F.struct(
            F.lit(groups[i]).alias("variant_a"),
            F.lit(groups[j]).alias("variant_b"),
            F.sum("c%d" % i).alias("n_a"),
            F.sum("c%d" % j).alias("n_b"),
            F.sum(a * (below + b / 2)).alias("u_statistic"),
            F.sum(ties * ties * ties - ties).alias("_ties"),
        )

    names = sorted(range(len(groups)), key=lambda i: groups[i])
    pairs = [pair(i, j) for k, i in enumerate(names) for j in names[k + 1 :]]
    one = running.agg(F.array(*pairs).alias("_p")).select(F.inline("_p"))
    n_a, n_b = F.col("n_a").cast("double"), F.col("n_b").cast("double")
    n = n_a + n_b
    spread = F.sqrt(n_a * n_b / 12 * ((n + 1) - ratio(F.col("_ties"), n * (n - 1))))
    gap = F.abs(F.col("u_statistic") - n_a * n_b / 2)
    few = (F.col("_ties") == 0) & (F.greatest("n_a", "n_b") <= EXACT_GROUP)
    exact = mann_whitney_exact_pvalue(*[F.when(few, F.col(c)) for c in ("n_a", "n_b", "u_statistic")])
    out = one.withColumn("z", ratio(F.greatest(gap - 0.5, F.lit(0.0)), spread)).withColumn("_exact", exact)
    return _judged(out, F.coalesce("_exact", normal_pvalue(F.col("z")))).drop("_ties", "_exact")


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column, exact quartiles."""
    long = unpivot(df, columns)
    basic = long.groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by=["column"])
    return basic.join(quartiles, "column", "left")


def unpivot(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long form (column, value) of numeric columns, missing values dropped."""
    items = F.array(
        *[F.struct(F.lit(c).alias("column"), quoted(c).cast("double").alias("value")) for c in columns]
    )
    return df.select(*keep, F.inline(items)).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def skewness_rank(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bias-corrected skewness per column, largest first."""
    moments_row = df.agg(
        *[F.count(known(quoted(c))).alias(f"n_{i}") for i, c in enumerate(columns)],
        *[F.skewness(known(quoted(c))).alias(f"g_{i}") for i, c in enumerate(columns)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.col(f"n_{i}").alias("n"), F.col(f"g_{i}").alias("g")
            )
            for i, c in enumerate(columns)
        ]
    )
    n = F.col("n").cast("double")
    corrected = F.when(n > 2, F.col("g") * F.sqrt(n * (n - 1)) / (n - 2))
    return (
        moments_row.select(F.inline(rows))
        .select("column", corrected.alias("skewness"))
        .orderBy(F.col("skewness").desc())
    )


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 30) -> DataFrame:
    """Counts of equal-width bins between each column's extremes.

    The last bin includes its upper edge.
    """
    edges = df.agg(
        F.struct(
            *[F.min(known(quoted(c))).alias(f"lo{i}") for i, c in enumerate(columns)],
            *[F.max(known(quoted(c))).alias(f"hi{i}") for i, c in enumerate(columns)],
        ).alias("e")
    ).scalar()
    items = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                known(quoted(c)).alias("value"),
                F.col(f"_e.lo{i}").alias("lo"),
                F.col(f"_e.hi{i}").alias("hi"),
            )
            for i, c in enumerate(columns)
        ]
    )
    return _binned(
        df.withColumn("_e", edges).select(F.inline(items)).filter(F.col("value").isNotNull()), bins, []
    )


def _binned(long: DataFrame, bins: int, by: Sequence[str]) -> DataFrame:
    width = (F.col("hi") - F.col("lo")) / bins
    index = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor(ratio(F.col("value") - F.col("lo"), width)), F.lit(bins - 1))
    )
    return long.withColumn("bin", index.cast("int")).groupBy("column", "bin", *by).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.col("lo") + F.col("bin") * width).alias("bin_start"),
    )


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MSE, RMSE, MAE, R², MAPE over pairs with both sides known.

    MAPE is infinite when a target is zero; ``n_zero_target`` tells why.
    """
    y, f = known(quoted(actual)), known(quoted(predicted))
    err = y - f
    pairs = df.filter(y.isNotNull() & f.isNotNull())
    stats = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        (F.var_pop(y)).alias("_var"),
        F.avg(F.when(y != 0, F.abs(ratio(err, y)))).alias("_mape"),
        F.count_if(y == 0).alias("n_zero_target"),
    )
    return stats.withColumns(
        {
            "rmse": F.sqrt("mse"),
            "r2": F.lit(1.0) - ratio(F.col("mse"), F.col("_var")),
            "mape": F.when(F.col("n_zero_target") > 0, F.lit(float("inf"))).otherwise(F.col("_mape")),
        }
    ).drop("_var", "_mape")


def best_by(df: DataFrame, name: str, metric: str) -> DataFrame:
    """The row name with the smallest metric; equal metrics go to the first name."""
    return df.agg(
        F.min_by(F.col(name), F.struct(F.col(metric), F.col(name))).alias(f"best_{name}"),
        F.min(metric).alias(metric),
    )


def daily_price_summary(
    df: DataFrame, price: str, ts: str = "datetime", series: Sequence[str] = (), days: int = 3
) -> DataFrame:
    """Mean, peak, low and total per day for the first ``days`` dates.

    Peak and low times are the earliest on ties.
    """
    by = [quoted(s) for s in series]
    p, t = quoted(price), quoted(ts)
    daily = (
        df.withColumn("date", F.to_date(t))
        .groupBy(*by, "date")
        .agg(
            F.avg(p).alias("avg_price"),
            F.max(p).alias("peak_price"),
            F.min_by(t, F.struct(-p, t)).alias("_peak"),
            F.min(p).alias("low_price"),
            F.min_by(t, F.struct(p, t)).alias("_low"),
            F.sum(p).alias("total_price"),
        )
    )
    kept = first_n(daily, days, list(series), ["date"]) if series else daily.orderBy("date").limit(days)
    return kept.select(
        *by,
        F.date_format("date", "yyyy-MM-dd").alias("date"),
        F.date_format("date", "EEEE, MMMM dd, yyyy").alias("day_name"),
        "avg_price",
        "peak_price",
        F.date_format("_peak", "HH:mm").alias("peak_time"),
        "low_price",
        F.date_format("_low", "HH:mm").alias("low_time"),
        "total_price",
    )


def require_days(summary: DataFrame, days: int = 3) -> DataFrame:
    """Fail unless the forecast covers ``days`` dates."""
    if summary.select("date").distinct().count() < days:
        raise ValueError(f"Not enough data for {days} days")
    return summary


def success_rate(df: DataFrame, ok: Column, duration: Column, by: Sequence[str] = ()) -> DataFrame:
    """Share of successes (2 dp) and mean duration of the successes (3 dp)."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.bround(F.avg(ok.cast("double")), 2).alias("success_rate"),
        F.bround(F.avg(F.when(ok, duration)), 3).alias("avg_duration"),
    )


def latency_percentiles(
    df: DataFrame,
    value: str,
    by: Sequence[str] = (),
    points: Sequence[int] = (50, 95, 99),
    approximate: bool = False,
    accuracy: int = 10000,
) -> DataFrame:
    """P50/P95/P99 per group: exact by default, or from a bounded sketch."""
    wanted = {f"p{p}": p / 100 for p in points}
    if not approximate:
        return exact_quantiles(df, value, wanted, by)
    sketched = df.groupBy(*by).agg(
        F.percentile_approx(quoted(value), list(wanted.values()), accuracy).alias("_q")
    )
    return sketched.select(*by, *[F.col("_q")[i].alias(n) for i, n in enumerate(wanted)])


def category_crosstab(df: DataFrame, row: str, column: str, levels: Sequence[str]) -> DataFrame:
    """Share of each level within a row category; one column per listed level."""
    return df.groupBy(row).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.avg((quoted(column) == v).cast("double")).alias(f"share_{v}") for v in levels],
    )


def detector_rates(df: DataFrame, flagged: Column, truth: Column, by: Sequence[str] = ()) -> DataFrame:
    """Confusion counts of a detector against labels, with accuracy and rates."""
    f, t = flagged, truth
    counted = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(f & t).alias("tp"),
        F.count_if(f & ~t).alias("fp"),
        F.count_if(~f & t).alias("fn"),
        F.count_if(~f & ~t).alias("tn"),
    )
    return counted.withColumns(
        {
            "accuracy": ratio((F.col("tp") + F.col("tn")).cast("double"), F.col("total")),
            "detection_rate": ratio(F.col("tp").cast("double"), F.col("tp") + F.col("fn")),
            "false_positive_rate": ratio(F.col("fp").cast("double"), F.col("fp") + F.col("tn")),
        }
    )


def distinct_keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[quoted(c) for c in columns]).distinct()
