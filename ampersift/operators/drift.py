"""Drift between a reference and a current set of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampersift.functions.columns import is_missing, quoted, ratio
from ampersift.functions.pvalues import chi2_pvalue, kolmogorov_exact_pvalue, kolmogorov_pvalue
from ampersift.operators.ordering import prefix_sums
from ampersift.operators.stats import describe_numeric, unpivot

# Default test limits.
P_LIMIT = 0.05
DISTANCE_LIMIT = 0.1
SMALL_SAMPLE = 1000
# Pairs of rows up to which the KS p-value counts orders.
EXACT_CELLS = 10_000
DATASET_SHARE = 0.5


def drift_windows(
    df: DataFrame,
    ts: str = "datetime",
    current_days: int = 7,
    reference_days: int = 30,
    gap_days: int = 1,
) -> DataFrame:
    """Label rows ``current`` or ``reference``; rows in neither window are dropped.

    Current reaches back from the latest timestamp; reference ends a gap before
    it. Both ends are inclusive.
    """
    latest = df.agg(F.max(quoted(ts))).scalar()
    start = latest - F.expr(f"interval {current_days} days")
    t = quoted(ts)
    window = F.when(t >= start, "current").when(
        t.between(
            start - F.expr(f"interval {reference_days} days"), start - F.expr(f"interval {gap_days} days")
        ),
        "reference",
    )
    oldest = start - F.expr(f"interval {reference_days} days")
    return df.filter(t >= oldest).withColumn("window", window).filter(F.col("window").isNotNull())


def comparable(windows: DataFrame) -> bool:
    """False when either window is empty, in which case a report is skipped."""
    return windows.select("window").distinct().count() == 2


def _value_counts(long: DataFrame, side: str, reference: str) -> DataFrame:
    """Reference and current counts per distinct value of each column."""
    is_ref = F.col(side) == reference
    return long.groupBy("column", F.col("value").alias("_v")).agg(
        F.count_if(is_ref).alias("r"), F.count_if(~is_ref).alias("c")
    )


def _chosen(method: str | None, names: tuple[str, str], small: int) -> Column:
    """Whether the first of two tests decides: by name, or by the reference's size."""
    if method not in (None, *names):
        raise ValueError(f"method has to be one of {names}")
    return F.lit(method == names[0]) if method else F.col("n_reference") <= small


def numeric_drift(
    long: DataFrame,
    side: str = "window",
    reference: str = "reference",
    small: int = SMALL_SAMPLE,
    method: str | None = None,
    exact_cells: int = EXACT_CELLS,
) -> DataFrame:
    """KS and normed Wasserstein distance per column of a long (column, value) frame.

    Both come from one ordered pass over the counted distinct values and are
    always returned. ``method`` (ks or wasserstein) decides ``drifted``; without
    one it is KS up to ``small`` reference rows, Wasserstein above. The KS p-value
    is exact up to ``exact_cells`` pairs of rows (ties make it too large, never too
    small), from the limit law above.
    """
    running = prefix_sums(
        _value_counts(long, side, reference), ["_v"], ["r", "c"], by=["column"], previous="_v"
    )
    ref_share = ratio(F.col("cum_r").cast("double"), F.col("all_r"))
    cur_share = ratio(F.col("cum_c").cast("double"), F.col("all_c"))
    ref_before = ratio((F.col("cum_r") - F.col("r")).cast("double"), F.col("all_r"))
    cur_before = ratio((F.col("cum_c") - F.col("c")).cast("double"), F.col("all_c"))
    step = F.coalesce(F.col("_v") - F.col("prev__v"), F.lit(0.0))
    distances = running.groupBy("column").agg(
        F.max("all_r").alias("n_reference"),
        F.max("all_c").alias("n_current"),
        F.max(F.abs(ref_share - cur_share)).alias("ks_statistic"),
        F.sum(F.abs(ref_before - cur_before) * step).alias("_area"),
    )
    spread = (
        long.filter(F.col(side) == reference)
        .groupBy("column")
        .agg(F.stddev_pop("value").alias("_std"))
    )
    n, m = F.col("n_reference").cast("double"), F.col("n_current").cast("double")
    # one row per column on both sides
    out = distances.join(spread, "column", "left").select(
        "column",
        "n_reference",
        "n_current",
        "ks_statistic",
        (F.sqrt(ratio(n * m, n + m)) * F.col("ks_statistic")).alias("_root"),
        (F.col("_area") / F.greatest(F.coalesce("_std", F.lit(0.0)), F.lit(0.001))).alias("wasserstein"),
    )
    # nulls where the other law counts, so that neither is worked out twice
    few = F.col("n_reference") * F.col("n_current") <= exact_cells
    exact = kolmogorov_exact_pvalue(*[F.when(few, F.col(c)) for c in ("n_reference", "n_current", "ks_statistic")])
    limit = kolmogorov_pvalue(F.when(~few, F.col("_root")))
    out = out.withColumn("ks_pvalue", F.coalesce(exact, limit)).drop("_root")
    use_ks = _chosen(method, ("ks", "wasserstein"), small)
    return out.withColumns(
        {
            "method": F.when(use_ks, "ks").otherwise("wasserstein"),
            "drifted": F.when(use_ks, F.col("ks_pvalue") < P_LIMIT).otherwise(
                F.col("wasserstein") >= DISTANCE_LIMIT
            ),
        }
    )


def categorical_drift(
    df: DataFrame,
    column: str,
    side: str = "window",
    reference: str = "reference",
    small: int = SMALL_SAMPLE,
    method: str | None = None,
) -> DataFrame:
    """Chi-square and Jensen-Shannon distance of one category column, one row.

    ``method`` (chisquare or jensenshannon) decides ``drifted``; without one it is
    chi-square up to ``small`` reference rows, Jensen-Shannon above.
    """
    is_ref = F.col(side) == reference
    counts = df.groupBy(quoted(column).alias("_k")).agg(
        F.count_if(is_ref).alias("r"), F.count_if(~is_ref).alias("c")
    )
    totals = counts.agg(F.struct(F.sum("r").alias("r"), F.sum("c").alias("c")).alias("t")).scalar()
    shares = counts.withColumn("_t", totals)
    p = ratio(F.col("r").cast("double"), F.col("_t.r"))
    q = ratio(F.col("c").cast("double"), F.col("_t.c"))
    mid = (p + q) / 2

    def relative(x: Column) -> Column:
        return F.when(x > 0, x * F.ln(x / mid)).otherwise(0.0)

    expected = p * F.col("_t.c")
    out = shares.agg(
        F.max("_t.r").alias("n_reference"),
        F.max("_t.c").alias("n_current"),
        F.count(F.lit(1)).alias("n_levels"),
        F.sum(ratio((F.col("c") - expected) * (F.col("c") - expected), expected)).alias("chi2"),
        F.sqrt(F.greatest(F.sum(relative(p) + relative(q)) / 2, F.lit(0.0))).alias("js_distance"),
    )
    dof = (F.col("n_levels") - 1).cast("double")
    use_chi = _chosen(method, ("chisquare", "jensenshannon"), small)
    out = out.withColumn("chi2_pvalue", chi2_pvalue(F.col("chi2"), dof))
    return out.select(
        F.lit(column).alias("column"),
        "n_reference",
        "n_current",
        "n_levels",
        "chi2",
        "chi2_pvalue",
        "js_distance",
        F.when(use_chi, "chisquare").otherwise("jensenshannon").alias("method"),
        F.when(use_chi, F.col("chi2_pvalue") < P_LIMIT)
        .otherwise(F.col("js_distance") >= DISTANCE_LIMIT)
        .alias("drifted"),
    )


def dataset_drift(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    side: str = "window",
    reference: str = "reference",
    share: float = DATASET_SHARE,
) -> DataFrame:
    """Number and share of drifted columns, one row."""
    parts = numeric_drift(unpivot(df, numeric, keep=[side]), side, reference).select("column", "drifted")
    for c in categorical:
        parts = parts.unionByName(categorical_drift(df, c, side, reference).select("column", "drifted"))
    return parts.agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.count_if(F.col("drifted")).alias("n_drifted"),
        F.avg(F.col("drifted").cast("double")).alias("share_drifted"),
    ).withColumn("dataset_drift", F.col("share_drifted") >= share)


def vector_long(df: DataFrame, vector: str, side: str) -> DataFrame:
    """Vectors as (side, column = dim_i, value) rows."""
    return df.select(side, F.posexplode(quoted(vector)).alias("_i", "_x")).select(
        side, F.concat(F.lit("dim_"), F.col("_i")).alias("column"), F.col("_x").cast("double").alias("value")
    )


def embedding_drift(
    df: DataFrame, vector: str = "embedding", side: str = "half", reference: str = "reference"
) -> DataFrame:
    """Per-dimension drift of vectors, in long form rather than one column each."""
    return numeric_drift(vector_long(df, vector, side), side, reference)


def missing_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing count and share per column."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(columns)],
    )
    items = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col("n"), F.col(f"m{i}").alias("missing"))
            for i, c in enumerate(columns)
        ]
    )
    return row.select(F.inline(items)).withColumn(
        "missing_share", ratio(F.col("missing").cast("double"), F.col("n"))
    )


def data_quality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values beside the descriptive statistics of each column."""
    return missing_values(df, columns).join(describe_numeric(df, columns), "column", "left")


def column_distribution(
    df: DataFrame,
    column: str,
    side: str = "window",
    reference: str = "reference",
    bins: int = 10,
) -> DataFrame:
    """Counts and shares of both sides over the same bin edges."""
    x = quoted(column).cast("double")
    edges = df.agg(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi")).alias("e")).scalar()
    is_ref = F.col(side) == reference
    rows = df.filter(x.isNotNull()).withColumn("_e", edges)
    width = (F.col("_e.hi") - F.col("_e.lo")) / bins
    index = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor(ratio(x - F.col("_e.lo"), width)), F.lit(bins - 1))
    )
    counted = rows.groupBy(index.cast("int").alias("bin")).agg(
        F.count_if(is_ref).alias("n_reference"), F.count_if(~is_ref).alias("n_current")
    )
    totals = counted.agg(
        F.struct(F.sum("n_reference").alias("r"), F.sum("n_current").alias("c")).alias("t")
    ).scalar()
    return counted.withColumn("_t", totals).select(
        "bin",
        "n_reference",
        "n_current",
        ratio(F.col("n_reference").cast("double"), F.col("_t.r")).alias("share_reference"),
        ratio(F.col("n_current").cast("double"), F.col("_t.c")).alias("share_current"),
    )
