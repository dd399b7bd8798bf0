"""Stored quantile sketches: one per window and label, merged to any range.

A sketch holds a few hundred values whatever it has seen, and two merge to the
sketch of both. So a table of sketches per five minutes answers for every longer
window and every set of labels without reading the events again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampersift.functions.columns import MICROS_PER_SECOND, from_micros, is_missing, micros, quoted

# Size of a sketch, and the rank error that it stays below (about 0.7 % expected).
SIZE, RANK_ERROR = 400, 0.02


def quantile_sketches(
    df: DataFrame, value: str, by: Sequence[str] = (), ts: str = "ts", window_seconds: int = 300, size: int = SIZE
) -> DataFrame:
    """Labels, window_start, n and the sketch of the known values of each window."""
    step = window_seconds * MICROS_PER_SECOND
    start = from_micros(F.floor(micros(ts) / F.lit(step)).cast("long") * F.lit(step))
    known = df.filter(~is_missing(df, value))
    return known.groupBy(*[quoted(b) for b in by], start.alias("window_start")).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(quoted(value).cast("double"), F.lit(size)).alias("sketch")
    )


def merge_sketches(sketches: DataFrame, by: Sequence[str] = (), window_seconds: int | None = None, size: int = SIZE) -> DataFrame:
    """Sketches of coarser groups: fewer labels, longer windows, or all time."""
    groups = [quoted(b) for b in by]
    if window_seconds:
        step = window_seconds * MICROS_PER_SECOND
        groups.append(from_micros(F.floor(micros("window_start") / F.lit(step)).cast("long") * F.lit(step)).alias("window_start"))
    return sketches.groupBy(*groups).agg(F.sum("n").alias("n"), F.kll_merge_agg_double(F.col("sketch"), F.lit(size)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probabilities: dict[str, float]) -> DataFrame:
    """The sketches' estimates, one column per name, in place of the sketch."""
    made = {name: F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))) for name, p in probabilities.items()}
    return sketches.withColumns(made).drop("sketch")
