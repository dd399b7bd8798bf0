"""Linear models from running normal equations.

The Gram matrix and the moments of every block of rows are summed once. Their
running sums over the blocks are the normal equations of every expanding window,
so that the models of all folds cost one pass over the rows, whatever the number
of folds. Per group and block one row of sums is left; only these are ordered.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampersift.functions.columns import quoted
from ampersift.session import freeze, small_side


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i, n)]


def block_moments(
    rows: DataFrame, features: Sequence[str], target: str, by: Sequence[str], block: str, shift: DataFrame | None = None
) -> DataFrame:
    """Per group and block: n, the upper triangle of the Gram matrix (gram) of
    (features, target) and their sums (sums), of values less those in ``shift``.

    A shift near the means keeps the digits of large values; the models do not
    depend on it.
    """
    columns = [*features, target]
    values: list[Column] = [quoted(c).cast("double") for c in columns]
    if shift is not None:
        held = shift.select(F.struct(*[quoted(c) for c in columns]).alias("s"))
        rows = rows.withColumn("_shift", held.scalar())
        values = [v - F.col(f"_shift.`{c}`") for v, c in zip(values, columns, strict=True)]
    narrow = rows.select(*[quoted(b) for b in by], quoted(block).alias("_block"), *[v.alias(f"_x{i}") for i, v in enumerate(values)])
    x = [F.col(f"_x{i}") for i in range(len(columns))]
    sums = {f"_s{i}": F.sum(c) for i, c in enumerate(x)}
    gram = {f"_g{i}_{j}": F.sum(x[i] * x[j]) for i, j in _pairs(len(x))}
    added = narrow.groupBy(*[quoted(b) for b in by], "_block").agg(
        F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in (sums | gram).items()]
    )
    return added.select(
        *[quoted(b) for b in by], "_block", "n", F.array(*sums).alias("sums"), F.array(*gram).alias("gram")
    )


def running_moments(moments: DataFrame, by: Sequence[str]) -> DataFrame:
    """Moments of all rows up to and including each block; one row a block, so a
    group's rows are bounded by the time it covers."""
    up_to = Window.partitionBy(*([quoted(b) for b in by] or [F.lit(0)])).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    sizes = moments.select(F.size("sums").alias("s"), F.size("gram").alias("g")).first()
    if sizes is None:
        return moments
    added = lambda name, size: F.array(*[F.sum(F.col(name)[i]).over(up_to) for i in range(size)])
    return moments.select(
        *[quoted(b) for b in by],
        "_block",
        F.sum("n").over(up_to).alias("n"),
        added("sums", sizes["s"]).alias("sums"),
        added("gram", sizes["g"]).alias("gram"),
    )


def solve(n: int, sums: np.ndarray, gram: np.ndarray, ridge: float = 0.0) -> tuple[float, np.ndarray]:
    """Intercept and slopes of the least squares line through shifted rows.

    ``ridge`` penalises the slopes of standardised features. Features that say
    the same share their slope: the shortest of all best solutions.
    """
    k = len(sums) - 1
    full = np.zeros((k + 1, k + 1))
    for value, (i, j) in zip(gram, _pairs(k + 1), strict=True):
        full[i, j] = full[j, i] = value
    mean = sums / n
    spread = full / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(spread)[:k], 0))
    live = scale > 1e-12 * np.maximum(1.0, np.abs(mean[:k]))
    slopes = np.zeros(k)
    if live.any():
        s = scale[live]
        matrix = spread[:k, :k][np.ix_(live, live)] / np.outer(s, s) + ridge * np.eye(int(live.sum()))
        slopes[live] = np.linalg.lstsq(matrix, spread[:k, k][live] / s, rcond=1e-10)[0] / s
    return float(mean[k] - slopes @ mean[:k]), slopes


def fold_models(
    rows: DataFrame,
    features: Sequence[str],
    target: str,
    by: Sequence[str] = (),
    block: str = "block",
    ridge: float = 0.0,
) -> DataFrame:
    """The model of every expanding window: group, fold (its last block),
    train_rows, intercept and slopes."""
    columns = [*features, target]
    means = rows.agg(*[F.coalesce(F.avg(quoted(c).cast("double")), F.lit(0.0)).alias(c) for c in columns])
    shift = freeze(means)
    centre = np.array(shift.first(), float)  # one number a column
    running = running_moments(freeze(block_moments(rows, features, target, by, block, shift)), by)
    k = len(features)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                solve(n, np.array(s), np.array(g), ridge)
                for n, s, g in zip(*[batch.column(c).to_pylist() for c in ("n", "sums", "gram")], strict=True)
            ]
            lines = [(a + centre[k] - b @ centre[:k], b) for a, b in found]
            kept = [batch.column(c) for c in [*by, "_block", "n"]]
            new = [pa.array([float(a) for a, _ in lines], pa.float64()), pa.array([b.tolist() for _, b in lines], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=[*by, "fold", "train_rows", "intercept", "slopes"])

    kinds = [f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by]
    schema = ", ".join([*kinds, f"fold {running.schema['_block'].dataType.simpleString()}", "train_rows long, intercept double, slopes array<double>"])
    return running.mapInArrow(fit, schema)


def walk_forward(
    folds: DataFrame,
    features: Sequence[str],
    target: str,
    by: Sequence[str] = (),
    ridge: float = 0.0,
) -> DataFrame:
    """Figures of every fold: group, fold, train_rows, test_rows, rmse, mae,
    intercept, slopes, error.

    ``folds`` carries ``block`` and ``test_fold``. Fold k learns from the blocks 0
    to k and is tested on the rows of ``test_fold`` k. Where the blocks up to k
    have gaps, the last one before k counts. A fold without training rows has no
    figures and says so. Rows that lack a value take no part.
    """
    usable = freeze(folds.na.drop(subset=[*features, target]))
    groups = [quoted(b) for b in by]
    models = fold_models(usable, features, target, by, "block", ridge)
    tests = usable.filter(F.col("test_fold").isNotNull())
    # a row per group and fold, with the newest model not later than the fold
    wanted = tests.select(*groups, F.col("test_fold").alias("fold")).distinct().withColumn("_wanted", F.lit(True))
    model = F.struct("train_rows", "intercept", "slopes")
    lined = wanted.unionByName(models.select(*groups, "fold", model.alias("_model")), allowMissingColumns=True)
    # a model counts for its own fold, so it sorts before the fold that asks
    before = Window.partitionBy(*(groups or [F.lit(0)])).orderBy("fold", F.col("_wanted").asc_nulls_first())
    held = lined.withColumn("_model", F.last("_model", ignorenulls=True).over(before)).filter("_wanted")
    chosen = small_side(held.select(*groups, "fold", "_model.*"))
    scored = tests.withColumn("fold", F.col("test_fold")).join(chosen, [*by, "fold"])
    guess = F.col("intercept")
    for i, f in enumerate(features):
        guess = guess + F.col("slopes")[i] * quoted(f).cast("double")
    gap = quoted(target).cast("double") - guess
    figures = scored.groupBy(*groups, "fold").agg(
        F.count(F.lit(1)).alias("test_rows"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
        F.avg(F.abs(gap)).alias("mae"),
        F.first("train_rows").alias("train_rows"),
        F.first("intercept").alias("intercept"),
        F.first("slopes").alias("slopes"),
    )
    known = F.col("train_rows").isNotNull()
    return figures.select(
        *groups,
        "fold",
        F.coalesce("train_rows", F.lit(0).cast("long")).alias("train_rows"),
        F.when(known, F.col("test_rows")).otherwise(F.lit(0).cast("long")).alias("test_rows"),
        "rmse",
        "mae",
        "intercept",
        "slopes",
        F.when(~known, F.lit("no training rows")).alias("error"),
    )
