"""Joins on time: outer merge, nearest as-of, fills, incremental filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampersift.functions.columns import MICROS_PER_SECOND, is_missing, micros, quoted

# Time that one task of a fill covers.
FILL_DAYS = 32
_NO_TIME = -(1 << 62)


def outer_merge(frames: Sequence[DataFrame], on: Sequence[str] = ("datetime",)) -> DataFrame:
    """Chained full outer joins with one coalesced key."""
    return reduce(lambda a, b: a.join(b, list(on), "full_outer"), frames)


def asof_nearest(
    left: DataFrame,
    right: DataFrame,
    values: Sequence[str],
    ts: str = "datetime",
    by: Sequence[str] = (),
    tolerance_seconds: int = 1800,
    tie: Sequence[str] = (),
    matched_ts: str | None = None,
) -> DataFrame:
    """Left rows with the nearest right row within the tolerance.

    The tolerance is inclusive; of two equally near rows the earlier wins, and
    of right rows sharing a timestamp the one smallest in ``tie``.

    Both sides are first reduced to one row per distinct timestamp and key, then
    merged in time chunks. A right row is copied to at most two chunks, and
    each chunk is scanned once forwards and once backwards, so the work is
    linear and a hot key is spread over its chunks.
    """
    by = list(by)
    reach = tolerance_seconds * MICROS_PER_SECOND
    span = 4 * reach

    def chunk(t):
        return F.floor(t / F.lit(span))

    marks = right.groupBy(*by, ts).agg(
        F.min_by(
            F.struct(F.col(ts).alias("_at"), *[quoted(v) for v in values]),
            F.struct(*[quoted(t) for t in (tie or values)]),
        ).alias("_hit")
    )
    marks = marks.withColumn("_t", micros(ts)).withColumn(
        "_chunk",
        F.explode(F.array_distinct(F.array(chunk(F.col("_t") - reach), chunk(F.col("_t") + reach)))),
    )
    hit_type = marks.schema["_hit"].dataType
    probes = (
        left.select(*by, ts)
        .filter(F.col(ts).isNotNull())
        .distinct()
        .withColumn("_t", micros(ts))
        .withColumn("_chunk", chunk(F.col("_t")))
        .withColumn("_hit", F.lit(None).cast(hit_type))
        .withColumn("_left", F.lit(True))
    )
    lane = Window.partitionBy(*by, "_chunk")
    merged = probes.unionByName(marks.withColumn("_left", F.lit(False)))
    nearest_before = F.last(F.when(~F.col("_left"), F.struct("_t", "_hit")), True).over(lane.orderBy("_t"))
    # Read backwards: a frame that ends at the current row grows, one that
    # starts there would be rescanned for every row.
    nearest_after = F.last(F.when(~F.col("_left"), F.struct("_t", "_hit")), True).over(
        lane.orderBy(F.col("_t").desc())
    )
    scanned = merged.withColumn("_prev", nearest_before).withColumn("_next", nearest_after).filter("_left")
    back = F.col("_t") - F.col("_prev._t")
    ahead = F.col("_next._t") - F.col("_t")
    use_back = (back <= reach) & (ahead.isNull() | (back <= ahead))
    picked = scanned.select(
        *by,
        ts,
        F.when(use_back, F.col("_prev._hit")).when(ahead <= reach, F.col("_next._hit")).alias("_hit"),
    )
    joined = left.join(picked, [*by, ts], "left")
    extra = {v: F.col(f"_hit.`{v}`") for v in values}
    if matched_ts:
        extra[matched_ts] = F.col("_hit._at")
    return joined.withColumns(extra).drop("_hit")


def fill_forward_back(
    df: DataFrame, columns: Sequence[str], ts: str = "datetime", by: Sequence[str] = ()
) -> DataFrame:
    """Fill gaps from the previous known value, then from the next one.

    Rows are filled within time chunks of ``FILL_DAYS`` days; what a chunk lacks
    comes from the first and last known values of the other chunks, a row per
    chunk and series. Rows without a time come before all others.
    """
    at = F.coalesce(micros(quoted(ts)), F.lit(_NO_TIME))
    placed = df.withColumn("_chunk", F.floor(at / F.lit(FILL_DAYS * 86_400 * MICROS_PER_SECOND)))
    values = [F.when(~is_missing(df, c), quoted(c)) for c in columns]
    groups = [f"_b{i}" for i in range(len(by))]

    ends = []
    for i, value in enumerate(values):
        order = F.when(value.isNotNull(), at)
        ends += [F.max_by(value, order).alias(f"_last{i}"), F.min_by(value, order).alias(f"_first{i}")]
    chunks = placed.groupBy(*[quoted(b).alias(g) for b, g in zip(by, groups)], F.col("_chunk").alias("_at")).agg(*ends)
    lane = Window.partitionBy(*groups) if by else Window.partitionBy(F.lit(0))
    earlier = lane.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    later = lane.orderBy(F.col("_at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(
        *groups,
        "_at",
        *[F.last(f"_last{i}", True).over(earlier).alias(f"_before{i}") for i in range(len(values))],
        *[F.last(f"_first{i}", True).over(later).alias(f"_after{i}") for i in range(len(values))],
    )
    same = F.col("_chunk") == F.col("_at")
    for b, g in zip(by, groups):
        same = same & quoted(b).eqNullSafe(F.col(g))
    inside = Window.partitionBy(*[quoted(b) for b in by], "_chunk")
    onward, back = inside.orderBy(quoted(ts)), inside.orderBy(quoted(ts).desc())
    filled = {
        c: F.coalesce(
            F.last(value, True).over(onward), F.col(f"_before{i}"), F.last(value, True).over(back), F.col(f"_after{i}")
        )
        for i, (c, value) in enumerate(zip(columns, values))
    }
    return placed.join(carried, same, "left").withColumns(filled).select(*[quoted(c) for c in df.columns])


def fill_from_side(
    df: DataFrame, side: DataFrame, columns: Sequence[str], ts: str = "datetime", by: Sequence[str] = ()
) -> DataFrame:
    """Left join of a sparse side table, then forward and backward fill."""
    joined = df.join(side.select(*by, ts, *[quoted(c) for c in columns]), [*by, ts], "left")
    return fill_forward_back(joined, columns, ts, by)


def attach_single_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Copy the columns of a one-row frame to every row.

    The row travels as a scalar subquery; more than one row is an error.
    """
    packed = one_row.select(F.struct(*[quoted(c) for c in one_row.columns])).scalar()
    return df.withColumn("_one", packed).withColumns(
        {c: F.col(f"_one.`{c}`") for c in one_row.columns}
    ).drop("_one")


def rows_not_in(new: DataFrame, seen: DataFrame, keys: Sequence[str] = ("datetime",)) -> DataFrame:
    """New rows whose key is not in ``seen``."""
    return new.join(seen.select(*[quoted(k) for k in keys]), list(keys), "left_anti")


def rows_after(new: DataFrame, seen: DataFrame, ts: str = "datetime", by: Sequence[str] = ()) -> DataFrame:
    """New rows later than the latest timestamp of ``seen`` (all, if it is empty).

    With ``by`` every series has a latest timestamp of its own.
    """
    if by:
        known = seen.groupBy(*[quoted(b) for b in by]).agg(F.max(quoted(ts)).alias("_latest"))
        late = F.col("_latest").isNull() | (quoted(ts) > F.col("_latest"))
        return new.join(known, list(by), "left").filter(late).select(*[quoted(c) for c in new.columns])
    latest = seen.agg(F.max(quoted(ts)).alias("m")).scalar()
    return new.filter(latest.isNull() | (quoted(ts) > latest))
