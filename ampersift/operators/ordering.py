"""Global order without a single-task window.

Ranks and running sums over a whole table are built from a range partitioning
of the (unique) order key, so no key, however hot, ends up in one task. The
partitioning is checkpointed first: slice numbers must be the same in every
branch that uses them, and Spark samples range bounds anew each time it plans
the exchange.

Quantiles and splits need the rows at a few ranks only. Those are selected: a
sketch brackets them, one more pass counts, and rows are never sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampersift.functions.columns import all_of, any_of, is_missing, micros
from ampersift.session import freeze, small_side

SKETCH_ACCURACY = 1000  # a rank error of at most a thousandth of the group
_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row's place in the low 33 bits


def order_globally(df: DataFrame, *order: str | Column) -> DataFrame:
    """Rows in one global order, each with its slice and place in the slice.

    ``order`` has to be unique per row, or range slices can grow as large as
    the biggest group of equal keys.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_address", F.monotonically_increasing_id())
    )
    address = F.col("_address")
    return (
        freeze(placed)
        .withColumn("_slice", F.shiftright(address, _LOCAL_BITS))
        .withColumn("_place", address.bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1)))
        .drop("_address")
    )


def _attach(rows: DataFrame, spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join per-slice figures back to the rows."""
    keys = [*by, "_slice"]
    right = spans.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    if by:
        right = small_side(right)
        match = all_of([F.col(f"`{k}`").eqNullSafe(F.col(f"`_r_{k}`")) for k in keys])
    else:
        # one row per slice of the exchange, so the build side is as small as the partition count
        right = F.broadcast(right)
        match = F.col("_slice") == F.col("_r__slice")
    return rows.join(right, match, "inner").drop(*[f"_r_{k}" for k in keys])


def _group(by: Sequence[str]) -> list[Column]:
    return [F.col(f"`{b}`") for b in by] or [F.lit(0)]


def row_numbers(
    df: DataFrame,
    order: Sequence[str | Column],
    by: Sequence[str] = (),
    name: str = "row_no",
    total: str | None = None,
) -> DataFrame:
    """1-based row number in ``order`` within ``by``; optionally the group size."""
    placed = order_globally(df, *by, *order)
    spans = placed.groupBy(*by, "_slice").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first")
    )
    earlier = Window.partitionBy(*_group(by)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    if total:
        spans = spans.withColumn(total, F.sum("_n").over(Window.partitionBy(*_group(by))))
    numbered = _attach(placed, spans.drop("_n"), by)
    return numbered.withColumn(name, F.col("_before") + F.col("_place") - F.col("_first") + 1).drop(
        "_before", "_first", "_slice", "_place"
    )


def _sums_in_slices(
    placed: DataFrame, sums: Sequence[str], by: Sequence[str], previous: str | None
) -> DataFrame:
    """Running sums ``_l_<c>`` and the previous value ``_near`` within each slice.

    A slice is one stored, sorted partition, so one pass over its batches is
    enough; a window would shuffle and sort all rows once more.
    """
    wide = placed.withColumns({f"_l_{c}": F.col(c) for c in sums})
    if previous:
        wide = wide.withColumn("_near", F.col(previous))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, carried, before = None, dict.fromkeys(sums, 0), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = np.zeros(n, dtype=bool)
            for b in by:
                codes = batch.column(b).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                fresh[1:] |= codes[1:] != codes[:-1]
            opening = tuple(batch.column(b)[0].as_py() for b in by)
            fresh[0] = group is None or opening != group
            starts = np.flatnonzero(fresh)
            run = np.cumsum(fresh) - 1
            columns = {name: batch.column(name) for name in batch.schema.names}
            for c in sums:
                values = batch.column(c).to_numpy(zero_copy_only=False)
                total = np.cumsum(values) + (0 if fresh[0] else carried[c])
                base = np.where(run >= 0, (total - values)[starts][run], 0) if len(starts) else 0
                total = total - base
                carried[c] = total[-1]
                columns[f"_l_{c}"] = pa.array(total, columns[f"_l_{c}"].type)
            if previous:
                own = batch.column(previous)
                shifted = pa.concat_arrays([pa.array([before], own.type), own.slice(0, n - 1)])
                columns["_near"] = pc.if_else(pa.array(fresh), pa.scalar(None, own.type), shifted)
                before = own[n - 1].as_py()
            group = tuple(batch.column(b)[n - 1].as_py() for b in by)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return wide.mapInArrow(scan, wide.schema)


def prefix_sums(
    df: DataFrame,
    order: Sequence[str],
    sums: Sequence[str],
    by: Sequence[str] = (),
    previous: str | None = None,
) -> DataFrame:
    """Running sums ``cum_<c>`` (current row included) and totals ``all_<c>``.

    ``previous`` adds ``prev_<c>``, that column's value on the row before.
    Meant for rows already grouped to one per order key; the summed columns are
    whole or floating numbers without gaps.
    """
    placed = order_globally(df, *by, *order)
    figures = [F.sum(c).alias(f"_s_{c}") for c in sums]
    if previous:
        figures.append(F.max_by(previous, "_place").alias("_final"))
    spans = placed.groupBy(*by, "_slice").agg(*figures)
    group = Window.partitionBy(*_group(by))
    earlier = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns(
        {f"_b_{c}": F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)) for c in sums}
        | {f"all_{c}": F.sum(f"_s_{c}").over(group) for c in sums}
    ).drop(*[f"_s_{c}" for c in sums])
    local = _sums_in_slices(placed, sums, by, previous)
    if previous:
        spans = spans.withColumn("_far", F.lag("_final").over(group.orderBy("_slice"))).drop("_final")
    summed = _attach(local, spans, by).withColumns(
        {f"cum_{c}": F.col(f"_l_{c}") + F.col(f"_b_{c}") for c in sums}
    )
    if previous:
        summed = summed.withColumn(f"prev_{previous}", F.coalesce("_near", "_far")).drop("_near", "_far")
    return summed.drop("_slice", "_place", *[f"_l_{c}" for c in sums], *[f"_b_{c}" for c in sums])


def _join_group(rows: DataFrame, figures: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Give every row its group's figures as one struct column ``name``.

    Without groups the one row travels as a scalar subquery. Otherwise the side
    joined holds a row per group; if there are too many groups to broadcast, a
    hot one is split by the skew join.
    """
    packed = F.struct(*[c for c in figures.columns if c not in by]).alias(name)
    if not by:
        return rows.withColumn(name, figures.select(packed).scalar())
    right = small_side(figures.select(*[F.col(f"`{b}`").alias(f"_g_{b}") for b in by], packed))
    match = all_of([F.col(f"`{b}`").eqNullSafe(F.col(f"`_g_{b}`")) for b in by])
    return rows.join(right, match, "left").drop(*[f"_g_{b}" for b in by])


def _condensed(values: DataFrame, shares: Sequence[float], by: Sequence[str]) -> DataFrame:
    """Counts per distinct value near the wanted shares, and per gap elsewhere.

    A sketch with a known rank error brackets each share. Values inside a
    bracket are kept apart, all others of one gap are a single cell, so what is
    shuffled is a small part of the rows.
    """
    slack = 2.0 / SKETCH_ACCURACY
    bounds = [b for p in shares for b in (max(p - slack, 0.0), min(p + slack, 1.0))]
    sketch = values.groupBy(*by).agg(F.percentile_approx("_v", bounds, SKETCH_ACCURACY).alias("q"))
    bracketed = _join_group(values, sketch, by, "_s")
    v = F.col("_v")
    gap, near = F.lit(0), F.lit(False)
    for i, p in enumerate(shares):
        low, high = F.col("_s.q")[2 * i], F.col("_s.q")[2 * i + 1]
        # an end bracket reaches to the extreme value
        above = F.lit(True) if p - slack <= 0 else v >= low
        beyond = F.lit(False) if p + slack >= 1 else v > high
        gap = gap + above.cast("int") + beyond.cast("int")
        near = near | (above & ~beyond)
    return (
        bracketed.groupBy(*by, gap.alias("_gap"), F.when(near, v).alias("_near"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(v).alias("_v"), F.max(v).alias("_top"))
        .drop("_gap", "_near")
    )


def select_ranks(
    df: DataFrame,
    value: str | Column,
    wanted: dict[str, tuple[float, Callable[[Column], Column]]],
    by: Sequence[str] = (),
) -> DataFrame:
    """The value at given 0-based ranks of every group, without sorting the rows.

    ``wanted`` maps a name to its share of the group and to the rank as a
    function of the group size. Per name the result has the ``value`` there and
    the number of rows ``below`` it and ``equal`` to it; ``size`` is the group
    size. Should a sketch miss a bracket, all values are counted instead.
    """
    v = F.col(f"`{value}`") if isinstance(value, str) else value
    values = df.select(*by, v.alias("_v")).filter(F.col("_v").isNotNull())
    shares = sorted({p for p, _ in wanted.values()})

    def pick(cells: DataFrame) -> DataFrame:
        ranked = prefix_sums(cells, ["_v"], ["n"], by)
        before = F.col("cum_n") - F.col("n")
        figures = [F.max("all_n").alias("size")]
        for name, (_, rank_of) in wanted.items():
            rank = rank_of(F.col("all_n"))
            here = (before <= rank) & (rank < F.col("cum_n"))
            figures += [
                F.max(F.when(here, F.struct(F.col("_v").alias("value"), before.alias("below"), F.col("n").alias("equal")))).alias(name),
                F.max(F.when(here, F.col("_v") != F.col("_top"))).alias(f"_wide_{name}"),
            ]
        # a row per group, read by the check and by every later use
        return freeze(ranked.groupBy(*by).agg(*figures))

    picked = pick(_condensed(values, shares, by))
    wide = any_of([F.coalesce(F.col(f"_wide_{n}"), F.lit(False)) for n in wanted])
    if not picked.filter(wide).isEmpty():
        every = values.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("n"))
        picked = pick(every.withColumn("_top", F.col("_v")))
    return picked.drop(*[f"_wide_{n}" for n in wanted])


def exact_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Exact quantiles with linear interpolation, one output column per name.

    Missing values, NaN included, take no rank.
    """
    df = df.withColumn(value, F.when(~is_missing(df, value), F.col(f"`{value}`")))
    wanted = {}
    for name, p in probabilities.items():
        wanted[f"lo_{name}"] = (p, lambda n, p=p: F.floor(F.lit(float(p)) * (n - 1)))
        wanted[f"hi_{name}"] = (p, lambda n, p=p: F.ceil(F.lit(float(p)) * (n - 1)))
    picked = select_ranks(df, value, wanted, by)

    def between(name: str) -> Column:
        rank = F.lit(float(probabilities[name])) * (F.col("size") - 1)
        low, high = F.col(f"lo_{name}.value"), F.col(f"hi_{name}.value")
        return low + (high - low) * (rank - F.floor(rank))

    return picked.select(*by, *[between(n).alias(n) for n in probabilities])


def leading_share(
    df: DataFrame, order: Sequence[str], share: float, by: Sequence[str] = (), name: str = "leading"
) -> DataFrame:
    """Mark the first int(share·n) rows of every group in ``order``.

    ``order`` are numbers or timestamps, unique together. The key of the last
    leading row is found by rank selection, one order column after the other
    and only while rows tie on it; rows are then compared with that key. They
    are neither sorted nor shuffled.
    """
    keys = [_number(df, c) for c in order]
    tied, cuts = df, None
    for level, key in enumerate(keys):
        if cuts is None:
            found = select_ranks(tied, key, {"at": (share, lambda n: F.floor(F.lit(share) * n) - 1)}, by)
            found = found.select(
                *by,
                F.col("at.value").alias("k0"),
                (F.floor(F.lit(share) * F.col("size")) - F.col("at.below")).alias("need"),
                F.col("at.equal").alias("equal"),
            )
            cuts = found
        else:
            within = _join_group(tied, cuts, by, "_c")
            for j in range(level):
                within = within.filter(keys[j] == F.col(f"_c.k{j}"))
            found = _nth_smallest(within.select(*by, key.alias("_v"), F.col("_c.need").alias("_need")), by)
            joined = _join_group(cuts, found, by, "_f")
            cuts = freeze(
                joined.select(
                    *by,
                    *[f"k{j}" for j in range(level)],
                    F.col("_f.value").alias(f"k{level}"),
                    F.col("_f.need").alias("need"),
                    F.col("_f.equal").alias("equal"),
                )
            )
        if cuts.filter(F.col("equal") > F.col("need")).isEmpty():
            keys = keys[: level + 1]
            break
    rows = _join_group(df, cuts, by, "_c")
    leading, same = F.lit(False), F.lit(True)
    for j, key in enumerate(keys):
        cut = F.col(f"_c.k{j}")
        leading = leading | (same & (key < cut))
        same = same & (key == cut)
    return rows.withColumn(name, F.coalesce(leading | same, F.lit(False))).drop("_c")


def _nth_smallest(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """The ``_need``-th smallest ``_v`` of every group of tied rows."""
    counts = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("n"), F.max("_need").alias("_need"))
    running = prefix_sums(counts, ["_v"], ["n"], by)
    before = F.col("cum_n") - F.col("n")
    hit = running.filter((before < F.col("_need")) & (F.col("_need") <= F.col("cum_n")))
    return hit.select(*by, F.col("_v").alias("value"), (F.col("_need") - before).alias("need"), F.col("n").alias("equal"))


def _number(df: DataFrame, name: str) -> Column:
    """An order column as a number; timestamps as microseconds."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return micros(F.col(f"`{name}`"))
    if not isinstance(kind, T.NumericType):
        raise TypeError(f"{name} is neither a number nor a timestamp")
    return F.col(f"`{name}`")
