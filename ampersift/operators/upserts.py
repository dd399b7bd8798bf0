"""Deduplication, appends and latest-row updates.

One row per key is chosen with ``min_by`` / ``max_by`` instead of a ranked
window: the choice is combined map-side, so a key with many copies reaches the
shuffle as one candidate per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ampersift.functions.columns import quoted


def _one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], latest: bool) -> DataFrame:
    choose = F.max_by if latest else F.min_by
    payload = [c for c in df.columns if c not in keys]
    if not payload:
        return df.distinct()
    rank = F.struct(*[quoted(o) for o in order])
    picked = df.groupBy(*[quoted(k) for k in keys]).agg(
        choose(F.struct(*[quoted(c) for c in payload]), rank).alias("_row")
    )
    return picked.select(
        *[
            quoted(c) if c in keys else F.col(f"_row.`{c}`").alias(c)
            for c in df.columns
        ]
    )


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key; ``order`` should be total."""
    return _one_per_key(df, keys, order, latest=True)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` per key."""
    return _one_per_key(df, keys, order, latest=False)


def stack(frames: Sequence[DataFrame], source_order: str | None = None) -> DataFrame:
    """UNION ALL by name; absent columns become NULL. Optionally number the source."""
    out = None
    for i, frame in enumerate(frames):
        part = frame.withColumn(source_order, F.lit(i)) if source_order else frame
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to stack")
    return out


def append_keep_last(
    existing: DataFrame, new: DataFrame, keys: Sequence[str] = ("datetime",), tie: Sequence[str] = ()
) -> DataFrame:
    """Append ``new`` to ``existing``; a newer row replaces an older one."""
    both = stack([existing, new], "_src_ord")
    return keep_last(both, keys, ["_src_ord", *tie]).drop("_src_ord")


def append_keep_first(
    existing: DataFrame, new: DataFrame, keys: Sequence[str] = ("datetime",), tie: Sequence[str] = ()
) -> DataFrame:
    """Append ``new``; rows already present win."""
    both = stack([existing, new], "_src_ord")
    return keep_first(both, keys, ["_src_ord", *tie]).drop("_src_ord")


def first_n(df: DataFrame, n: int, by: Sequence[str], order: Sequence) -> DataFrame:
    """First n rows per group.

    Spark turns the rank filter into a per-task limit before the shuffle, so a
    hot group ships n rows per task.
    """
    w = Window.partitionBy(*[quoted(b) for b in by]).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def last_n(df: DataFrame, n: int, by: Sequence[str], ts: str, tie: Sequence[str] = ()) -> DataFrame:
    """Last n rows per group in time order."""
    return first_n(df, n, by, [quoted(ts).desc(), *[quoted(t).desc() for t in tie]])


def feedback_upsert(
    results: DataFrame,
    feedback: DataFrame,
    keys: Sequence[str] = ("query", "variant_id"),
    order: Sequence[str] = ("timestamp", "result_id"),
    row_id: str = "result_id",
    score: str = "satisfaction_score",
    comment: str | None = None,
) -> DataFrame:
    """Write each feedback score to the latest matching result.

    ``feedback`` holds ``keys``, ``score`` (and ``comment``) with a ``feedback_no``
    giving arrival order; the last feedback per key wins. Every result stays one
    row.
    """
    given = [score] + ([comment] if comment else [])
    latest_note = keep_last(feedback.select(*keys, *given, "feedback_no"), keys, ["feedback_no"])
    newest = results.groupBy(*keys).agg(
        F.max_by(F.col(row_id), F.struct(*order)).alias(row_id)
    )
    updates = newest.join(latest_note, list(keys)).select(
        row_id, *[F.col(g).alias(f"_new_{g}") for g in given]
    )
    out = results.join(updates, row_id, "left")
    for g in given:
        old = F.col(g) if g in results.columns else F.lit(None)
        out = out.withColumn(g, F.coalesce(F.col(f"_new_{g}"), old))
    return out.drop(*[f"_new_{g}" for g in given])


def unmatched_feedback(
    results: DataFrame, feedback: DataFrame, keys: Sequence[str] = ("query", "variant_id")
) -> DataFrame:
    """Feedback that matches no result, for the reject table."""
    return feedback.join(results.select(*keys).distinct(), list(keys), "left_anti")
