"""Hard negatives by segment summaries.

A row's vector is cut into segments. Of each segment its mean and its deviation
are stored; with m components, two segments with means a, b and deviations s, t
have an inner product between m (a b - s t) and m (a b + s t). Summed over the
segments that bounds a score from both sides without looking at the components.
The summaries form levels, each with twice as many segments as the one above.
Rows are packed into shards, anchors into blocks. Shards are dealt to lanes, each
of which sees all blocks in turn beside its own shards, so that the rows move
once, the anchors once a lane, and neither side is ever in one place. A task
scores an anchor against a shard exactly only where the bounds of all levels
leave it open whether a row belongs to the first ones.

Positives are found first; their scores then bound the negatives wanted from both
sides. What a task keeps of an anchor (and positive) is merged by rank.

Cases: rows with a null vec_id, label or vector, or a null, NaN or infinite
component, take no part, nor does one whose Euclidean norm is 2^31 or more after
scaling, since its scores need not fit 64 bits; two vectors of different length
have no score; an empty vector scores 0. Rows equal in id, label and vector count
once; an anchor's other rows have another vec_id, and rows that share an id are
each ranked, ties by label and then by vector. An anchor without positives, or a
positive without negatives, yields no row. An empty table gives an empty table;
extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampersift.llm.common import ready, store

# Rows of a shard and of a block of anchors; shards of a lane, if there are enough.
SHARD_ROWS, BLOCK_ROWS, LANE_SHARDS, LEAST_LANES = 1024, 1024, 64, 64
# Segments of the coarsest summary; every further level has twice as many.
SEGMENTS, LEVELS = 4, 3
KEEP = 5
LOW_PERCENT, HIGH_PERCENT = 80, 100
_LARGEST = 2.0**31

FOUND = "row long, which int, id long, label long, tie long, score long"


def scaled(vectors: DataFrame, every: int) -> DataFrame:
    """Whole-number vectors (v), labels changed where vec_id is divisible by
    ``every``, equal rows once, with a hash (tie) of the vector."""
    x = F.col("embedding").cast("array<double>")
    whole = F.transform(x, lambda e: F.floor(e * 256))
    sound = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < _LARGEST))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    label = F.col("label").cast("long")
    rows = rows.select(
        F.col("vec_id").cast("long").alias("id"),
        F.when(F.col("vec_id") % every == 0, (label + 1) % 10).otherwise(label).alias("label"),
        whole.alias("v"),
    )
    norm = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    rows = rows.where(norm < _LARGEST * _LARGEST).withColumn("tie", F.xxhash64("v"))
    return rows.distinct()


def edges(size: int, segments: int) -> np.ndarray:
    """Where the segments of a vector begin."""
    return np.unique(np.arange(segments) * size // segments) if size else np.zeros(0, int)


def summaries(v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level: means and deviations of all segments, times the root of their length."""
    out = []
    for level in range(LEVELS):
        at = edges(v.shape[1], SEGMENTS << level)
        if not len(at):
            out.append((np.zeros((len(v), 0)), np.zeros((len(v), 0))))
            continue
        n = np.diff(np.append(at, v.shape[1]))
        mean = np.add.reduceat(v, at, axis=1) / n
        spread = np.add.reduceat((v - np.repeat(mean, n, axis=1)) ** 2, at, axis=1)
        out.append((mean * np.sqrt(n), np.sqrt(spread)))
    return out


def _pack(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[pa.RecordBatch]:
    """One row per run of equal group and length: ids, labels, ties, extra scores,
    the vectors and their summaries as arrays of bytes."""
    for batch in batches:
        size = np.array(batch.column("size").to_numpy(), np.int64)
        key = batch.column(group).to_numpy()
        if not len(size):
            continue
        cuts = [0, *(np.flatnonzero((size[1:] != size[:-1]) | (key[1:] != key[:-1])) + 1).tolist(), len(size)]
        rows = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            v = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b - a, int(size[a]))
            parts = [x.astype(np.float64).tobytes() for level in summaries(v) for x in level]
            rows.append((int(key[a]), int(size[a]), *[np.array(part.column(n).to_numpy(zero_copy_only=False), np.int64).tobytes() for n in ("id", "label", "tie", "row")], v.tobytes(), parts))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _PACKED, strict=True)],
            names=[group, "size", "ids", "labels", "ties", "rows", "v", "parts"],
        )


_PACKED = [pa.int64(), pa.int64()] + [pa.binary()] * 5 + [pa.list_(pa.binary())]
_KINDS = "size long, ids binary, labels binary, ties binary, rows binary, v binary, parts array<binary>"


def packed(rows: DataFrame, group: Column, name: str, limit: int) -> DataFrame:
    """``rows`` in packs of ``limit`` rows of one length and group at most.

    A batch is a pack or several; batches hold no more rows than the session's
    limit, so a group of any size gives many packs."""
    spark = rows.sparkSession
    held = rows.withColumn(name, group).withColumn("size", F.size("v").cast("long"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(limit))
    parts = held.repartition(name).sortWithinPartitions(name, "size", "row")
    out = store(parts.mapInArrow(lambda batches: _pack(batches, name), f"{name} long, {_KINDS}"), f"negatives-{name}")
    ready(spark)
    return out


class Pack:
    """A pack of rows in a task."""

    def __init__(self, row: dict, prefix: str):
        get = lambda n: row[f"{prefix}_{n}"]
        self.ids, self.labels, self.ties, self.rows = (np.frombuffer(get(n), np.int64) for n in ("ids", "labels", "ties", "rows"))
        self.v = np.frombuffer(get("v"), np.float64).reshape(len(self.ids), get("size"))
        parts = [np.frombuffer(p, np.float64).reshape(len(self.ids), len(p) // 8 // len(self.ids)) for p in get("parts")]
        self.levels = list(zip(parts[::2], parts[1::2], strict=True))
        self.norm = np.sqrt((self.v**2).sum(axis=1))


def exact(a: np.ndarray, b: np.ndarray, norm: float) -> np.ndarray:
    """Inner products of the rows of ``a`` with ``b``; whole, whatever their size."""
    if norm < 2.0**52:  # no partial sum is rounded
        return (a @ b).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64)


class First:
    """The first KEEP rows by score, smaller id, label and tie."""

    def __init__(self):
        self.rows: list[tuple] = []

    @property
    def worst(self) -> float:
        """Scores below this one cannot get in."""
        return self.rows[-1][0] * -1 if len(self.rows) == KEEP else -np.inf

    def add(self, score: np.ndarray, pack: Pack, at: np.ndarray) -> None:
        order = np.lexsort((pack.ties[at], pack.labels[at], pack.ids[at], -score))[:KEEP]
        new = [(-int(score[i]), int(pack.ids[at[i]]), int(pack.labels[at[i]]), int(pack.ties[at[i]])) for i in order]
        self.rows = sorted(self.rows + new)[:KEEP]


def ranges(anchors: Pack, shard: Pack, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Per anchor the rows of the shard whose score may lie in its [low, high]:
    bounds of one level after the other, each for what the one before left."""
    slack = 1e-9 * anchors.norm[:, None] * shard.norm[None, :] + 1e-3
    (mean_a, dev_a), (mean_b, dev_b) = anchors.levels[0], shard.levels[0]
    middle, reach = mean_a @ mean_b.T, dev_a @ dev_b.T + slack
    open_ = (middle + reach >= low[:, None]) & (middle - reach <= high[:, None])
    for i in np.flatnonzero(open_.any(axis=1)):
        at = np.flatnonzero(open_[i])
        for (mean_a, dev_a), (mean_b, dev_b) in zip(anchors.levels[1:], shard.levels[1:], strict=True):
            middle, reach = mean_b[at] @ mean_a[i], dev_b[at] @ dev_a[i] + slack[i][at]
            at = at[(middle + reach >= low[i]) & (middle - reach <= high[i])]
            if not len(at):
                break
        if len(at):
            yield int(i), at


def _positives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first rows of each anchor's label in the shards of a task."""
    best: dict[int, First] = {}
    for cell in _cells(batches):
        anchors, shard = Pack(cell, "a"), Pack(cell, "s")
        if int(anchors.rows[0]) not in best:  # the next block
            yield from _emitted(((row, 0), first) for row, first in best.items())
            best = {}
        held = [best.setdefault(int(r), First()) for r in anchors.rows]
        low, high = np.array([h.worst for h in held]), np.full(len(held), np.inf)
        for i, at in ranges(anchors, shard, low, high):
            at = at[(shard.labels[at] == anchors.labels[i]) & (shard.ids[at] != anchors.ids[i])]
            if len(at):
                score = exact(shard.v[at], anchors.v[i], float(anchors.norm[i] * shard.norm[at].max()))
                held[i].add(score, shard, at)
    yield from _emitted(((row, 0), first) for row, first in best.items())


def _negatives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first rows of other labels in the range of each anchor and positive."""
    best: dict[tuple[int, int], First] = {}
    block = None
    for cell in _cells(batches):
        anchors, shard = Pack(cell, "a"), Pack(cell, "s")
        if int(anchors.rows[0]) != block:
            yield from _emitted(best.items())
            best, block = {}, int(anchors.rows[0])
        wanted = [cell["a_positives"][str(r)] for r in anchors.rows.tolist()]
        held = [[best.setdefault((int(r), k), First()) for k, _ in w] for r, w in zip(anchors.rows, wanted, strict=True)]
        # what a full list no longer takes, and what is below the band of the least positive
        low = np.array([min((max(floor_of(p), h.worst) for (_, p), h in zip(w, hs, strict=True)), default=np.inf) for w, hs in zip(wanted, held, strict=True)], float)
        high = np.array([max((p for _, p in w), default=-np.inf) for w in wanted], float)
        for i, at in ranges(anchors, shard, low, high):
            at = at[(shard.labels[at] != anchors.labels[i]) & (shard.ids[at] != anchors.ids[i])]
            if not len(at):
                continue
            score = exact(shard.v[at], anchors.v[i], float(anchors.norm[i] * shard.norm[at].max()))
            for (_, p), first in zip(wanted[i], held[i], strict=True):
                inside = np.flatnonzero((score <= p * HIGH_PERCENT // 100) & (score >= max(floor_of(p), first.worst)))
                if len(inside):
                    first.add(score[inside], shard, at[inside])
    yield from _emitted(best.items())


def floor_of(positive: int) -> int:
    """The least whole score s with LOW_PERCENT * positive <= 100 * s."""
    return -(-positive * LOW_PERCENT // 100)


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            cell = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
            if "a_found" in cell:
                cell["a_positives"] = {str(f["row"]): [(p["which"], p["score"]) for p in f["list"]] for f in cell["a_found"]}
                for r in np.frombuffer(cell["a_rows"], np.int64).tolist():
                    cell["a_positives"].setdefault(str(r), [])
            yield cell


def _emitted(found) -> Iterator[pa.RecordBatch]:
    rows = []
    for (row, which), first in found:
        rows += [(row, which, i, label, tie, -s) for s, i, label, tie in first.rows]
        if len(rows) > 20_000:
            yield _rows(rows)
            rows = []
    yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=[p.split()[0] for p in FOUND.split(", ")])


def ranked(found: DataFrame) -> DataFrame:
    """The first KEEP rows of each anchor and positive, with their rank; each task
    has left KEEP at most."""
    order = Window.partitionBy("row", "which").orderBy(F.desc("score"), "id", "label", "tie")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= KEEP)


def crossed(shards: DataFrame, blocks: DataFrame, lanes: int) -> DataFrame:
    """Every block of anchors beside every shard of its length, lane by lane. The
    merge join takes the blocks of a lane one after the other and keeps the
    lane's shards, which it may spill."""
    right = shards.select(*[F.col(c).alias(f"s_{c}") for c in shards.columns if c != "shard"], F.pmod("shard", F.lit(lanes)).alias("lane"))
    left = blocks.select(*[F.col(c).alias(f"a_{c}") for c in blocks.columns if c != "block"])
    left = left.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    match = (left["lane"] == right["lane"]) & (left["a_size"] == right["s_size"])
    return left.join(right.hint("merge"), match).drop("lane")


def mine(vectors: DataFrame, anchor_every: int = 100, relabel_every: int = 7) -> DataFrame:
    """Hard negatives of every anchor and positive: anchor_id, positive_id, rank,
    negative_id, positive_score, negative_score."""
    ready(vectors.sparkSession)
    rows = store(scaled(vectors, relabel_every), "negatives-rows")
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()), "negatives-numbered")
    anchors = rows.where(F.col("id") % anchor_every == 0)
    number = max(1, -(-anchors.count() // BLOCK_ROWS))
    many = max(1, -(-rows.count() // SHARD_ROWS))
    shards = packed(rows, F.pmod(F.xxhash64("row", F.lit(1)), F.lit(many)), "shard", SHARD_ROWS)
    blocks = packed(anchors, F.pmod(F.xxhash64("row", F.lit(2)), F.lit(number)), "block", BLOCK_ROWS)
    lanes = min(many, max(LEAST_LANES, many // LANE_SHARDS))
    first = store(ranked(_mapped(crossed(shards, blocks, lanes), _positives)).drop("which"), "negatives-positives")
    # scores by block beside the anchors
    lists = first.groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("which"), "score"))).alias("list"))
    listed = rows.where(F.col("id") % anchor_every == 0).join(lists, "row")
    home = F.pmod(F.xxhash64("row", F.lit(2)), F.lit(number))
    by_block = listed.groupBy(home.alias("block")).agg(F.collect_list(F.struct("row", "list")).alias("found"))
    cells = crossed(shards, blocks.join(by_block, "block"), lanes)
    found = store(ranked(_mapped(cells, _negatives)), "negatives-found")
    left = anchors.select("row", F.col("id").alias("anchor_id"))
    chosen = first.select("row", F.col("rank").alias("which"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = found.select("row", "which", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = out.join(chosen, ["row", "which"]).join(left, "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _mapped(cells: DataFrame, step) -> DataFrame:
    spark = cells.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    out = store(cells.mapInArrow(step, FOUND), "negatives-cells")
    ready(spark)
    return out
