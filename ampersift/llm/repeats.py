"""Removal of long repeated strings by a content-defined difference cover.

A suffix array by difference cover sorts the suffixes at sampled positions
first, by names of fixed-length strings, and derives the others from them. Here
only equality of 200-byte prefixes counts, so the same steps end early:

1. Cover. A position is sampled if the hash of its ``CORE`` bytes is the least in
   some window of ``WINDOW`` positions. The choice depends on the text alone, so
   two equal 200-byte strings hold their sample at the same place (a fixed
   residue cover would need a sample every few bytes and deep recursion).
2. Names. Samples are named by their core. A string can repeat only if the core
   of its sample does; samples with a unique name are settled.
3. Recursion on longer names. A sample with its whole reach (all 200-byte strings
   whose sample it is) is one name; where that repeats, all its strings do. Where
   cores repeat but reaches differ, one sample of each reach is cut into blocks
   of ``STEP`` starts, and blocks are named and settled in the same way.
4. Remaining suffixes. The strings of the blocks that are left are named one by
   one, and equal names are repeats.

Names are 64-bit hashes, compared within equal cores. Counts are combined before
every shuffle, and no group is gathered in one task. Two fixed-size bitmaps keep
settled samples and texts out of the shuffles; they only save work, a full one
lets everything pass.

Cases: a null text is the empty one; texts under 200 bytes lose nothing; matches
do not cross documents; repeated rows are copies of each other; overlapping
strings count; an empty table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampersift.llm.common import mix64, odd_numbers, plain, ready, release, store
from ampersift.llm.decontaminate import united

LENGTH = 200
WINDOW = 128
CORE = LENGTH - WINDOW + 1
# Starts of a block, and the bytes all its strings share.
STEP = 16
INNER = LENGTH - STEP + 1
# Texts are read in segments of so many bytes.
SEGMENT = 1 << 20
# Bits of the fixed-size bitmaps.
MAP_BITS = 26
_ODD = odd_numbers(32, 13)


def prefix_hashes(data: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each size, the hashes of all substrings of that many bytes, by doubling."""
    level, width = mix64(data.astype(np.uint64) + np.uint64(1)), 1
    found: dict[int, np.ndarray] = {}
    step = 0
    for size in sorted(sizes):
        while 2 * width <= size:
            level = level[: len(level) - width] * _ODD[step] + level[width:] * _ODD[step + 1]
            level ^= level >> np.uint64(29)
            width, step = 2 * width, step + 2
        n = len(data) - size + 1
        own = level[:n] * _ODD[30] + level[size - width : size - width + n] * _ODD[31]
        found[size] = mix64(own)
    return [found[s] for s in sizes]


def window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of every ``width`` (a power of two) neighbours."""
    level, reach = keys, 1
    while reach < width:
        level = np.minimum(level[: len(level) - reach], level[reach:])
        reach *= 2
    return level


class Samples:
    """Samples of one segment: core, reach and the range of starts they stand for."""

    __slots__ = ("core", "first", "full", "last", "reach", "starts")

    def __init__(self, data: np.ndarray):
        core, self.full = prefix_hashes(data, (CORE, LENGTH))
        # a start's sample is the last place of the least core in its window
        least = window_least(core, WINDOW)
        change = np.flatnonzero((least[1:] != least[:-1]) | (core[WINDOW:] == least[1:])) + 1
        self.first = np.concatenate([[0], change])
        self.last = np.concatenate([change, [len(least)]]) - 1
        self.core = least[self.first]
        reach = self.full[self.first] * _ODD[0] + self.full[self.last] * _ODD[1]
        self.reach = mix64(reach + (self.last - self.first).astype(np.uint64) * _ODD[2])


def segments(raw: bytes | None):
    """(place, bytes) of the segments of a text whose starts are all its 200-byte strings."""
    raw = raw or b""
    for at in range(0, max(0, len(raw) - LENGTH + 1), SEGMENT):
        yield at, np.frombuffer(raw, np.uint8, min(SEGMENT + LENGTH - 1, len(raw) - at), at)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def bitmap(keys: DataFrame) -> np.ndarray:
    """Fixed-size bitmap of a column ``key``, one bit per hash value. At most
    one number per 64 bits comes to the driver."""
    place = (1 << MAP_BITS) - 1
    words = keys.selectExpr(f"shiftright(key & {place}L, 6) AS word", "shiftleft(1L, int(key & 63)) AS bit")
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << MAP_BITS >> 6, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out.view(np.uint64)


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys.view(np.uint64) & np.uint64((1 << MAP_BITS) - 1)
    return (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


ANCHORS = "core long, reach long, row long, first int, last int"


def repeated_cores(texts: DataFrame) -> DataFrame:
    """Cores of two samples or more (key), counted in every task first."""

    def run(batches):
        for batch in batches:
            found = [Samples(d).core for raw in batch.column("raw").to_pylist() for _, d in segments(raw)]
            keys, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(n.astype(np.int64))], names=["key", "n"])

    counted = texts.select("raw").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return store(counted.where("n > 1").select("key"), "cores")


def anchors(texts: DataFrame, cores: DataFrame) -> DataFrame:
    """The samples whose core may repeat, with the row they are in."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(bitmap(cores))

    def run(batches):
        bits = shared.value
        for batch in batches:
            parts = []
            for row, raw in zip(batch.column("row").to_pylist(), batch.column("raw").to_pylist(), strict=True):
                for at, data in segments(raw):
                    s = Samples(data)
                    keep = marked(bits, s.core)
                    n = int(keep.sum())
                    if n:
                        parts.append(
                            (s.core[keep], s.reach[keep], np.full(n, row, np.int64), s.first[keep] + at, s.last[keep] + at)
                        )
            if parts:
                core, reach, row, first, last = (np.concatenate(c) for c in zip(*parts, strict=True))
                columns = (signed(core), signed(reach), row, first.astype(np.int32), last.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c) for c in columns], names=["core", "reach", "row", "first", "last"]
                )

    return texts.select("row", "raw").mapInArrow(run, ANCHORS)


def listed_parts(texts: DataFrame, cut, schema: str) -> DataFrame:
    """Rows that ``cut(core, row, first, data)`` makes of every listed range (todo)
    and the bytes its strings take."""

    def run(batches):
        for batch in batches:
            parts = []
            columns = (batch.column(c).to_pylist() for c in ("row", "raw", "todo"))
            for row, raw, todo in zip(*columns, strict=True):
                for s in todo:
                    data = np.frombuffer(raw, np.uint8, s["last"] - s["first"] + LENGTH, s["first"])
                    parts.append(cut(np.uint64(s["core"] & 0xFFFFFFFFFFFFFFFF), row, s["first"], data))
            if parts:
                columns = [pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return texts.select("row", "raw", "todo").mapInArrow(run, schema)


def blocks(core: np.uint64, row: int, first: int, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """A range cut into blocks of ``STEP`` starts, counted back from its sample.

    A block is named (core) by the bytes all its strings share, so none repeats
    where that does not, and (reach) by all its bytes.
    """
    keys, inner, full = prefix_hashes(data, (CORE, INNER, LENGTH))
    n = len(data) - LENGTH + 1
    near = keys[n - 1 : WINDOW]
    sample = n - 1 + len(near) - 1 - int(near[::-1].argmin())
    number = np.arange((sample - n + 1) // STEP, sample // STEP + 1)
    low = np.maximum(sample - number * STEP - STEP + 1, 0)
    high = np.minimum(sample - number * STEP, n - 1)
    shared = inner[sample - number * STEP]
    whole = full[low] * _ODD[3] + full[high] * _ODD[4] + (high - low).astype(np.uint64) * _ODD[5]
    name = mix64(core + shared * _ODD[6] + number.astype(np.uint64) * _ODD[7])
    place = (np.full(len(low), row, np.int64), (low + first).astype(np.int32), (high + first).astype(np.int32))
    return signed(name), signed(mix64(whole)), *place


def strings(core: np.uint64, row: int, first: int, data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Every 200-byte string of a range, named by core and content."""
    (full,) = prefix_hashes(data, (LENGTH,))
    at = np.arange(first, first + len(full), dtype=np.int32)
    return signed(mix64(full + core)), np.full(len(at), row, np.int64), at


def settle(found: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(settled, open) of samples (core, reach, row, first, last).

    A reach that occurs twice under a core is settled: all its strings repeat.
    Where reaches of one core differ and one of them is single, one sample of
    each reach stays open.
    """
    kinds = ["core", "reach"]
    reaches = store(
        found.groupBy(*kinds).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "first", "last")).alias("one")), f"{label}-reaches"
    )
    groups = reaches.groupBy("core").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least"))
    twice = reaches.where("n > 1").select(*kinds)
    settled = store(found.join(twice, kinds, "left_semi").select("row", "first", "last"), f"{label}-settled")
    mixed = groups.where("kinds > 1 AND least = 1").select("core")
    left = store(reaches.join(mixed, "core", "left_semi").select("core", "one.*"), f"{label}-open")
    release(found.sparkSession)
    return settled, left


def repeated_ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts, ranges): row, doc_id, n_bytes, raw (null where nothing can repeat)
    and sha256 of every row; and the ranges of starts (row, first, last) of
    200-byte strings that occur elsewhere too."""
    ready(docs.sparkSession)
    raw = F.coalesce(plain("text").cast("string"), F.lit("")).cast("binary")
    texts = docs.select(plain("doc_id").alias("doc_id"), raw.alias("raw"))
    texts = texts.withColumn("row", F.xxhash64("doc_id", "raw"))
    found = store(anchors(texts, repeated_cores(texts)), "anchors")
    settled, left = settle(found, "samples")
    rows = settled.select("row").union(left.select("row")).distinct()
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(rows.select(F.col("row").alias("key"))))

    def shrunk(batches):
        bits = shared.value
        for batch in batches:
            keep = marked(bits, batch.column("row").to_numpy()) if batch.num_rows else []
            texts_of = batch.column("raw").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("doc_id"),
                    pa.array([len(t) for t in texts_of], pa.int64()),
                    pa.array([t if k else None for t, k in zip(texts_of, keep, strict=True)], pa.binary()),
                    pa.array([None if k else hashlib.sha256(t).hexdigest() for t, k in zip(texts_of, keep, strict=True)], pa.string()),
                ],
                names=["row", "doc_id", "n_bytes", "raw", "sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, n_bytes long, raw binary, sha256 string"
    kept = store(texts.select("row", "doc_id", "raw").mapInArrow(shrunk, schema), "texts")
    held = kept.where("raw IS NOT NULL").select("row", "raw")
    release(docs.sparkSession)

    def parts(ranges: DataFrame, cut, schema: str, label: str) -> DataFrame:
        todo = ranges.groupBy("row").agg(F.collect_list(F.struct("core", "first", "last")).alias("todo"))
        # the open sample of repeated rows is one row's: either copy will do
        return store(listed_parts(held.join(todo, "row").dropDuplicates(["row"]), cut, schema), label)

    also, left = settle(parts(left, blocks, "core long, reach long, row long, first int, last int", "blocks"), "blocks")
    named = parts(left, strings, "name long, row long, at int", "strings")
    often = named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    single = named.join(often, "name", "left_semi").select("row", F.col("at").alias("first"), F.col("at").alias("last"))
    return kept, settled.union(also).union(single)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (text bytes left;
    null where the text stays whole) of every row of ``docs`` (doc_id, text)."""
    kept, ranges = repeated_ranges(docs)
    spans = ranges.groupBy("row").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))
    touched = kept.where("raw IS NOT NULL").join(spans, "row", "left").select("row", "doc_id", "n_bytes", "raw", "ranges")

    def run(batches):
        for batch in batches:
            removed, count, digest, left = [], [], [], []
            for raw, own in zip(batch.column("raw").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                cuts = united((r["first"], r["last"] + LENGTH) for r in own or ())
                ends = [0, *(x for c in cuts for x in c), len(raw)]
                rest = b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
                removed.append(len(raw) - len(rest))
                count.append(len(cuts))
                digest.append(hashlib.sha256(rest).hexdigest())
                left.append(rest if cuts else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("n_bytes"),
                    pa.array(removed, pa.int64()),
                    pa.array(count, pa.int64()),
                    pa.array(digest, pa.string()),
                    pa.array(left, pa.binary()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = touched.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    zero = F.lit(0).cast("long")
    whole = kept.where("raw IS NULL").select(
        "doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha256").alias("kept_sha256"), F.lit(None).cast("binary").alias("kept")
    )
    return cut.unionByName(whole)
