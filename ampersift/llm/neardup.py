"""Near-duplicate groups by MinHash bands and odd sketches.

Each text is the set of its distinct word shingles. MinHash samples of the set
are grouped into bands, and all samples are folded into a parity bitmap, the odd
sketch: the bits set in the XOR of two sketches estimate how many samples differ,
precisely where similarity is high. A second one, of the whole set, bounds the
shingles that two sets do not share. Texts that share a band are candidates, the
sketches sort out unlikely pairs, and what remains is confirmed on the full sets.

Equal sets are one class, represented by their smallest id. In a band's bucket
every class is first held against the middle one, which shares most bands with others;
links make components. Only classes that are still in another component than the
middle one are held against the whole bucket afterwards, in blocks, so a large
group of copies costs its size and no pair between components goes untested.

Sets are compared through 64-bit hashes of the shingles.

Cases: a null, empty or wordless text has no shingle and no link; with fewer
words than a shingle the whole sequence is one; a row with a null id is linked
with nothing, has a null component and is kept; repeated rows share a component;
an empty table gives an empty table; extra columns and clashing names do not
matter, only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampersift.llm.common import annotate, mix64, odd_numbers, plain, raw_texts, ready, store

# 32 bands of 5 samples miss a pair at similarity 0.8 with probability 3e-6, at 0.85 with 2e-8.
BANDS, ROWS = 32, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
# Pairs whose estimate is this far below the bound are left out: over six
# standard deviations of the share of differing samples.
SLACK = 0.19
# Bits of the odd sketch of a whole set. Its XOR count never exceeds the number of
# shingles in one set only, so a pair with more set bits than its sizes allow is no link.
SET_BITS = 2048
# Classes held against each other at once.
BLOCK = 512
_WORDS_HELD = 400_000

SIGNATURE = T.StructType(
    [
        T.StructField("n_shingles", T.LongType(), False),
        T.StructField("set_id", T.BinaryType()),
        T.StructField("bands", T.ArrayType(T.LongType(), False)),
        T.StructField("sketch", T.BinaryType()),
        T.StructField("parity", T.BinaryType()),
    ]
)


class Shingles:
    """Sorted distinct 64-bit hashes of a text's word shingles."""

    def __init__(self, width: int):
        self.width = width
        self.known: dict[bytes, int] = {}

    def __missing_word(self, word: bytes) -> int:
        value = self.known[word] = xxhash.xxh64_intdigest(word)
        return value

    def __call__(self, raw: bytes | None) -> np.ndarray:
        own = raw.lower().split() if raw else []
        if not own:
            return np.zeros(0, np.uint64)
        if len(self.known) > _WORDS_HELD:
            self.known.clear()
        known, learn = self.known, self.__missing_word
        ids = np.fromiter((known[w] if w in known else learn(w) for w in own), np.uint64, len(own))
        size = min(self.width, len(own))
        total = np.full(len(own) - size + 1, size, np.uint64)
        for j, factor in enumerate(odd_numbers(size, 1)):
            total += mix64(ids[j : j + len(total)] * factor)
        return np.unique(mix64(total))


_FACTORS = odd_numbers(SAMPLES, 2).astype(np.uint32) | np.uint32(1)
_SHIFTS = (odd_numbers(SAMPLES, 7) >> np.uint64(32)).astype(np.uint32)


def samples(shingles: np.ndarray) -> np.ndarray:
    """MinHash samples of a set."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 1024):
        block = short[at : at + 1024, None] * _FACTORS
        block ^= _SHIFTS
        np.minimum(out, block.min(axis=0), out=out)
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    grid = found.reshape(BANDS, ROWS).astype(np.uint64)
    for j in range(ROWS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + grid[:, j])
    return keys.view(np.int64)


def odd_sketch(found: np.ndarray) -> bytes:
    """Parity bitmap of the (number, sample) pairs."""
    places = mix64(found.astype(np.uint64) * np.uint64(SAMPLES) + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(SKETCH_BITS)
    return parities(places, SKETCH_BITS)


def parities(places: np.ndarray, bits: int) -> bytes:
    odd = np.bincount(places.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def most_apart(percent: int, total):
    """Most shingles in one set only, of a linked pair with ``total`` shingles in both."""
    return total * (100 - percent) // (100 + percent)


def most_bits(percent: int) -> int:
    """Largest XOR population count of sketches of sets that may be similar enough."""
    toggles = 2 * SAMPLES * (1 - percent / 100 + SLACK)
    return int(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** toggles))


def signatures(docs: DataFrame, width: int) -> DataFrame:
    def setup():
        shingles = Shingles(width)

        def step(batch: pa.RecordBatch) -> dict:
            out = {n: [] for n in SIGNATURE.names}
            for raw in raw_texts(batch):
                own = shingles(raw)
                found = samples(own) if len(own) else None
                row = (
                    len(own),
                    xxhash.xxh128_digest(own.tobytes()) if len(own) else None,
                    band_keys(found).tolist() if len(own) else None,
                    odd_sketch(found) if len(own) else None,
                    parities(own & np.uint64(SET_BITS - 1), SET_BITS) if len(own) else None,
                )
                for name, value in zip(SIGNATURE.names, row, strict=True):
                    out[name].append(value)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary())
            return {n: pa.array(out[n], k) for n, k in zip(SIGNATURE.names, kinds, strict=True)}

        return step

    return annotate(docs, SIGNATURE, setup).drop("text")


def alike(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``texts``: id, text."""
    one = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        shingles = Shingles(width)
        last, held = None, None  # pairs come sorted by b where the join sorts
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for other, left, right in zip(b, raw_texts(batch, "text_a"), raw_texts(batch, "text_b"), strict=True):
                if other != last:
                    last, held = other, shingles(right)
                own = shingles(left)
                spot = np.searchsorted(held, own)
                spot[spot == len(held)] = 0
                common = int((held[spot] == own).sum())
                keep.append(100 * common >= percent * (len(own) + len(held) - common))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x, k in zip(c, keep, strict=True) if k], pa.int64()) for c in (a, b)], names=["a", "b"]
            )

    return both.mapInArrow(run, "a long, b long")


def close_sketches(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches differ in few enough bits, by a native count."""
    one = sketches.select(F.col("id").alias("a"), F.col("words").alias("words_a"))
    two = sketches.select(F.col("id").alias("b"), F.col("words").alias("words_b"))
    bits = F.aggregate(
        F.zip_with("words_a", "words_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x
    )
    return pairs.join(one, "a").join(two, "b").where(bits <= most_bits(percent)).select("a", "b")


def sketch_words(sketch: str = "sketch"):
    """A sketch as 64-bit numbers."""
    width = 8
    part = lambda i: F.conv(F.hex(F.substring(sketch, i * width + 1, width)), 16, -10).cast("long")
    return F.array(*[part(i) for i in range(SKETCH_BITS // 64)])


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable from each end of an edge.

    Smallest labels travel along the edges, then labels of labels; a path of n
    edges takes about log n rounds. Each round is written to the shared folder.
    """
    both = store(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = store(
        both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component")),
        "labels",
    )
    while True:
        heard = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        near = labels.join(heard, "id").select("id", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        onward = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        moved = store(
            near.join(onward, "component", "left").select("id", F.coalesce("further", "component").alias("component"), "old"), "labels"
        )
        labels = moved.drop("old")
        if moved.where("component <> old").isEmpty():
            return labels


def outside_pairs(members: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs of one bucket, of different components and close sketches;
    ``members``: key, id, middle, component.

    Outsiders (not in the component of the middle class) meet every member, both
    in blocks of at most about ``BLOCK`` classes.
    """
    home = F.max(F.when(F.col("id") == F.col("middle"), F.col("component")))
    sizes = members.groupBy("key").agg(
        home.alias("home"), F.count(F.lit(1)).alias("n"), F.min("component").alias("c0"), F.max("component").alias("c1")
    )
    mixed = members.join(sizes.where("c0 <> c1").select("key", "n", "home"), "key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = (
        mixed.join(sketches.select("id", "sketch", "parity", "n_shingles"), "id")
        .withColumn("outside", F.col("component") != F.col("home"))
        .withColumn("own", F.pmod(F.xxhash64("id"), blocks.cast("long")).cast("int"))
        .withColumn("each", F.sequence(F.lit(0), blocks - 1))
    )
    entry = F.struct("id", "component", "sketch", "parity", "n_shingles").alias("entry")
    # a group is the outsiders of one block and the members of another
    first = placed.where("outside").select("key", F.col("own").alias("i"), F.explode("each").alias("j"), F.lit(True).alias("first"), entry)
    among = placed.where("outside").select("key", F.col("own").alias("i")).distinct()
    second = placed.join(among, "key").select("key", "i", F.col("own").alias("j"), F.lit(False).alias("first"), entry)
    groups = (
        first.unionByName(second)
        .groupBy("key", "i", "j")
        .agg(
            F.collect_list(F.when(F.col("first"), F.col("entry"))).alias("one"),
            F.collect_list(F.when(~F.col("first"), F.col("entry"))).alias("two"),
        )
        .where((F.size("one") > 0) & (F.size("two") > 0))
    )
    most = most_bits(percent)

    def run(batches):
        for batch in batches:
            a, b = [], []
            for one, two in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist(), strict=True):
                ids = [np.array([e["id"] for e in x], np.int64) for x in (one, two)]
                comps = [np.array([e["component"] for e in x], np.int64) for x in (one, two)]
                sizes = [np.array([e["n_shingles"] for e in x], np.int64) for x in (one, two)]
                maps, sets = (
                    [np.frombuffer(b"".join(e[name] for e in x), np.uint64).reshape(len(x), -1) for x in (one, two)]
                    for name in ("sketch", "parity")
                )
                for k in range(len(ids[0])):
                    bits = np.bitwise_count(maps[1] ^ maps[0][k]).sum(axis=1)
                    apart = np.bitwise_count(sets[1] ^ sets[0][k]).sum(axis=1)
                    hit = (bits <= most) & (apart <= most_apart(percent, sizes[1] + sizes[0][k])) & (comps[1] != comps[0][k])
                    other = ids[1][hit]
                    a += np.maximum(other, ids[0][k]).tolist()
                    b += np.minimum(other, ids[0][k]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return groups.select("one", "two").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Documents are linked where 100 * intersection >= percent * union of their
    distinct ``width``-word shingles.
    """
    ready(docs.sparkSession)
    texts = docs.select(plain("doc_id").cast("long").alias("doc_id"), plain("text").cast("string").alias("text"))
    signed = store(signatures(texts, width), "signatures")
    sets = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = store(sets.groupBy("set_id").agg(F.min("doc_id").alias("id")), "classes")
    reps = store(
        sets.join(classes.withColumnRenamed("id", "doc_id"), ["set_id", "doc_id"], "left_semi")
        .select(F.col("doc_id").alias("id"), "n_shingles", "bands", "sketch", "parity")
        .dropDuplicates(["id"]),
        "class-signatures",
    )
    banded = reps.select("id", F.explode("bands").alias("key"))
    sizes = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = store(banded.join(sizes, "key"), "buckets")
    # of a group's classes, the one in the middle shares most bands with the others
    degree = shared.groupBy("id").agg(F.sum("n").alias("degree"))
    ranked = shared.select("key", "id").join(degree, "id")
    middles = ranked.groupBy("key").agg(F.max(F.struct("degree", -F.col("id"))).alias("top"))
    members = store(
        shared.select("key", "id").join(middles.select("key", (-F.col("top.col2")).alias("middle")), "key"), "middles"
    )
    pairs = members.where("id <> middle").select(
        F.greatest("id", "middle").alias("a"), F.least("id", "middle").alias("b")
    ).distinct()
    sketches = reps.select("id", "n_shingles", "sketch", "parity", sketch_words().alias("words"))
    tried = store(close_sketches(pairs, sketches, percent), "pairs")
    wanted = members.select("id").distinct()
    held = store(
        texts.withColumnRenamed("doc_id", "id").join(wanted, "id", "left_semi").dropDuplicates(["id"]), "candidate-texts"
    )
    linked = store(alike(tried, held, width, percent), "links")
    found = components(linked)

    grouped = members.join(found, "id", "left").select("key", "id", "middle", F.coalesce("component", "id").alias("component"))
    more = outside_pairs(grouped, sketches, percent).join(tried, ["a", "b"], "left_anti")
    added = store(alike(more, held, width, percent), "links")
    if not added.isEmpty():
        found = components(linked.union(added))

    rows = signed.select("doc_id", "n_shingles", "set_id")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "id", "doc_id"))
    return (
        rows.join(classes, "set_id", "left")
        .join(found.withColumnRenamed("id", "of"), F.col("id") == F.col("of"), "left")
        .select("doc_id", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id.

    Rows that repeat a kept id are one document; the first by its text stays.
    """
    kept = near_duplicates(docs, width, percent).where("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    known = docs.where(plain("doc_id").isNotNull()).dropDuplicates(["doc_id"])
    return known.join(kept, "doc_id", "left_semi").select(*docs.columns).union(docs.where(plain("doc_id").isNull()))
