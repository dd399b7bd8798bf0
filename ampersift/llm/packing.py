"""Packing of token sequences: shortest pack first over the length histogram.

A document is its token ids followed by one end id. It is cut into pieces: full
sequences first, the rest is one shorter piece. Short pieces are counted by
length, and the histogram alone (at most one count per length) is packed:
lengths are placed longest first into the open pattern with the least tokens
that still leaves room, and pattern counts are split where they differ. Pieces
then find their place by their rank among the pieces of the same length.

Where lengths do not fit together the histogram leaves gaps. Cutting is free, so
the pieces of badly filled patterns are cut into powers of two, which fill
sequences without gaps, and a sequence left at a power of two needs no padding.

Cases: a null text is the empty one, a single end id; repeated rows and ids are
packed one by one; an empty table gives an empty table; extra columns are
dropped, names cannot clash.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampersift.llm.common import once, plain, raw_texts, ready, store

SEQUENCE = 1024
END_ID = 0
# Share of padding above which a pattern's pieces are cut.
LOOSE = 0.02
# Rank counters per length: pieces of one length are numbered in so many parts.
PARTS = 64

# The word pattern of the byte-level vocabulary, and its special token.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPECIAL = "<|endoftext|>"
# Longest run without white space given to the rank encoder.
LONG_RUN = re.compile(r"\S{4096}")

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType(), False),
        T.StructField("length", T.LongType(), False),
        T.StructField("ids_crc32", T.LongType(), False),
        T.StructField("doc_tokens", T.LongType(), False),
        T.StructField("cuts", T.ArrayType(T.LongType(), False), False),
    ]
)


class Encoder:
    """Token ids of the vocabulary file at ``path``.

    The rank encoder gives the same ids as the file's own library several times
    faster. Texts with the special token or a very long run go to that library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        ranks = {bytes(byte_of[c] for c in word): rank for word, rank in vocabulary.items() if word != SPECIAL}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.full = Tokenizer.from_file(path)

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL in text or LONG_RUN.search(text):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=())


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself, or the next from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def powers(length: int) -> list[int]:
    """``length`` as falling powers of two."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def pieces(docs: DataFrame, vocabulary: str, size: int = SEQUENCE) -> DataFrame:
    """Full sequences and rests of every document, each with the crc32 of its
    ids, and for a rest the crc32 of its power-of-two parts (``cuts``)."""

    def run(batches):
        encoder = once(("encoder", vocabulary), lambda: Encoder(vocabulary))
        for batch in batches:
            out = {n: [] for n in PIECES.names}
            ids_of = batch.column("doc_id").to_pylist()
            for doc, raw in zip(ids_of, raw_texts(batch), strict=True):
                tokens = np.append(encoder.ids((raw or b"").decode()), END_ID).astype("<u4")
                for start in range(0, len(tokens), size):
                    own = tokens[start : start + size]
                    parts = powers(len(own)) if len(own) < size else []
                    ends = np.cumsum(parts).tolist()
                    row = (
                        doc,
                        start,
                        len(own),
                        zlib.crc32(own.tobytes()),
                        len(tokens),
                        [zlib.crc32(own[b - n : b].tobytes()) for n, b in zip(parts, ends, strict=True)],
                    )
                    for name, value in zip(PIECES.names, row, strict=True):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict(
                out, schema=pa.schema([(n, pa.int64()) for n in PIECES.names[:-1]] + [("cuts", pa.list_(pa.int64()))])
            )

    return docs.select(plain("doc_id").cast("long"), plain("text").cast("string")).mapInArrow(run, PIECES)


@dataclass
class Pattern:
    """``count`` sequences, each holding ``times`` pieces per length."""

    count: int
    used: int
    times: tuple[tuple[int, int], ...]


def pack_histogram(histogram: dict[int, int], size: int = SEQUENCE) -> list[Pattern]:
    """Shortest-pack-first packing of a length histogram.

    The work and the number of patterns depend on the number of lengths, not on
    the number of pieces: equal sequences stay one pattern with a count.
    """
    open_by_used: dict[int, list[Pattern]] = {}
    order: list[int] = []  # heap of the lengths in use

    def put(pattern: Pattern) -> None:
        if pattern.used not in open_by_used:
            heapq.heappush(order, pattern.used)
        open_by_used.setdefault(pattern.used, []).append(pattern)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            least = order[0] if order else size
            if least + length > size:
                times = size // length
                full, rest = divmod(left, times)
                for count, n in ((full, times), (1, rest)):
                    if count and n:
                        put(Pattern(count, n * length, ((length, n),)))
                break
            bucket = open_by_used[least]
            found = bucket.pop()
            if not bucket:
                del open_by_used[least]
                heapq.heappop(order)
            room = (size - found.used) // length
            each = min(room, max(1, left // found.count))
            taken = min(found.count, left // each)
            put(Pattern(taken, found.used + each * length, (*found.times, (length, each))))
            if found.count > taken:
                put(Pattern(found.count - taken, found.used, found.times))
            left -= taken * each
    return [p for bucket in open_by_used.values() for p in bucket]


def padding(pattern: Pattern, size: int = SEQUENCE) -> int:
    """Padded tokens of one sequence; none at a power of two."""
    return 0 if pattern.used & (pattern.used - 1) == 0 else size - pattern.used


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> tuple[list[tuple], dict[int, int]]:
    """(slots, cut) of a histogram of short pieces.

    ``cut`` tells for each length how many pieces, first by rank, are cut into
    powers of two. A slot (length, first rank, pieces, times, sequence, offset)
    places pieces of a length: rank r of them is copy (r - first) % times of
    sequence + (r - first) // times.
    """
    kept, cut = [], Counter()
    for p in pack_histogram(histogram, size):
        if padding(p, size) > LOOSE * size:
            cut.update({length: n * p.count for length, n in p.times})
        else:
            kept.append(p)
    halves: Counter = Counter()
    for length, n in cut.items():
        halves.update({x: n for x in powers(length)})
    kept_cut = [(p, True) for p in pack_histogram(dict(halves), size)]
    seen: dict[tuple[int, bool], int] = {(length, False): n for length, n in cut.items()}
    slots, sequence = [], 0
    for p, from_cut in [(p, False) for p in kept] + kept_cut:
        offset = 0
        for length, times in p.times:
            first = seen.get((length, from_cut), 0)
            slots.append((length, from_cut, first, first + p.count * times, times, sequence, offset))
            seen[length, from_cut] = first + p.count * times
            offset += times * length
        sequence += p.count
    return slots, dict(cut)


SLOTS = "length long, from_cut boolean, low long, high long, times long, first_sequence long, first_offset long"


def ranked(df: DataFrame, *by: str) -> DataFrame:
    """``rank`` (from 0) within ``by``, numbered in parts so that one hot length
    spreads over tasks. ``df`` has to be stored: both passes must see the same rows."""
    salted = df.withColumn("_part", F.pmod(F.xxhash64("doc_id", "start", "doc_tokens", "ids_crc32"), F.lit(PARTS)))
    keys = [*by, "_part"]
    counts = salted.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    order = Window.partitionBy(*keys).orderBy("doc_id", "start", "ids_crc32")
    numbered = salted.withColumn("_row", F.row_number().over(order))
    return numbered.join(bases, keys).withColumn("rank", F.col("_base") + F.col("_row") - 1).drop("_part", "_base", "_row")


def pack(docs: DataFrame, vocabulary: str, size: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset in the sequence."""
    spark = ready(docs.sparkSession)
    stored = store(pieces(docs, vocabulary, size), "pieces")
    full, short = stored.where(F.col("length") == size), stored.where(F.col("length") < size)
    rows = short.groupBy("length").count().collect()  # at most one row per length
    slots, cut = plan({r["length"]: r["count"] for r in rows}, size)

    cuts = spark.createDataFrame([(k, n) for k, n in cut.items()], "length long, n_cut long")
    by_rank = ranked(short, "length").join(F.broadcast(cuts), "length", "left")
    is_cut = F.col("rank") < F.coalesce("n_cut", F.lit(0))
    parts = store(
        by_rank.withColumn("from_cut", is_cut)
        .withColumn("part", F.explode(_parts(size)))
        .select(
            "doc_id",
            (F.col("start") + F.col("part.at")).alias("start"),
            F.col("part.length").alias("length"),
            F.col("part.crc").alias("ids_crc32"),
            "doc_tokens",
            "from_cut",
            "rank",
        ),
        "packed-parts",
    )
    whole = parts.where(~F.col("from_cut"))
    again = ranked(parts.where("from_cut").drop("rank"), "length").select(*whole.columns)
    found = F.broadcast(spark.createDataFrame(slots, SLOTS))
    packed = (
        whole.unionByName(again)
        .join(found, ["length", "from_cut"])
        .where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
        .withColumn("place", F.col("rank") - F.col("low"))
        .select(
            *PIECES.names[:-1],
            (F.col("first_sequence") + F.floor(F.col("place") / F.col("times"))).cast("long").alias("sequence_id"),
            (F.col("first_offset") + F.pmod("place", "times") * F.col("length")).cast("long").alias("offset"),
        )
    )
    taken = sum({s[5]: (s[3] - s[2]) // s[4] for s in slots}.values())
    alone = full.drop("cuts").withColumns(
        {"sequence_id": F.monotonically_increasing_id() + F.lit(taken), "offset": F.lit(0).cast("long")}
    )
    return packed.unionByName(alone)


def _parts(size: int):
    """A piece as it stays, or its power-of-two parts with their places."""
    whole = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("length"), F.col("ids_crc32").alias("crc")))
    bits = [1 << b for b in range((size - 1).bit_length() - 1, -1, -1)]
    has = lambda b: F.col("length").bitwiseAND(F.lit(b)) != 0
    places = []
    for b in bits:
        above = F.lit(~(2 * b - 1))
        crc = F.element_at("cuts", (F.bit_count(F.col("length").bitwiseAND(above)) + 1).cast("int"))
        at = F.col("length").bitwiseAND(above).cast("long").alias("at")
        places.append(F.when(has(b), F.struct(at, F.lit(b).cast("long").alias("length"), crc.alias("crc"))))
    parts = F.filter(F.array(*places), lambda p: p.isNotNull())
    return F.when(F.col("from_cut"), parts).otherwise(whole)
