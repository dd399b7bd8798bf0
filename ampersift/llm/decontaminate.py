"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Words are lower-cased (A-Z) runs of digits, a-z and non-ASCII characters. Every
13 consecutive words of a benchmark item are a window; a shorter item is one
window. Training texts are scanned once; word windows whose hash is in the set
are compared word by word, and each word inside a verified window is hit.

Cases: a null or wordless text has no words and is clean; a null or wordless
item has no window; an empty benchmark hits nothing; repeated rows are judged
one by one; items sharing an id count once; a null id counts as the empty
string; a window shared by several items counts for each; extra columns stay,
those named like a result column are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampersift.llm.common import annotate, odd_numbers, plain, raw_texts

WINDOW = 13
# Bytes of benchmark text in one broadcast index. A larger benchmark is cut
# into blocks of items, and each block scans the texts in turn.
INDEX_BYTES = 16 << 20

_LOWERED = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(c if c in _LOWERED else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_WORD = re.compile(rb"[^ ]+")

HIT_FIELDS = T.StructType(
    [
        T.StructField("n_words", T.LongType(), False),
        T.StructField("hit_from", T.ArrayType(T.IntegerType(), False), False),
        T.StructField("hit_to", T.ArrayType(T.IntegerType(), False), False),
        T.StructField("hit_items", T.ArrayType(T.StringType(), False), False),
    ]
)


def words(raw: bytes | None) -> list[bytes]:
    """Normalised words of a text given as UTF-8."""
    return raw.translate(_TABLE).split() if raw else []


@dataclass
class NgramIndex:
    """Windows of a block of items: by length, hash to (words' ids, items)."""

    vocabulary: dict[bytes, int]
    windows: dict[int, dict[int, list[tuple[tuple[int, ...], list[str]]]]]

    @classmethod
    def build(cls, items: list[tuple[str, bytes | None]], width: int = WINDOW) -> NgramIndex:
        vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, raw in items:
            ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(raw)]
            size = min(width, len(ids))
            for at in range(len(ids) - size + 1 if ids else 0):
                found.setdefault(tuple(ids[at : at + size]), set()).add(item)
        windows: dict[int, dict] = {}
        for ids, names in found.items():
            key = int(_hashes(np.array(ids, np.uint64), np.zeros(1, np.int64), len(ids))[0])
            windows.setdefault(len(ids), {}).setdefault(key, []).append((ids, sorted(names)))
        return cls(vocabulary, windows)

    def scan(self, ids: np.ndarray) -> list[tuple[int, int, list[str]]]:
        """(position, length, items) of each verified window; id 0 matches nothing."""
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        out = []
        for size, known in self.windows.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            if not len(at):
                continue
            keys = _hashes(ids, at, size)
            hit = np.isin(keys, np.fromiter(known, np.uint64, len(known)))
            for p, key in zip(at[hit].tolist(), keys[hit].tolist(), strict=True):
                own = tuple(ids[p : p + size].tolist())
                out += [(p, size, names) for window, names in known[key] if window == own]
        return out


def _hashes(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    factors = odd_numbers(size, 5)
    total = np.zeros(len(at), np.uint64)
    for j in range(size):
        total += ids[at + j] * factors[j]
    return total


def hit_runs(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW) -> DataFrame:
    """``docs`` with n_words, the runs of hit words ([hit_from, hit_to), in
    words) and the items found (hit_items, sorted)."""
    items = benchmark.select(
        F.coalesce(plain("item_id").cast("string"), F.lit("")).alias("item"), plain("text").cast("binary").alias("raw")
    ).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0)).alias("b")).first()["b"]
    blocks = max(1, -(-size // INDEX_BYTES))
    numbered = items.withColumn("block", F.pmod(F.xxhash64("item", "raw"), F.lit(blocks)))
    out = docs
    for block in range(blocks):
        part = numbered.where(F.col("block") == block).toArrow()
        index = NgramIndex.build(
            list(zip(part.column("item").to_pylist(), part.column("raw").to_pylist(), strict=True)), width
        )
        out = _scanned(out, index, first=block == 0)
    return out


def _scanned(docs: DataFrame, index: NgramIndex, first: bool) -> DataFrame:
    """One block's hits, united with those of the blocks before."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((index.vocabulary, index.windows))
    fields = HIT_FIELDS
    base = docs if first else docs.withColumnsRenamed({n: f"_{n}" for n in fields.names[1:]})

    def setup():
        ngrams = NgramIndex(*shared.value)
        lookup = ngrams.vocabulary.get

        def step(batch: pa.RecordBatch) -> dict:
            # numbers of a text's words and a gap, one text after the other: the words themselves are not kept
            numbers = [np.fromiter((lookup(w, 0) for w in words(raw)), np.uint64) for raw in raw_texts(batch)]
            sizes = [len(n) for n in numbers]
            starts = np.concatenate([[0], np.cumsum([n + 1 for n in sizes])]).astype(np.int64)
            ids = np.zeros(int(starts[-1]), np.uint64)
            for at, own in zip(starts.tolist(), numbers, strict=False):
                ids[at : at + len(own)] = own
            covered: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[str]] = {}
            for p, size, names in ngrams.scan(ids):
                doc = int(np.searchsorted(starts, p, "right")) - 1
                covered.setdefault(doc, []).append((p - int(starts[doc]), p - int(starts[doc]) + size))
                items.setdefault(doc, set()).update(names)
            if not first:
                for doc, (a, b, names) in enumerate(
                    zip(*(batch.column(f"_{n}").to_pylist() for n in fields.names[1:]), strict=True)
                ):
                    if a:
                        covered.setdefault(doc, []).extend(zip(a, b, strict=True))
                        items.setdefault(doc, set()).update(names)
            runs = [united(covered.get(d, ())) for d in range(batch.num_rows)]
            return {
                "n_words": pa.array(sizes, pa.int64()),
                "hit_from": pa.array([[a for a, _ in r] for r in runs], pa.list_(pa.int32())),
                "hit_to": pa.array([[b for _, b in r] for r in runs], pa.list_(pa.int32())),
                "hit_items": pa.array([sorted(items.get(d, ())) for d in range(batch.num_rows)], pa.list_(pa.string())),
            }

        return step

    out = annotate(base, fields, setup)
    return out if first else out.drop(*[f"_{n}" for n in fields.names[1:]])


def united(spans) -> list[tuple[int, int]]:
    """Sorted disjoint spans with the same union."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def judged(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, share: int = 20) -> DataFrame:
    """``hit_runs`` with n_hit, n_items, items_sha256 and contaminated (a word
    is hit, and at least one in ``share``)."""
    found = hit_runs(docs, benchmark, width)
    n_hit = F.aggregate(F.zip_with("hit_from", "hit_to", lambda a, b: b - a), F.lit(0).cast("int"), lambda s, x: s + x)
    return found.withColumns(
        {
            "n_hit": n_hit.cast("long"),
            "n_items": F.size("hit_items").cast("long"),
            "items_sha256": F.sha2(F.concat_ws(",", "hit_items").cast("binary"), 256),
        }
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, unit: str = "document", width: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents (``unit="document"``), or with the
    hit words cut out of every text (``unit="span"``)."""
    found = judged(docs, benchmark, width)
    if unit == "document":
        return found.where(~F.col("contaminated")).select(*[plain(c) for c in docs.columns])
    if unit != "span":
        raise ValueError(f"unit must be document or span, not {unit!r}")

    def setup():
        def step(batch: pa.RecordBatch) -> dict:
            froms, tos = batch.column("hit_from").to_pylist(), batch.column("hit_to").to_pylist()
            texts = [cut(t, a, b) if a else t for t, a, b in zip(raw_texts(batch), froms, tos, strict=True)]
            return {"_cut": pa.array(texts, pa.binary()).cast(pa.string())}

        return step

    cleaned = annotate(found, T.StructType([T.StructField("_cut", T.StringType())]), setup)
    return cleaned.select(*[plain("_cut").alias("text") if c == "text" else plain(c) for c in docs.columns])


def cut(raw: bytes, froms: list[int], tos: list[int]) -> bytes:
    """The text without the runs of words, first to last byte of each run."""
    at = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
    out, end = [], 0
    for a, b in zip(froms, tos, strict=True):
        out.append(raw[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*out, raw[end:]])


