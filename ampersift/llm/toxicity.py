"""Toxicity by compression distance.

Two zstandard dictionaries are trained on a bounded sample of labelled texts.
The ordinary one holds what recurs in ordinary texts. The toxic one adds what
recurs in toxic texts only, the words that begin with a stem found in far more
toxic than ordinary texts, so that ordinary language costs the same under either
and toxic language less under the second. A text is cut into overlapping windows of WINDOW words. What a window is
shorter with the toxic dictionary than with the ordinary one is its gain; the
gains of all windows of the whole text are summed up in a few figures, and a
logistic threshold, calibrated on rows of the sample that the dictionaries did
not see and weighted to the share of toxic rows among all labels, makes a
probability of them.

Cases: a null or empty text has no window and gets the score of a text without
gains, as has one of white space; a text of any length is scored whole, SLICE
windows at a time, and one without spaces in windows of LONGEST bytes; rows of
the sample tie by hash, then id; several labels of one id count as toxic if one
is; repeated rows are scored one by one. Without labelled rows of both classes
every score is the smoothed share of toxic labels (0 without any). An empty table
gives an empty table; extra columns stay, those named like a result column are
replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampersift.llm.common import annotate, plain, raw_texts, ready

# The dictionaries and the threshold are fitted on so many labelled rows of each
# class, first by hash; of a longer text on one piece, placed by a hash.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 8192
# Every fourth row of the sample calibrates, the others train.
HELD = 4
TRUNK_BYTES, TAIL_BYTES = 16 << 10, 1 << 10
# From level 5 on every place of a dictionary is looked up, below every third.
LEVEL = 6
# Bytes that stand before and behind each window.
LEAD, END = 40, 12
# Words in a window, and from one window to the next; bytes of a longer one.
WINDOW, STEP, LONGEST = 8, 4, 128
SLICE = 1 << 15
# A stem: its bytes, the toxic texts that have it, and how much oftener they do.
STEM_BYTES, STEM_TEXTS, STEM_RATIO, STEM_Z = range(4, 13), 4, 10.0, 6.0
THRESHOLD = 0.3

FIELDS = T.StructType(
    [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("n_windows", T.LongType())]
)

_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))
_POINTS = b".,;:!?()\"'#*$%&|<>"
_EXTRA = 1024  # head of a trained dictionary: entropy tables, no content


def windows(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the windows of a text."""
    octets = np.frombuffer(raw, np.uint8)
    ink = octets > 32
    starts = np.flatnonzero(ink & np.concatenate([[True], ~ink[:-1]])) if len(octets) else np.zeros(0, int)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    units = starts[::STEP]
    sizes = np.diff(np.append(units, len(raw)))
    parts = -(-sizes // LONGEST)  # units of very long words are cut
    within = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    units = np.repeat(units, parts) + within * LONGEST
    ends = np.append(units[WINDOW // STEP :], [len(raw)] * (WINDOW // STEP))[: len(units)]
    return units, ends - units


def dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    """The content of a dictionary trained on samples."""
    if sum(map(len, samples)) < 16 * size:
        samples = samples * (1 + 16 * size // max(1, sum(map(len, samples))))
    try:
        trained = zstandard.train_dictionary(size + _EXTRA, samples, k=segment, d=6).as_bytes()
    except zstandard.ZstdError:  # too few different samples to train on: they are the dictionary
        trained = b" ".join(dict.fromkeys(samples))
    return trained[-size:]


def stems(texts: list[bytes]) -> Counter:
    """In how many texts a word begins with a stem."""
    found: Counter = Counter()
    for raw in texts:
        words = {w for w in raw.split()}
        found.update({w[:n] for w in words for n in STEM_BYTES if len(w) >= n})
    return found


def marking(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Stems that mark toxic texts, the most telling first; of those that begin
    with each other only the first."""
    ours, theirs = stems(toxic), stems(ordinary)
    n, m = max(1, len(toxic)), max(1, len(ordinary))
    ranked = []
    for stem, k in ours.items():
        p, q = k / n, (theirs[stem] + 0.5) / m
        pooled = (k + theirs[stem] + 0.5) / (n + m)
        z = (p - q) / max(1e-9, (pooled * (1 - pooled) * (1 / n + 1 / m))) ** 0.5 if pooled < 1 else 0.0
        if k >= STEM_TEXTS and p >= STEM_RATIO * q and z >= STEM_Z:
            ranked.append((-z, -len(stem), stem))
    chosen: list[bytes] = []
    taken: set[bytes] = set()
    for _, _, stem in sorted(ranked):
        heads = {stem[:i] for i in range(STEM_BYTES[0], len(stem) + 1)}
        if stem not in taken and not heads & set(chosen):
            chosen.append(stem)
            taken |= heads
    return chosen


def marked_words(texts: list[bytes], marks: list[bytes], size: int) -> bytes:
    """The marks, and the words of the texts that begin with one: ``size`` bytes
    of them at most, those of most texts last, where a reference is shortest."""
    held = set(marks)
    found: Counter = Counter()
    for raw in texts:
        hit = {w.strip(_POINTS) for w in set(raw.split()) if any(w[:n] in held for n in STEM_BYTES)}
        found.update(hit | {w[:n] for w in hit for n in STEM_BYTES if w[:n] in held})
    content = b" "
    for word in sorted(found, key=lambda w: (-found[w], w)):
        if b" " + word not in content and len(content) + len(word) < size:
            content = b" " + word + content
    return content


class Compressors:
    """Window lengths under the ordinary and the toxic dictionary."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        plain_frame = {"write_content_size": False, "write_checksum": False, "write_dict_id": False, "format": zstandard.FORMAT_ZSTD1_MAGICLESS}
        settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, **plain_frame)
        self.lead, self.end = ordinary[-LEAD:], ordinary[-END:]
        self.pair = []
        for content in (ordinary, toxic):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.pair.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=held))

    def gains(self, raw: bytes) -> np.ndarray:
        """Bytes that each window of a text saves with the toxic dictionary."""
        starts, lengths = windows(raw)
        octets, out = np.frombuffer(raw, np.uint8), []
        for at in range(0, len(starts), SLICE):
            first, sizes = starts[at : at + SLICE], lengths[at : at + SLICE]
            held, spans = self._framed(octets, first, sizes)
            cost = []
            for compressor in self.pair:
                frames = compressor.multi_compress_to_buffer(zstandard.BufferWithSegments(held, spans), threads=1)
                cost.append(np.fromiter((len(frames[i]) for i in range(len(frames))), np.int64, len(frames)))
            out.append(cost[0] - cost[1])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _framed(self, octets: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[bytes, bytes]:
        """The windows between a lead and an end that both dictionaries hold, and
        their places. A frame that saves next to nothing would be stored as it
        is, and the last bytes of one are never looked up."""
        lead, end = len(self.lead), len(self.end)
        total = sizes + lead + end
        begin = np.cumsum(total) - total
        held = np.empty(int(total.sum()), np.uint8)
        inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        held[inner + np.repeat(begin + lead, sizes)] = octets[inner + np.repeat(first, sizes)]
        held[(begin[:, None] + np.arange(lead)).ravel()] = np.tile(np.frombuffer(self.lead, np.uint8), len(first))
        held[((begin + lead + sizes)[:, None] + np.arange(end)).ravel()] = np.tile(np.frombuffer(self.end, np.uint8), len(first))
        return held.tobytes(), np.stack([begin, total], axis=1).astype(np.uint64).tobytes()


def figures(gains: np.ndarray) -> list[float]:
    """What the threshold looks at."""
    if not len(gains):
        return [0.0] * 6
    top = np.sort(gains)[::-1][:4]
    return [
        float(top[0]),
        float(top.mean()),
        float(np.maximum(gains, 0).mean()),
        float((gains >= 2).mean()),
        float(np.log1p((gains >= 2).sum())),
        float(np.log1p((gains >= 4).sum())),
    ]


class Logistic:
    """Weighted logistic regression with a small ridge, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = self._columns(x)
        penalty = np.diag([ridge] * x.shape[1] + [1e-6])
        self.beta = np.zeros(z.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            slope = z.T @ (weight * (p - y)) + penalty @ self.beta
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + penalty, slope)
            self.beta = self.beta - step
            if abs(step).max() < 1e-8:
                break

    def _columns(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.scale, -20, 20), np.ones((len(x), 1))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._columns(x) @ self.beta, -30, 30)))


class Model:
    """Both dictionaries and the calibrated threshold."""

    def __init__(self, sample: list[tuple[int, bytes]], share: float):
        """``share``: of toxic rows among all labelled ones."""
        self.share, self.threshold = share, None
        parts = {k: [t.translate(_LOWER) for y, t in sample if y == k] for k in (0, 1)}
        train = {k: [t for i, t in enumerate(v) if i % HELD] for k, v in parts.items()}
        held = {k: [t for i, t in enumerate(v) if not i % HELD] for k, v in parts.items()}
        if not (train[0] and train[1] and held[0] and held[1]):
            return
        pieces = {k: [t[i : i + 400] for t in v for i in range(0, len(t), 400)] for k, v in train.items()}
        if not (any(pieces[0]) and any(pieces[1])):
            return
        marks = marking(train[1], train[0])
        end = marked_words(train[1], marks, TAIL_BYTES) if marks else dictionary(pieces[1], TAIL_BYTES, 16)
        self.ordinary = dictionary(pieces[0], TRUNK_BYTES, 64)
        self.toxic = self.ordinary + end
        pair = Compressors(self.ordinary, self.toxic)
        rows = [(k, figures(pair.gains(t))) for k in (0, 1) for t in held[k]]
        y = np.array([k for k, _ in rows], float)
        weight = np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum()) * len(y)
        self.threshold = Logistic(np.array([f for _, f in rows]), y, weight)

    def scorer(self):
        """The function from a text to (score, windows)."""
        if self.threshold is None:
            return lambda raw: (self.share, len(windows(raw)[0]))
        pair = Compressors(self.ordinary, self.toxic)

        def score(raw: bytes) -> tuple[float, int]:
            gains = pair.gains(raw.translate(_LOWER))
            return float(self.threshold(np.array([figures(gains)]))[0]), len(gains)

        return score


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of the bounded sample of ``labels`` (doc_id, toxic) and the texts
    of ``docs``. Rows are chosen from the labels; only the pieces of the chosen
    texts move."""
    ready(docs.sparkSession)
    rows = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", plain("toxic").cast("int").alias("toxic"))
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return Model([], 0.0)
    share = (counts.get(1, 0) + 0.5) / (total + 1)
    order: list[Column] = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = rows.where("toxic = 0").orderBy(*order).limit(SAMPLE_ROWS).union(rows.where("toxic = 1").orderBy(*order).limit(SAMPLE_ROWS))
    texts = docs.where(plain("text").isNotNull()).select("doc_id", plain("text").cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id").withColumn("key", F.xxhash64("doc_id", "text"))
    # an id may have many rows: the bound holds for rows, before any text is read out
    first = Window.partitionBy("toxic").orderBy("key", "doc_id")
    narrow = joined.select("toxic", "key", "doc_id").distinct().withColumn("place", F.row_number().over(first))
    kept = narrow.where(F.col("place") <= SAMPLE_ROWS).drop("place", "toxic")
    size = F.octet_length("text")
    start = 1 + F.pmod(F.col("key"), F.greatest(F.lit(1), size - SAMPLE_BYTES + 1))
    piece = F.substring(F.col("text").cast("binary"), start.cast("int"), F.lit(SAMPLE_BYTES))
    found = joined.join(F.broadcast(kept), ["key", "doc_id"]).select("toxic", "key", "doc_id", piece.alias("piece"))
    found = found.groupBy("toxic", "key", "doc_id").agg(F.min("piece").alias("piece")).toArrow()
    held = zip(found.column("key").to_pylist(), found.column("toxic").to_pylist(), found.column("piece").to_pylist(), strict=True)
    return Model([(y, bytes(t)) for _, y, t in sorted(held)], share)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score, predicted and n_windows."""
    ready(docs.sparkSession)

    def setup():
        judge = model.scorer()

        def step(batch: pa.RecordBatch) -> dict:
            found = [judge(raw or b"") for raw in raw_texts(batch)]
            scores = [s for s, _ in found]
            return {
                "score": pa.array(scores, pa.float64()),
                "predicted": pa.array([int(s >= threshold) for s in scores], pa.int32()),
                "n_windows": pa.array([n for _, n in found], pa.int64()),
            }

        return step

    return annotate(docs.withColumn("text", plain("text").cast("string")), FIELDS, setup)
