"""Quality rules by line sequence labelling.

Every line with a word is described by bucketed features (symbols, capitals,
digits, length, repetition). A linear-chain conditional random field, fitted on
a bounded sample of documents labelled for quality, marks each line as content
or boilerplate by Viterbi decoding. A document is kept if enough of its words
stand in content lines and the base rules do not fail it.

Words are runs of other bytes than ASCII white space. n_repeat_words counts the
words inside 8-word windows that occur twice or more in the text.

Cases: null, empty or wordless text has no words, fails the base rule and is not
kept; without labelled rows, or with one class only, every line is content;
repeated rows are judged one by one; an empty table gives an empty table; extra
columns stay, those named like a result column are replaced.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampersift.llm.common import annotate, odd_numbers, plain, raw_texts, ready

# The field is fitted on so many documents of each label, first by hash, and so
# many lines of each, in runs of RUN from all parts of the document.
SAMPLE_DOCS, SAMPLE_LINES, RUN = 1500, 64, 16
MIN_WORDS, MAX_REPEATED = 20, 30
WINDOW = 8
# Share of the words that has to stand in content lines.
MIN_CONTENT = 0.5

SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
_CAPITALS = bytes(range(0x41, 0x5B))
_DIGITS = bytes(range(0x30, 0x3A))
_ENDS = (b".", b"!", b"?", b":", b";", b'"')

# Upper bounds of the buckets of each feature.
BUCKETS = (
    ("symbols per word", (0.001, 0.25, 0.75)),
    ("share of capitals", (0.2, 0.5, 0.8)),
    ("exclamations per word", (0.001, 0.5)),
    ("share of digits", (0.02, 0.2)),
    ("words", (3, 8, 20)),
    ("equal to an earlier line", (0.5,)),
    ("distinct words", (0.5, 0.8)),
    ("share of words in repeated windows", (0.05, 0.5)),
    ("bytes per word", (3, 8, 14)),
    ("ends a sentence", (0.5,)),
)
_EDGES = [np.array(b, float) for _, b in BUCKETS]
_FIRST = np.cumsum([0, *(len(b) + 1 for _, b in BUCKETS)])
N_FEATURES = int(_FIRST[-1])

FIELDS = T.StructType(
    [
        *(
            T.StructField(n, T.LongType(), False)
            for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_content_lines")
        ),
        T.StructField("content_share", T.DoubleType(), False),
        T.StructField("base_failed", T.BooleanType(), False),
        T.StructField("kept", T.BooleanType(), False),
    ]
)


def without(raw: bytes, drop: bytes) -> int:
    """How many bytes of ``raw`` are in ``drop``."""
    return len(raw) - len(raw.translate(None, drop))


def repeated(words: list[bytes], width: int = WINDOW) -> np.ndarray:
    """Which words lie in a ``width``-word window that occurs twice or more.

    Windows are compared by 64-bit hashes of their words.
    """
    n = len(words) - width + 1
    out = np.zeros(len(words), bool)
    if n < 2:
        return out
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    keys = np.zeros(n, np.uint64)
    for j, factor in enumerate(odd_numbers(width, 3)):
        keys += ids[j : j + n] * factor
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return out
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return np.cumsum(edges[:-1]) > 0


def described(raw: bytes | None) -> tuple[dict, np.ndarray, np.ndarray]:
    """Base figures of a text, (lines x features) active feature numbers, words per line."""
    raw = raw or b""
    lines = [(line, line.split()) for line in raw.split(b"\n")]
    lines = [x for x in lines if x[1]]
    words = [w for _, own in lines for w in own]
    in_repeat = repeated(words)
    sizes = np.array([len(own) for _, own in lines], np.int64)
    ends = np.cumsum(sizes)
    covered = np.concatenate([[0], np.cumsum(in_repeat)])
    seen: set[bytes] = set()
    values = np.empty((len(lines), len(BUCKETS)))
    n_dup = 0
    for i, (line, own) in enumerate(lines):
        n, total = len(own), max(1, sum(map(len, own)))
        duplicate = line in seen
        seen.add(line)
        n_dup += duplicate
        values[i] = (
            without(line, SYMBOLS) / n,
            without(line, _CAPITALS) / total,
            line.count(b"!") / n,
            without(line, _DIGITS) / total,
            n,
            duplicate,
            len(set(own)) / n,
            (covered[ends[i]] - covered[ends[i] - n]) / n,
            total / n,
            own[-1].endswith(_ENDS),
        )
    active = np.empty(values.shape, np.int64)
    for f, bounds in enumerate(_EDGES):
        active[:, f] = np.searchsorted(bounds, values[:, f], "right") + _FIRST[f]
    base = {
        "n_words": len(words),
        "word_chars": len(raw.decode()) - without(raw, _SPACES),
        "n_symbols": without(raw, SYMBOLS),
        "n_dup_lines": n_dup,
        "n_repeat_words": int(in_repeat.sum()),
    }
    return base, active, sizes


class ChainField:
    """A two-label linear-chain conditional random field (1 is content).

    ``weights`` favour content per feature, ``switch[a, b]`` a step from label a
    to b.
    """

    def __init__(self, weights: np.ndarray | None = None, switch: np.ndarray | None = None):
        self.weights = np.zeros(N_FEATURES) if weights is None else weights
        self.switch = np.zeros((2, 2)) if switch is None else switch

    def fit(self, chains: list[np.ndarray], labels: list[int], steps: int = 150, rate: float = 0.3, decay: float = 1e-3):
        """Gradient ascent on the likelihood of chains whose lines share a label."""
        if len(set(labels)) < 2:
            return self
        order = np.argsort([-len(c) for c in chains], kind="stable")
        chains, y = [chains[i] for i in order], np.array(labels)[order]
        sizes = np.array([len(c) for c in chains])
        # both labels weigh the same, whatever their share of the sample
        share = np.where(y == 1, 0.5 / max(1, sizes[y == 1].sum()), 0.5 / max(1, sizes[y == 0].sum()))
        longest, n = int(sizes[0]), len(chains)
        padded = np.zeros((n, longest, len(BUCKETS)), np.int64)
        for i, c in enumerate(chains):
            padded[i, : len(c)] = c
        alive = [int((sizes > t).sum()) for t in range(longest)]
        moment = np.zeros(N_FEATURES + 4)
        for _ in range(steps):
            score = self.weights[padded].sum(axis=2)  # of content; boilerplate has 0
            emit = np.stack([np.zeros_like(score), score], axis=2)
            forward, backward = np.full((n, longest, 2), -np.inf), np.zeros((n, longest, 2))
            forward[:, 0] = emit[:, 0]
            for t in range(1, longest):
                k = alive[t]
                forward[:k, t] = np.logaddexp.reduce(forward[:k, t - 1, :, None] + self.switch, axis=1) + emit[:k, t]
            for t in range(longest - 2, -1, -1):
                k = alive[t + 1]
                after = (emit[:k, t + 1] + backward[:k, t + 1])[:, None, :] + self.switch
                backward[:k, t] = np.logaddexp.reduce(after, axis=2)
            total = np.logaddexp.reduce(forward[np.arange(n), sizes - 1], axis=1)
            gradient, moves = np.zeros(N_FEATURES), np.zeros((2, 2))
            for t in range(longest):
                k = alive[t]
                content = np.exp(forward[:k, t, 1] + backward[:k, t, 1] - total[:k])
                error = ((y[:k] == 1) - content) * share[:k]
                np.add.at(gradient, padded[:k, t].ravel(), np.repeat(error, len(BUCKETS)))
                if t + 1 < longest and alive[t + 1]:
                    k = alive[t + 1]
                    after = emit[:k, t + 1] + backward[:k, t + 1] - total[:k, None]
                    pair = np.exp(forward[:k, t, :, None] + self.switch + after[:, None, :])
                    for label in (0, 1):
                        moves[label, label] += share[:k][y[:k] == label].sum()
                    moves -= (pair * share[:k, None, None]).sum(axis=0)
            gradient = np.concatenate([gradient, moves.ravel()])
            gradient -= decay * np.concatenate([self.weights, self.switch.ravel()])
            moment = 0.9 * moment + gradient
            self.weights = self.weights + rate * moment[:-4]
            self.switch = self.switch + rate * moment[-4:].reshape(2, 2)
        return self

    def decode(self, active: np.ndarray) -> np.ndarray:
        """The likeliest labels of a chain (Viterbi)."""
        score = self.weights[active].sum(axis=1).tolist()
        (bb, bc), (cb, cc) = self.switch.tolist()
        back, boiler, content = [], 0.0, score[0]
        for s in score[1:]:
            from_content = content + cb > boiler + bb, content + cc >= boiler + bc
            back.append(from_content)
            boiler, content = (
                content + cb if from_content[0] else boiler + bb,
                (content + cc if from_content[1] else boiler + bc) + s,
            )
        label = int(content >= boiler)
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return np.array(labels[::-1])


def sampled_runs(active: np.ndarray, raw: bytes) -> list[np.ndarray]:
    """All lines of a document, or of a longer one SAMPLE_LINES in runs: its
    head, its end, and in each equal part between them one placed by a hash."""
    if len(active) <= SAMPLE_LINES:
        return [active]
    number = SAMPLE_LINES // RUN
    edges = np.linspace(RUN, len(active) - RUN, number - 1).astype(int)
    key = zlib.crc32(raw)
    places = [0, len(active) - RUN]
    places += [int(a + (key * (i + 1)) % max(1, b - a - RUN + 1)) for i, (a, b) in enumerate(itertools.pairwise(edges))]
    return [active[p : p + RUN] for p in sorted(places)]


def fit(docs: DataFrame, labels: DataFrame) -> ChainField:
    """A field fitted on the bounded sample of ``labels`` (doc_id, quality) and
    the texts of ``docs``. The sample is chosen from the labels, so no text moves."""
    ready(docs.sparkSession)
    rows = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", plain("quality").cast("int").alias("quality"))
    chosen = rows.distinct().orderBy(F.xxhash64("doc_id"))
    chosen = chosen.where("quality = 0").limit(SAMPLE_DOCS).union(chosen.where("quality = 1").limit(SAMPLE_DOCS))
    sample = docs.where(plain("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches):
        for batch in batches:
            quality, found = [], []
            for label, raw in zip(batch.column("quality").to_pylist(), raw_texts(batch), strict=True):
                parts = sampled_runs(described(raw)[1], raw)
                quality += [label] * len(parts)
                found += [p.tolist() for p in parts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(quality, pa.int32()), pa.array(found, pa.list_(pa.list_(pa.int64())))], names=["quality", "chain"]
            )

    got = sample.mapInArrow(run, "quality int, chain array<array<bigint>>").toArrow()
    pairs = sorted(zip(got.column("quality").to_pylist(), got.column("chain").to_pylist(), strict=True), key=repr)
    pairs = [(q, np.array(c, np.int64)) for q, c in pairs if c and q in (0, 1)]
    return ChainField().fit([c for _, c in pairs], [q for q, _ in pairs])


def judge(docs: DataFrame, field: ChainField, min_content: float = MIN_CONTENT) -> DataFrame:
    """``docs`` with the base figures, the lines, the share of words in content
    lines, base_failed and kept."""
    ready(docs.sparkSession)
    weights, switch = field.weights, field.switch

    def setup():
        chain = ChainField(weights, switch)

        def step(batch: pa.RecordBatch) -> dict:
            out = {n: [] for n in FIELDS.names}
            for raw in raw_texts(batch):
                base, active, sizes = described(raw)
                content = chain.decode(active) if len(active) else np.zeros(0, int)
                share = float((sizes * content).sum() / max(1, sizes.sum()))
                n = base["n_words"]
                failed = n < MIN_WORDS or 100 * base["n_repeat_words"] > MAX_REPEATED * n
                base |= {
                    "n_lines": len(active),
                    "n_content_lines": int(content.sum()),
                    "content_share": share,
                    "base_failed": failed,
                    "kept": not failed and share >= min_content,
                }
                for k, v in base.items():
                    out[k].append(v)
            return {f.name: pa.array(out[f.name], _arrow(f.dataType)) for f in FIELDS}

        return step

    return annotate(docs, FIELDS, setup)


def _arrow(kind: T.DataType) -> pa.DataType:
    return {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_()}[kind]
