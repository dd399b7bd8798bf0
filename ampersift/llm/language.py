"""Language ID by cross-parsing entropy.

A suffix automaton of labelled text is built per language. A text is parsed
into the longest phrases that occur in a language's labelled text, one after
the other; the language that needs the fewest phrases per character wins.

Texts are lower-cased and every run of other characters than letters becomes
one space. They are parsed in blocks of ``BLOCK`` characters (a phrase ends at
a block border, for all languages alike), so that numpy walks the automata of
all languages over many blocks at once and a long text is no long task.

Cases: null text or text without a letter is ``und`` with score 0; equal phrase
counts go to the language that sorts first, score 0; a labelled text that is
null or without letters teaches nothing; without labelled rows every text is
``und``; repeated rows are judged one by one; extra columns stay, those named
like a result column are replaced.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampersift.llm.common import annotate, once, plain, ready

# The classifier is fitted on a bounded sample: of each language the labelled
# rows that come first by a hash of their text, and so many letters of
# them, in equal shares as far as the rows have them.
SAMPLE_ROWS, SAMPLE_CHARS = 200, 60_000
# All languages together; with more languages each has a smaller share.
MODEL_CHARS = 240_000
# The commonest letters of the sample have a column of the dense table, the others a sorted list.
ALPHABET = 62
BLOCK = 512
UNKNOWN = "und"

FIELDS = T.StructType([T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])


_GAP = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """Lower-case words of letters, one space between."""
    if not text:
        return ""
    words = " ".join(_GAP.split(text.lower())).strip()
    if not words or words.replace(" ", "").isalpha():
        return words
    # numbers such as ½ or Ⅷ are word characters but no letters
    return " ".join("".join(c if c.isalpha() else " " for c in words).split())


def automaton(text: np.ndarray, symbols: int, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transitions of the suffix automaton of ``text``: dense for the first
    ``symbols``; of the others, up to ``every``, (state, symbol, entry) and the
    entry where no phrase goes on.

    Entry [state * symbols + c] is (next state * symbols) << 1. Where no phrase
    goes on, it is the state after c alone with the low bit set: a new phrase. The
    last state, behind a character that the text lacks, goes on with none.
    """
    move: list[dict[int, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for c in text.tolist():
        state = len(move)
        move.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in move[p]:
            move[p][c] = state
            p = link[p]
        if p >= 0:
            q = move[p][c]
            if size[q] == size[p] + 1:
                link[state] = q
            else:
                split = len(move)
                move.append(dict(move[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and move[p].get(c) == q:
                    move[p][c] = split
                    p = link[p]
                link[q] = link[state] = split
        last = state
    fresh = np.array([move[0].get(c, len(move)) for c in range(every)], np.int32) * symbols * 2 + 1
    table = np.tile(fresh[:symbols], (len(move) + 1, 1))
    others = []
    for state, nexts in enumerate(move):
        for c, to in nexts.items():
            if c < symbols:
                table[state, c] = to * symbols * 2
            else:
                others.append((state, c, to * symbols * 2))
    return table.ravel(), np.array(others, np.int64).reshape(-1, 3), fresh[symbols:]


class Model:
    """Automata of all languages in one table, with the symbols of the letters."""

    def __init__(self, samples: list[tuple[str, str]]):
        self.langs = [lang for lang, _ in samples]
        counts: dict[str, int] = {}
        for _, text in samples:
            for ch in set(text):
                counts[ch] = counts.get(ch, 0) + text.count(ch)
        ranked = [ord(ch) for ch in sorted(counts, key=lambda ch: (-counts[ch], ch))]
        self.symbols = min(len(ranked), ALPHABET) + 1
        self.codes, rank = np.unique(np.array(ranked, np.uint32), return_index=True)
        self.number = (rank + 1).astype(np.int32)  # commonest first
        parts = [automaton(self.encode(text), self.symbols, len(ranked) + 1) for _, text in samples]
        tables = [t for t, _, _ in parts]
        starts = np.cumsum([0, *(len(t) for t in tables[:-1])])
        ends = starts + np.array([len(t) - self.symbols for t in tables])
        self.starts = np.array(ends, np.int32)  # a block starts a phrase
        self.table = np.concatenate([t + np.int32(2 * s) for t, s in zip(tables, starts, strict=True)])
        self.rare = len(ranked) + 1 - self.symbols
        self.fresh = np.stack([f + 2 * s for (_, _, f), s in zip(parts, starts, strict=True)], axis=1)  # (rare, languages)
        others = [np.stack([self._key(o[:, 0] + s // self.symbols, o[:, 1]), o[:, 2] + 2 * s]) for (_, o, _), s in zip(parts, starts, strict=True)]
        joined = np.concatenate(others, axis=1)
        self.others = joined[:, np.argsort(joined[0])]

    def _key(self, row: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Of a transition by a rare symbol."""
        return row.astype(np.int64) * max(1, self.rare) + symbol - self.symbols

    def moves(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Entries behind the states (texts x languages) by the texts' symbols."""
        common = symbol < self.symbols
        if common.all():
            return self.table[state + symbol[:, None]]
        out = self.table[state + np.where(common, symbol, 0)[:, None]]
        at = np.flatnonzero(~common)
        wanted = self._key(state[at] // self.symbols, symbol[at][:, None])
        spot = np.minimum(np.searchsorted(self.others[0], wanted), self.others.shape[1] - 1)
        known = self.others[0][spot] == wanted
        out[at] = np.where(known, self.others[1][spot], self.fresh[symbol[at] - self.symbols])
        return out

    def encode(self, text: str) -> np.ndarray:
        """Symbols of a text; letters that no sample has share symbol 0."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.codes, points)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == points, self.number[at], 0).astype(np.int32)

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases needed, by text and language."""
        sizes = np.array([len(t) for t in texts], np.int64)
        blocks = -(-sizes // BLOCK)
        flat = self.encode("".join(texts))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(texts)), blocks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = starts[owner] + number * BLOCK
        length = np.minimum(starts[owner + 1] - begin, BLOCK)
        order = np.argsort(-length, kind="stable")  # blocks that end drop off at the tail
        begin, length, owner = begin[order], length[order], owner[order]
        alive = np.searchsorted(-length, -np.arange(BLOCK), "left")
        total = np.zeros((len(order), len(self.langs)), np.int32)
        state = np.tile(self.starts, (len(order), 1))
        for step in range(int(length[0]) if len(length) else 0):
            n = int(alive[step])
            move = self.moves(state[:n], flat[begin[:n] + step])
            total[:n] += move & 1
            state[:n] = move >> 1
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        np.add.at(out, owner, total)
        return out

    def judge(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text: one less the ratio of the fewest
        phrases to the second fewest."""
        counts = self.phrases(texts)
        best = counts.argmin(axis=1)
        ranked = np.sort(counts, axis=1)
        scores = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1) if ranked.shape[1] > 1 else np.ones(len(texts))
        empty = [not t for t in texts]
        return (
            [UNKNOWN if e else self.langs[b] for e, b in zip(empty, best.tolist(), strict=True)],
            [0.0 if e else s for e, s in zip(empty, scores.tolist(), strict=True)],
        )


def labelled_sample(labelled: DataFrame, text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """(language, normalised text) of the bounded sample, sorted by language.

    Texts are chosen by their hashes alone, equal texts once; the row limit per
    language prunes in every task before the shuffle.
    """
    rows = labelled.select(plain(lang).alias("lang"), plain(text).alias("text")).where(
        "lang IS NOT NULL AND text RLIKE '\\\\p{L}'"
    )
    hashed = rows.withColumn("key", F.xxhash64("text"))
    first = Window.partitionBy("lang").orderBy("key")
    keys = hashed.select("lang", "key").distinct().withColumn("place", F.row_number().over(first))
    chosen = keys.where(F.col("place") <= SAMPLE_ROWS)
    # the middle of a long labelled text stands for it
    start = F.greatest(F.lit(1), (F.char_length("text") / 2).cast("int") - SAMPLE_CHARS // 2)
    middle = F.substring(F.col("text"), start, F.lit(SAMPLE_CHARS)).alias("text")
    found = hashed.join(F.broadcast(chosen.drop("place")), ["lang", "key"]).select("lang", "key", middle)
    held: dict[str, list[str]] = {}
    for row in found.groupBy("lang", "key").agg(F.min("text").alias("text")).orderBy("lang", "key").collect():
        held.setdefault(row["lang"], []).append(letters(row["text"]))
    share = min(SAMPLE_CHARS, MODEL_CHARS // max(1, len(held)))
    return [(k, shared_out(v, share)) for k, v in sorted(held.items())]


def shared_out(texts: list[str], size: int) -> str:
    """``size`` letters at most, in equal shares of the texts; what short ones leave goes to the others."""
    texts = [t for t in texts if t]
    left, take = size - len(texts) + 1, [0] * len(texts)
    for done, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        take[i] = min(len(texts[i]), max(0, left) // (len(texts) - done))
        left -= take[i]
    return " ".join(t[:n] for t, n in zip(texts, take, strict=True) if n)


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """``docs`` with lang_pred and score, learned from ``labelled`` (text, lang)."""
    spark = ready(docs.sparkSession)
    samples = labelled_sample(labelled)
    key = hashlib.sha256(repr(samples).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(samples)

    def setup():
        model = once(("language", key), lambda: Model(shared.value)) if shared.value else None

        def step(batch: pa.RecordBatch) -> dict:
            texts = [letters(t) for t in batch.column("text").to_pylist()]
            found = model.judge(texts) if model else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            return {"lang_pred": pa.array(found[0], pa.string()), "score": pa.array(found[1], pa.float64())}

        return step

    return annotate(docs.withColumn("text", plain("text").cast("string")), FIELDS, setup)
