"""Personal data by weak supervision.

Base rules find emails, IP addresses, card and phone numbers. Beside them stand
candidate spans: other long digit groups and address-like tokens. On every
candidate labelers vote: regex labelers (form, checksum, length), gazetteer
labelers (words such as phone or card before the span) and context labelers
(what touches the span). Expectation-maximisation over the counts of equal vote
patterns estimates how reliable each labeler is, and a logistic span classifier
is trained on the patterns' posterior. Candidates it accepts are added as kind
``other``; base spans always stay.

Cases: a null or empty text has no span; a match that fails its rule is dropped
and not tried again at another place; without candidates nothing is trained and
nothing added; repeated rows are judged one by one; an empty table gives an
empty table; extra columns stay, those named like a result column are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampersift.llm.common import annotate, plain, ready, store, without

KINDS = ("email", "ip", "card", "phone")
NAMES = (*KINDS, "other")
RESULT = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can start at the head of a digit run only: from inside it, the rest would match alike.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
# Candidates beside the base: digit groups of 7 digits or more, and tokens with an at sign.
_NUMBER = re.compile(r"(?<![0-9A-Za-z])\(?[0-9](?:[\x20().\x2F-]{0,2}[0-9]){6,}(?![0-9A-Za-z])")
_AT = re.compile(r"[^\s@<>()\[\],;:\"]{1,64}(?:@|\x20?[\[(]at[\])]\x20?)[^\s@<>()\[\],;:\"]{2,255}")

# Words that announce personal data, and words that announce other numbers.
PERSONAL_WORDS = re.compile(
    r"(?i)\b(?:phone|tel|telefon|teléfono|téléphone|mobile|call|fax|contact|kontakt|mail|e-mail|email|correo|card|"
    r"carte|karte|tarjeta|visa|iban|account|konto|compte|cuenta|ssn|passport)\b"
)
OTHER_WORDS = re.compile(r"(?i)\b(?:version|page|seite|isbn|id|no|nr|number|order|total|eur|usd|token|sha|commit)\b")
CONTEXT = 32

LABELERS = ("base", "checksum", "length", "grouped", "announced", "bounded", "other word", "inside token")
SPAN = T.StructType(
    [
        T.StructField("kind", T.IntegerType(), False),
        T.StructField("start", T.IntegerType(), False),
        T.StructField("end", T.IntegerType(), False),
        T.StructField("votes", T.IntegerType(), False),
    ]
)
SPANS = T.StructType([T.StructField("_spans", T.ArrayType(SPAN, False), False)])


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses. Found from each at sign, so that long
    runs without one cost nothing."""
    out, last = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            last = domain.end()
        else:
            last = at + 1
        at = text.find("@", last)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def digits_of(value: str) -> str:
    return "".join(c for c in value if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the base rules, in order of kind and place."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = digits_of(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(digits_of(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def votes(text: str, kind: int, start: int, end: int) -> int:
    """The labelers' votes on a span, one bit each."""
    value, before = text[start:end], text[max(0, start - CONTEXT) : start]
    digits = digits_of(value)
    after = text[end : end + 1]
    touches = text[start - 1 : start]
    bits = (
        kind < len(KINDS),
        16 <= len(digits) <= 19 and luhn(digits),
        8 <= len(digits) <= 19 or "@" in value,
        any(c in value for c in " ().-+@"),
        bool(PERSONAL_WORDS.search(before)),
        not (touches.isalnum() or after.isalnum()),
        bool(OTHER_WORDS.search(before)),
        touches in {'"', "'", "=", "/", "_", "#"} and touches != "",
    )
    return sum(1 << i for i, b in enumerate(bits) if b)


def spans_of(text: str) -> list[tuple[int, int, int, int]]:
    """Base spans and candidates that touch none of them, each with its votes."""
    if not _ANY.search(text):
        return []
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    more = sorted({m.span() for rule in (_NUMBER, _AT) for m in rule.finditer(text)})
    free, i, last = [], 0, 0
    for a, b in more:
        while i < len(taken) and taken[i][1] <= a:
            last = max(last, taken[i][1])
            i += 1
        if a >= last and (i == len(taken) or taken[i][0] >= b):
            free.append((len(KINDS), a, b))
            last = max(last, b)
    return [(k, a, b, votes(text, k, a, b)) for k, a, b in [*base, *free]]


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with the array _spans."""

    def setup():
        kind = pa.list_(pa.struct([(f.name, pa.int32()) for f in SPAN]))

        def step(batch: pa.RecordBatch) -> dict:
            rows = [
                [dict(zip(SPAN.names, s, strict=True)) for s in spans_of(t)] if t else [] for t in batch.column("text").to_pylist()
            ]
            return {"_spans": pa.array(rows, kind)}

        return step

    return annotate(docs.withColumn("text", plain("text").cast("string")), SPANS, setup).drop("text")


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each vote pattern, per-class vote rates) by expectation-maximisation.

    ``patterns``: (patterns x labelers) of 0 and 1. Labelers vote independently
    given the class; the first, the base rules, starts as the trusted one.
    """
    post = np.clip(0.15 + 0.8 * patterns[:, 0] + 0.1 * patterns[:, 4] - 0.1 * patterns[:, 6], 0.02, 0.98)
    rates = np.full((2, patterns.shape[1]), 0.5)
    for _ in range(rounds):
        prior = np.clip((post * counts).sum() / counts.sum(), 1e-6, 1 - 1e-6)
        for c, weight in enumerate(((1 - post) * counts, post * counts)):
            rates[c] = (weight @ patterns + 1) / (weight.sum() + 2)
        odds = np.log(prior / (1 - prior)) + (
            patterns * np.log(rates[1] / rates[0]) + (1 - patterns) * np.log((1 - rates[1]) / (1 - rates[0]))
        ).sum(axis=1)
        fresh = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        if np.abs(fresh - post).max() < 1e-9:
            break
        post = fresh
    return post, rates


def train(patterns: np.ndarray, counts: np.ndarray, post: np.ndarray, rounds: int = 500) -> np.ndarray:
    """Weights of the span classifier, intercept last: a logistic regression of
    the posterior on all votes but the base rules' own."""
    x = np.column_stack([patterns[:, 1:], np.ones(len(patterns))])
    w = np.zeros(x.shape[1])
    share = counts / counts.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        curve = x.T @ (x * (share * p * (1 - p))[:, None]) + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(curve, x.T @ (share * (post - p)) - 1e-3 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def accepted_patterns(stored: DataFrame, threshold: float) -> list[int]:
    """Vote patterns of candidates that the trained classifier takes for personal
    data. At most one count per pattern (two to the number of labelers) comes to
    the driver."""
    rows = stored.select(F.explode("_spans.votes").alias("votes")).groupBy("votes").count().orderBy("votes").collect()
    if not rows:
        return []
    numbers = np.array([r["votes"] for r in rows])
    counts = np.array([r["count"] for r in rows], float)
    patterns = (numbers[:, None] >> np.arange(len(LABELERS)) & 1).astype(float)
    post, _ = reliabilities(patterns, counts)
    weights = train(patterns, counts, post)
    every = np.arange(1 << len(LABELERS))
    bits = (every[:, None] >> np.arange(len(LABELERS)) & 1).astype(float)
    score = np.column_stack([bits[:, 1:], np.ones(len(every))]) @ weights
    return every[score >= np.log(threshold / (1 - threshold))].tolist()


def find_personal(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without text, with n_email, n_ip, n_card, n_phone, base_sha256,
    spans (kind:start:end by kind and start, comma-joined) and found (array of
    kind, start, end)."""
    ready(docs.sparkSession)
    stored = store(candidates(without(docs, *RESULT, "_spans")), "personal")
    accepted = accepted_patterns(stored, threshold)
    other = len(KINDS)
    takes = F.from_json(F.lit(str(accepted)), "array<int>")
    chosen = F.filter("_spans", lambda s: (s["kind"] < other) | F.array_contains(takes, s["votes"]))
    sort = lambda c: F.array_sort(F.transform(c, lambda s: F.struct(s["kind"], s["start"], s["end"])))
    names = F.array(*map(F.lit, NAMES))
    name = lambda s: F.element_at(names, s["kind"] + 1)
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")
    number = lambda i: F.size(F.filter("_spans", lambda s: s["kind"] == i)).cast("long")
    out = stored.withColumn("_all", sort(chosen))
    base = F.filter("_all", lambda s: s["kind"] < other)
    return out.withColumns(
        {f"n_{k}": number(i) for i, k in enumerate(KINDS)}
        | {
            "base_sha256": F.sha2(joined(base).cast("binary"), 256),
            "spans": joined(F.col("_all")),
            "found": F.transform("_all", lambda s: F.struct(name(s).alias("kind"), s["start"], s["end"])),
        }
    ).drop("_all", "_spans")


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each span (kind, start, end) replaced by its kind in
    brackets; a span that overlaps an earlier one is part of it."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["kind"])))
    begin = F.struct(F.lit("").alias("done"), F.lit(0).cast("int").alias("at"))

    def step(state: Column, s: Column) -> Column:
        free = s["start"] >= state["at"]
        piece = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        label = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(
            F.when(free, F.concat(state["done"], piece, label)).otherwise(state["done"]).alias("done"),
            F.greatest(state["at"], s["end"]).alias("at"),
        )

    rest = lambda state: F.concat(state["done"], F.substring(text, state["at"] + 1, F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(order, begin, step, rest)).otherwise(text)


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind."""
    inner = without(docs, *RESULT, "_kept_text").withColumn("_kept_text", plain("text").cast("string"))
    found = find_personal(inner, threshold)
    text = masked(F.col("_kept_text"), F.col("found"))
    return found.select(*[text.alias("text") if c == "text" else plain(c) for c in docs.columns])
