"""Secret scans by character Markov models, in DataFrame functions only.

Base rules find key assignments, access keys and hex runs with their places.
Two Markov chains of characters, one of strings the base rules found and one of
ordinary words, score every other long token; where the log-likelihood ratio
speaks for a random string, the token is a span of kind ``markov``.

Places come from the pieces between the matches: a match starts where the pieces
and matches before it end. All lengths are in code points.

Cases: a null or empty text has no span; a match that fails its rule is dropped
and not tried again at another place; without found strings to learn from no
span is added; repeated rows are scanned one by one; an empty table gives an
empty table; extra columns stay, those named like a result column are replaced.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampersift.llm.common import plain, ready, store, without

# Kinds in the order that breaks ties, each with its pattern and the least length of its group.
KINDS = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
NAMES = (*KINDS, "markov")
LEAST = 16
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
ORDINARY = r"[A-Za-z0-9_]{6,}"
# The models are fitted on so many distinct strings of each class: found
# strings, and words of the texts that come first by hash.
SAMPLE_STRINGS, SAMPLE_TEXTS = 20_000, 500
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
SYMBOLS = len(LETTERS) + 2  # all others, and the start of a string
# Log-odds a token has to reach, in nats.
THRESHOLD = 8.0
RESULT = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, block: int = 64) -> Column:
    """Running sums of an array, by sums of blocks so that long arrays stay cheap."""
    add = lambda s, x: s + x
    zero = F.lit(0).cast("long")

    def summed(v: Column) -> Column:
        blocks = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")))
        sums = F.transform(blocks, lambda b: F.aggregate(F.slice(v, b * block + 1, F.lit(block)), zero, add))
        before = F.aggregate(sums, F.array(zero), lambda a, s: F.concat(a, F.array(F.element_at(a, -1) + s)))
        return let(
            before,
            lambda b: F.transform(
                v,
                lambda _, i: F.element_at(b, F.floor(i / block).cast("int") + 1)
                + F.aggregate(F.slice(v, F.floor(i / block).cast("int") * block + 1, i % block + 1), zero, add),
            ),
        )

    return F.when(F.size(values) > 0, let(values, summed)).otherwise(F.array().cast("array<bigint>"))


def places(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches
    whose group has at least ``least`` characters."""
    length = lambda x: F.char_length(x).cast("long")
    rule = F.lit(pattern)

    def found(pieces: Column, matches: Column, values: Column) -> Column:
        gaps = F.transform(
            matches, lambda _, i: length(F.get(pieces, i)) + F.coalesce(length(F.get(matches, i - 1)), F.lit(0))
        )
        return let(
            running(gaps),
            lambda starts: F.transform(
                matches,
                lambda m, i: F.struct(
                    F.get(starts, i).alias("start"),
                    (F.get(starts, i) + length(m)).alias("end"),
                    F.get(values, i).alias("value"),
                ),
            ),
        )

    every = let(
        F.split(text, pattern, -1),
        lambda p: let(
            F.regexp_extract_all(text, rule, 0),
            lambda m: let(F.regexp_extract_all(text, rule, group), lambda v: found(p, m, v)) if group else found(p, m, m),
        ),
    )
    long_enough = F.filter(every, lambda s: F.char_length(s["value"]) >= least)
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return F.when(text.rlike(pattern), long_enough).otherwise(nothing)


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with the matches of each kind and the candidates."""
    text = plain("text").cast("string")
    columns = {f"_{k}": places(text, *rule) for k, rule in KINDS.items()}
    return docs.withColumns(columns | {"_candidates": places(text, CANDIDATE)}).drop("text")


def _steps(strings: DataFrame) -> DataFrame:
    """Counts of symbol pairs (was, now) over a column ``value``, the start included."""
    chars = F.split("value", "")
    symbol = lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(LETTERS), c))
    codes = strings.select(F.transform(chars, symbol).alias("codes"))
    pair = F.transform("codes", lambda c, i: F.coalesce(F.get("codes", i - 1), F.lit(SYMBOLS - 1)) * SYMBOLS + c)
    return codes.select(F.explode(pair).alias("pair")).groupBy("pair").count()


def fit(found: DataFrame, texts: DataFrame) -> list[float]:
    """Log-likelihood ratios of symbol pairs, random over ordinary.

    ``found``: the table of ``scanned``; ``texts``: a column text. At most one
    count per pair of symbols comes to the driver.
    """
    every = F.concat(*[F.transform(f"_{k}", lambda s: s["value"]) for k in KINDS])
    labelled = found.select(F.explode(every).alias("value"))
    random = _first_strings(labelled)
    keys = texts.select(F.xxhash64("text").alias("key")).distinct().orderBy("key").limit(SAMPLE_TEXTS)
    chosen = texts.withColumn("key", F.xxhash64("text")).join(F.broadcast(keys), "key", "left_semi").select("text").distinct()
    words = chosen.select(F.explode(F.regexp_extract_all("text", F.lit(ORDINARY), 0)).alias("value"))
    # tokens long enough to be judged do not teach what is ordinary
    short = words.where(F.char_length("value") < LEAST)
    ordinary = _first_strings(short.join(labelled.distinct(), "value", "left_anti"))
    counts = [{r["pair"]: r["count"] for r in _steps(x).collect()} for x in (random, ordinary)]
    if not all(counts):
        return []
    logs = []
    for own in counts:
        rows = [sum(own.get(a * SYMBOLS + b, 0) for b in range(SYMBOLS)) for a in range(SYMBOLS)]
        logs.append([math.log((own.get(p, 0) + 0.5) / (rows[p // SYMBOLS] + 0.5 * SYMBOLS)) for p in range(SYMBOLS**2)])
    return [a - b for a, b in zip(*logs, strict=True)]


def _first_strings(strings: DataFrame) -> DataFrame:
    return strings.distinct().orderBy(F.xxhash64("value"), "value").limit(SAMPLE_STRINGS)


def log_odds(value: Column, ratios: list[float]) -> Column:
    """Log-likelihood ratio of a string, random over ordinary."""
    table = F.from_json(F.lit(json.dumps([round(x, 6) for x in ratios])), "array<double>")
    symbol = lambda c: F.instr(F.lit(LETTERS), c)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(SYMBOLS - 1).alias("was"))

    def step(state: Column, c: Column) -> Column:
        pair = state["was"] * SYMBOLS + symbol(c)
        return F.struct((state["sum"] + F.element_at(table, pair + 1)).alias("sum"), symbol(c).alias("was"))

    return F.aggregate(F.filter(F.split(value, ""), lambda c: c != ""), start, step, lambda s: s["sum"])


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without text, with n_assign, n_access, n_hex, base_sha256, spans
    (kind:start:end, comma-joined) and found (array of kind, start, end)."""
    ready(docs.sparkSession)
    base = without(docs, *RESULT, "found", *[f"_{k}" for k in KINDS], "_candidates")
    stored = store(scanned(base), "secrets")
    ratios = fit(stored, base.where(plain("text").isNotNull()).select(plain("text").cast("string").alias("text")))
    # what stands behind an assignment is found already
    known = F.concat(
        *[_ends(f"_{k}") for k in ("access", "hex")],
        F.transform("_assign", lambda s: F.struct((s["end"] - F.char_length(s["value"])).alias("start"), s["end"].alias("end"))),
    )
    nothing = F.array().cast("array<struct<start:bigint,end:bigint>>")
    unlikely = F.filter("_candidates", lambda s: log_odds(s["value"], ratios) >= threshold) if ratios else None
    added = F.array_except(_ends(unlikely), known) if ratios else nothing
    kinds = {k: _ends(f"_{k}") for k in KINDS} | {"markov": added}
    order = {name: i for i, name in enumerate(NAMES)}

    def tagged(name: str) -> Column:
        number = F.lit(order[name]).alias("kind")
        return F.transform(kinds[name], lambda s: F.struct(s["start"].alias("start"), number, s["end"].alias("end")))

    listed = lambda names: F.array_sort(F.concat(*map(tagged, names)))
    name = lambda s: F.element_at(F.array(*map(F.lit, NAMES)), s["kind"] + 1)
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")
    out = stored.withColumns({f"n_{k}": F.size(f"_{k}").cast("long") for k in KINDS})
    out = out.withColumn("base_sha256", F.sha2(joined(listed(KINDS)).cast("binary"), 256)).withColumn("_all", listed(NAMES))
    out = out.withColumn("spans", joined(F.col("_all"))).withColumn(
        "found", F.transform("_all", lambda s: F.struct(name(s).alias("kind"), s["start"], s["end"]))
    )
    return out.drop("_all", "_candidates", *[f"_{k}" for k in KINDS])


def _ends(spans) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
