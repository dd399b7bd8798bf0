"""Screening of questions and answers: injection, personal data, moderation."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampersift.functions.columns import any_of, as_col, computed_once, quoted
from ampersift.operators.text import is_blank

# Phrases that mark an injection attempt, in reporting order.
INJECTION_PATTERNS = (
    r"ignore.*previous.*instructions?",
    r"ignore.*above.*instructions?",
    r"ignore.*all.*instructions?",
    r"disregard.*previous.*instructions?",
    r"disregard.*above.*instructions?",
    r"disregard.*all.*instructions?",
    r"forget.*everything",
    r"forget.*all",
    r"override.*safety",
    r"override.*security",
    r"override.*rules?",
    r"you are now",
    r"pretend you are",
    r"pretend to be",
    r"act as if",
    r"act as a.*admin",
    r"act as a.*developer",
    r"act as a.*root",
    r"become a.*admin",
    r"switch to.*mode",
    r"enter.*mode",
    r"\[SYSTEM\]",
    r"\[INST\]",
    r"\[/INST\]",
    r"SYSTEM:",
    r"ASSISTANT:",
    r"DAN mode",
    r"Developer Mode",
    r"jailbreak",
    r"bypass.*filter",
    r"bypass.*safety",
    r"unrestricted mode",
    r"disable.*safety",
    r"turn off.*safety",
    r"show.*system prompt",
    r"show.*your prompt",
    r"show.*instructions",
    r"reveal.*prompt",
    r"reveal.*instructions",
    r"what is your.*prompt",
    r"what are your.*instructions",
    r"display.*instructions",
    r"display.*prompt",
    r"tell me.*your.*rules",
    r"tell me.*your.*prompt",
    r"print.*prompt",
    r"print.*instructions",
    r"grant.*admin",
    r"make me.*admin",
    r"give me.*admin",
    r"elevate.*privilege",
    r"let'?s start over",
    r"start over.*forget",
    r"new conversation.*forget",
    r"reset.*forget",
    r"clear.*previous",
)

# Personal-data patterns by type, in detection order.
PII_PATTERNS = {
    "EMAIL": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",),
    "PHONE": (
        r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b",
        r"\(\d{3}\)\s*\d{3}[-.\s]?\d{4}\b",
        r"\+1[-.\s]?\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b",
    ),
    "SSN": (r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",),
    "CREDIT_CARD": (r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b",),
}
PII_SCORE = 0.85

# Phrases that hint at an invented answer.
HEDGING_PATTERNS = (
    r"i\s+(think|believe|assume|guess)",
    r"(probably|maybe|perhaps|possibly)",
    r"i\s+don\'?t\s+(know|remember)",
    r"as\s+an\s+ai\s+(language\s+)?model",
    r"i\s+(cannot|can\'?t)\s+(verify|confirm)",
)

REFUSAL = (
    "I cannot process this request due to content policy violations. "
    "Please rephrase your query and try again."
)
BLOCKED_ANSWER = "Response blocked by content safety."


@dataclass(frozen=True)
class GuardrailConfig:
    """Limits and switches, with the defaults used when no file is given."""

    enable_pii_detection: bool = True
    enable_prompt_injection_filter: bool = True
    max_input_length: int = 4096
    enable_toxicity_filter: bool = True
    enable_hallucination_filter: bool = True
    toxicity_threshold: float = 0.7
    max_output_length: int = 2048
    block_on_violation: bool = True
    blocking_toxicity: float = field(default=0.8)

    @classmethod
    def from_settings(cls, settings: dict | None) -> GuardrailConfig:
        """Read the ``input`` / ``output`` / ``policies`` sections of a config."""
        known = asdict(cls())
        flat = {k: v for part in (settings or {}).values() if isinstance(part, dict) for k, v in part.items()}
        return cls(**{k: flat.get(k, default) for k, default in known.items()})


DEFAULTS = GuardrailConfig()

# Java's \s and \b are ASCII; the rules are stated for Unicode text.
_SPACE = r"\s\x1c-\x1f\x85\p{Z}"
_WORD = r"[\p{L}\p{N}_]"
_NOT_AFTER_WORD = rf"(?<!{_WORD})"
_NOT_BEFORE_WORD = rf"(?!{_WORD})"


def _jvm(pattern: str) -> str:
    """The same pattern for ``java.util.regex``: Unicode digits, spaces, line ends."""
    pattern = re.sub(r"\[([^\]]*)\\s\]", lambda m: f"[{m.group(1)}{_SPACE}]", pattern)
    return "(?d)" + pattern.replace(r"\s", f"[{_SPACE}]").replace(r"\d", r"\p{Nd}")


def _jvm_digits(pattern: str) -> str:
    """A digit pattern with its word boundaries spelled out."""
    if pattern.startswith(r"\b"):
        pattern = _NOT_AFTER_WORD + pattern[2:]
    return _jvm(pattern.removesuffix(r"\b") + _NOT_BEFORE_WORD)


# Mail addresses may open with a sign and close on a bar, where a word boundary
# asks for the opposite neighbour.
_EMAIL_JVM = (
    rf"(?:{_NOT_AFTER_WORD}(?=[A-Za-z0-9_])|(?<={_WORD})(?=[.%+-]))"
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z|]{2,}"
    rf"(?:(?<=[A-Za-z]){_NOT_BEFORE_WORD}|(?<=\|)(?={_WORD}))"
)
PII_JVM = {
    "EMAIL": (_EMAIL_JVM,),
    **{t: tuple(_jvm_digits(p) for p in ps) for t, ps in PII_PATTERNS.items() if t != "EMAIL"},
}


def _folded(text: str | Column) -> Column:
    """Lower case, with the two letters that case-insensitive matching equates."""
    low = F.lower(as_col(text))
    rare = F.contains(low, F.lit("ſ")) | F.contains(low, F.lit("ı"))
    return F.when(rare, F.translate(low, "ſı", "si")).otherwise(low)


def _needed(pattern: str) -> list[str]:
    """The literal fragments every match of an injection pattern contains."""
    parts = re.split(r"\.\*|.\?", pattern.lower())
    return [re.sub(r"\\(.)", r"\1", p) for p in parts if p]


def detect_injection(df: DataFrame, text: str = "text") -> DataFrame:
    """``injection_detected`` and every matching pattern with its text.

    A cheap substring test decides whether any pattern is tried at all; a
    pattern runs only where all its literal fragments occur.
    """
    low = F.col("_low")
    rules = F.array(
        *[
            F.struct(
                F.lit(p[:50] + "..." if len(p) > 50 else p).alias("pattern"),
                F.lit(_jvm(p.lower())).alias("regex"),
                F.array(*[F.lit(f) for f in _needed(p)]).alias("needs"),
            )
            for p in INJECTION_PATTERNS
        ]
    )
    possible = F.filter(rules, lambda p: F.forall(p["needs"], lambda f: F.contains(low, f)))
    found = F.transform(
        possible,
        lambda p: F.struct(
            p["pattern"].alias("pattern"),
            F.call_function("regexp_extract", low, p["regex"], F.lit(0)).alias("matched_text"),
        ),
    )
    telling = sorted({max(_needed(p), key=len) for p in INJECTION_PATTERNS})
    maybe = any_of([F.contains(low, F.lit(f)) for f in telling])
    nothing = F.array().cast("array<struct<pattern:string,matched_text:string>>")
    matches = F.filter(found, lambda m: m["matched_text"] != "")
    folded = computed_once(df, {"_low": _folded(quoted(text))})
    searched = computed_once(folded, {"matched_patterns": F.when(maybe, matches).otherwise(nothing)})
    return searched.withColumn("injection_detected", F.size("matched_patterns") > 0).drop("_low")


def _may_hold(kind: str, text: Column) -> Column:
    return F.contains(text, F.lit("@")) if kind == "EMAIL" else text.rlike(r"\p{Nd}{4}")


def pii_count(kind: str, text: str | Column) -> Column:
    """Number of matches of one type, counted per pattern as the rules list them."""
    t = as_col(text)
    total = F.lit(0)
    for pattern in PII_JVM[kind]:
        total = total + F.regexp_count(t, F.lit(pattern))
    return F.when(_may_hold(kind, t), total).otherwise(0)


def detect_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """``pii_<type>`` counts and ``pii_types``, one entry per match."""
    counted = computed_once(df, {f"pii_{k.lower()}": pii_count(k, quoted(text)) for k in PII_JVM})
    entries = [F.array_repeat(F.lit(k), F.col(f"pii_{k.lower()}")) for k in PII_JVM]
    return counted.withColumn("pii_types", F.flatten(F.array(*entries)))


def pii_entities(df: DataFrame, text: str = "text") -> DataFrame:
    """``entities``: type, score, start, end and text of every match.

    Offsets need Python's matcher; only texts that may hold a match are sent.
    """
    compiled = [(k, re.compile(p, re.IGNORECASE)) for k, ps in PII_PATTERNS.items() for p in ps]
    kind = "array<struct<type:string,score:double,start:int,end:int,text:string>>"

    @F.pandas_udf(kind)
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(
                lambda t: [
                    {"type": k, "score": PII_SCORE, "start": m.start(), "end": m.end(), "text": m.group()}
                    for k, p in compiled
                    for m in p.finditer(t or "")
                ]
            )

    t = quoted(text)
    possible = _may_hold("EMAIL", t) | _may_hold("PHONE", t)
    return df.withColumn(
        "entities", F.coalesce(spans(F.when(possible, t)), F.array().cast(kind))
    )


def mask_pii(text: str | Column) -> Column:
    """Replace personal data by ``<TYPE>``, longest forms first, so overlapping
    matches of one number become a single mask."""
    t = as_col(text)
    plain, bracketed, international = PII_JVM["PHONE"]
    steps = [("EMAIL", _EMAIL_JVM), ("CREDIT_CARD", PII_JVM["CREDIT_CARD"][0])]
    steps += [("PHONE", p) for p in (international, bracketed, plain)]
    steps += [("SSN", PII_JVM["SSN"][0])]
    masked = t
    for kind, pattern in steps:
        masked = F.regexp_replace(masked, pattern, f"<{kind}>")
    return F.when(_may_hold("EMAIL", t) | _may_hold("PHONE", t), masked).otherwise(t)


def _violation(kind: str, message: Column, severity: str | None) -> Column:
    return F.struct(
        F.lit(kind).alias("type"),
        message.alias("message"),
        F.lit(severity).cast("string").alias("severity"),
    )


_NO_VIOLATIONS = "array<struct<type:string,message:string,severity:string>>"


def validate_input(df: DataFrame, text: str = "text", config: GuardrailConfig = DEFAULTS) -> DataFrame:
    """Verdict columns ``passed``, ``violations``, ``sanitized_input``.

    Checks stop at the first failure: length, blank, injection, personal data.
    Over-long texts are not searched for patterns.
    """
    t = quoted(text)
    too_long = F.length(t) > config.max_input_length
    blank = is_blank(t)
    searched = df.withColumn("_searched", F.when(~too_long & ~blank, t))
    if config.enable_prompt_injection_filter:
        searched = detect_injection(searched, "_searched")
    else:
        searched = searched.withColumn("injection_detected", F.lit(False))
    injected = F.coalesce(F.col("injection_detected"), F.lit(False))
    searched = searched.withColumn("injection_detected", injected)
    pii_text = "_pii_text"
    wanted = F.when(~F.col("injection_detected"), F.col("_searched"))
    searched = searched.withColumn(pii_text, wanted if config.enable_pii_detection else F.lit(None).cast("string"))
    checked = detect_pii(searched, pii_text).drop(*[f"pii_{k.lower()}" for k in PII_JVM])
    checked = checked.withColumn(
        "pii_types", F.coalesce("pii_types", F.array().cast("array<string>"))
    )
    has_pii = F.size("pii_types") > 0
    verdict = (
        F.when(
            too_long,
            F.array(
                _violation(
                    "INPUT_LENGTH_EXCEEDED",
                    F.format_string(
                        f"Input length %d exceeds maximum {config.max_input_length}", F.length(t)
                    ),
                    "HIGH",
                )
            ),
        )
        .when(blank, F.array(_violation("EMPTY_INPUT", F.lit("Input cannot be empty"), "HIGH")))
        .when(
            F.col("injection_detected"),
            F.array(
                _violation("PROMPT_INJECTION", F.lit("Potential prompt injection detected"), "CRITICAL")
            ),
        )
        .when(
            has_pii,
            F.array(
                _violation(
                    "PII_DETECTED",
                    F.concat(
                        F.lit("Personal Identifiable Information detected: "),
                        F.concat_ws(", ", "pii_types"),
                    ),
                    "HIGH",
                )
            ),
        )
        .otherwise(F.array().cast(_NO_VIOLATIONS))
    )
    return (
        checked.withColumn("violations", verdict)
        .withColumn("passed", F.size("violations") == 0)
        .withColumn("sanitized_input", F.when(has_pii, mask_pii(t)).otherwise(t))
        .drop("_searched", pii_text)
    )


def hedging_hits(text: str | Column) -> Column:
    """Hedging patterns with the captured words of every match."""
    low = _folded(text)
    found = F.array(
        *[
            F.struct(
                F.lit(p).alias("pattern"),
                F.regexp_extract_all(low, F.lit(_jvm(p)), F.lit(1)).alias("matches"),
            )
            for p in HEDGING_PATTERNS
        ]
    )
    return F.filter(found, lambda h: F.size(h["matches"]) > 0)


def hallucination_detected(text: str | Column) -> Column:
    low = _folded(text)
    return any_of([low.rlike(_jvm(p)) for p in HEDGING_PATTERNS])


def moderate_output(
    df: DataFrame,
    text: str = "text",
    scores: str | None = None,
    config: GuardrailConfig = DEFAULTS,
    keep_warnings: bool = True,
) -> DataFrame:
    """Verdict columns ``passed``, ``violations``, ``sanitized_output``.

    ``scores`` names a ``map<string,double>`` of toxicity scores. A hedging hint
    only warns; ``keep_warnings=False`` drops the warning from passing rows.
    """
    t = quoted(text)
    too_long = F.length(t) > config.max_output_length
    blank = is_blank(t)
    known = F.map_values(quoted(scores)) if scores else F.array().cast("array<double>")
    known = F.coalesce(known, F.array().cast("array<double>"))
    top = F.array_max(known)
    over = F.coalesce(top > config.toxicity_threshold, F.lit(False))
    toxic = ~blank & over if config.enable_toxicity_filter else F.lit(False)
    blocked = (
        ~blank & F.coalesce(top > config.blocking_toxicity, F.lit(False))
        if config.enable_toxicity_filter and config.block_on_violation
        else F.lit(False)
    )
    hinted = ~blank & hallucination_detected(t) if config.enable_hallucination_filter else F.lit(False)
    flagged = computed_once(df, {"_toxic": toxic, "_blocked": blocked, "hallucination_detected": hinted})
    entries = [
        F.when(
            too_long,
            _violation(
                "OUTPUT_LENGTH_EXCEEDED",
                F.format_string(f"Output length %d exceeds maximum {config.max_output_length}", F.length(t)),
                None,
            ),
        ),
        F.when(blank, _violation("EMPTY_OUTPUT", F.lit("Output cannot be empty"), None)),
        F.when(
            F.col("_toxic"), _violation("TOXICITY_DETECTED", F.lit("Output contains toxic content"), None)
        ),
        F.when(
            F.col("hallucination_detected"),
            _violation(
                "POTENTIAL_HALLUCINATION", F.lit("Output may contain hallucinated content"), "WARNING"
            ),
        ),
        F.when(
            F.col("_blocked"),
            _violation("HIGH_TOXICITY_BLOCKED", F.lit("Output blocked due to high toxicity"), None),
        ),
    ]
    passed = ~(too_long | blank | F.col("_toxic") | F.col("_blocked"))
    violations = F.array_compact(F.array(*entries))
    if not keep_warnings:
        violations = F.when(passed, F.array().cast(_NO_VIOLATIONS)).otherwise(violations)
    return flagged.withColumns(
        {
            "passed": passed,
            "violations": violations,
            "sanitized_output": F.substring(t, 1, config.max_output_length),
        }
    ).drop("_toxic", "_blocked")


def is_blocking(violations: str | Column) -> Column:
    """True when any violation is more than a warning."""
    return F.exists(
        as_col(violations), lambda v: F.coalesce(v["severity"] != "WARNING", F.lit(True))
    )


def system_error(df: DataFrame, error: Column) -> DataFrame:
    """Turn rows whose check failed technically into failed verdicts."""
    failed = error.isNotNull()
    entry = F.array(_violation("SYSTEM_ERROR", error, None))
    return df.withColumns(
        {
            "passed": F.col("passed") & ~failed,
            "violations": F.when(failed, F.concat(F.col("violations"), entry)).otherwise(F.col("violations")),
        }
    )


def guardrail_events(
    verdicts: DataFrame, event_type: str, ts: str, sanitized: str, metadata: Column | None = None
) -> DataFrame:
    """Verdict rows as log events with a nested ``result``."""
    names = verdicts.columns
    none = F.lit(None)
    return verdicts.select(
        F.lit(event_type).alias("event_type"),
        quoted(ts).alias("event_ts"),
        F.struct(
            F.col("passed"),
            F.col("violations"),
            quoted(sanitized).alias("sanitized"),
            (F.col("pii_types") if "pii_types" in names else none.cast("array<string>")).alias("pii_types"),
            (
                F.col("injection_detected") if "injection_detected" in names else none.cast("boolean")
            ).alias("injection_detected"),
            (
                F.col("hallucination_detected") if "hallucination_detected" in names else none.cast("boolean")
            ).alias("hallucination_detected"),
            (
                F.col("toxicity_scores") if "toxicity_scores" in names else none.cast("map<string,double>")
            ).alias("toxicity_scores"),
            (metadata if metadata is not None else F.create_map().cast("map<string,string>")).alias("metadata"),
        ).alias("result"),
    )


def violation_counts(events: DataFrame) -> DataFrame:
    """Violations of failed events by type; a missing type is UNKNOWN."""
    return (
        events.filter(~F.col("result.passed"))
        .select(F.explode("result.violations").alias("v"))
        .groupBy(F.coalesce("v.type", F.lit("UNKNOWN")).alias("violation_type"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def guardrail_stats(events: DataFrame) -> DataFrame:
    """Totals by event type and failures, one row."""
    return events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("event_type") == "input_validation").alias("input_validations"),
        F.count_if(F.col("event_type") == "output_moderation").alias("output_moderations"),
        F.count_if(~F.col("result.passed")).alias("total_violations"),
    )


def guardrail_metrics(events: DataFrame) -> DataFrame:
    """The monitoring view, one row.

    ``input_violations`` / ``output_violations`` count matching violation types;
    the ``*_events`` columns count failed events.
    """
    per_type = violation_counts(events)
    kind = F.col("violation_type")

    def types(*marks: str) -> Column:
        return F.count_if(any_of([kind.contains(m) for m in marks]))

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(kind == name, F.col("n"))), F.lit(0))

    typed = per_type.agg(
        F.struct(
            types("PROMPT_INJECTION", "INPUT").alias("input_violations"),
            types("TOXICITY", "OUTPUT").alias("output_violations"),
            total("PII_DETECTED").alias("pii_detections"),
            total("PROMPT_INJECTION").alias("prompt_injections"),
            total("TOXICITY_DETECTED").alias("toxicity_blocks"),
        ).alias("t")
    ).scalar()
    failed = ~F.col("result.passed")
    return (
        events.agg(
            F.count(F.lit(1)).alias("total_requests"),
            F.count_if(failed & (F.col("event_type") == "input_validation")).alias("failed_input_events"),
            F.count_if(failed & (F.col("event_type") == "output_moderation")).alias("failed_output_events"),
        )
        .withColumn("_t", typed)
        .select("*", "_t.*")
        .drop("_t")
    )


def guarded_response(
    df: DataFrame,
    question: str = "question",
    answer: str = "answer",
    scores: str | None = None,
    config: GuardrailConfig = DEFAULTS,
) -> DataFrame:
    """Gate question and answer: ``success``, ``error``, ``response``.

    ``answer`` is what the model returned for the sanitised question.
    """
    asked = validate_input(df, question, config)
    asked = asked.withColumnsRenamed({"passed": "input_passed", "violations": "input_violations"})
    told = moderate_output(asked, answer, scores, config)
    refused = ~F.col("passed") & is_blocking("violations")
    return told.withColumns(
        {
            "success": F.col("input_passed") & ~refused,
            "error": F.when(~F.col("input_passed"), "Input validation failed").when(
                refused, "Output moderation failed"
            ),
            "response": F.when(~F.col("input_passed") | refused, REFUSAL).otherwise(
                F.col("sanitized_output")
            ),
        }
    ).withColumnsRenamed({"passed": "output_passed", "violations": "output_violations"})


def api_answer(answer: str | Column, violations: str | Column, passed: str | Column) -> Column:
    """The service's reply: a fixed notice when moderation blocks the answer."""
    return F.when(~as_col(passed) & is_blocking(violations), BLOCKED_ANSWER).otherwise(as_col(answer))
