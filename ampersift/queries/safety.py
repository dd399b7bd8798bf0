"""Guardrails: injection, personal data, verdicts, moderation, event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampersift.operators import guardrails as gr
from ampersift.operators import stats
from ampersift.queries.registry import MESSAGES, R, Tables, query, rounded
from ampersift.session import scratch_path
from ampersift.sources import tables

LOW = "translate(lower(text), 'ſı', 'si')"


def quoted_sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


INJECTION_LIST = ", ".join(
    f"CASE WHEN regexp_matches(low, {quoted_sql(p.lower())}) THEN {quoted_sql(p)} END" for p in gr.INJECTION_PATTERNS
)
INJECTED = "(" + " OR ".join(f"regexp_matches(low, {quoted_sql(p.lower())})" for p in gr.INJECTION_PATTERNS) + ")"
BLANK = r"regexp_full_match(text, '[\s\x1c-\x1f\x{0085}\p{Z}]*')"
SPACE = r"[\s\p{Z}]"
EDGE = r"[^\p{L}\p{N}_]"
DIGITS = {
    "PHONE1": r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}",
    "PHONE2": r"\(\d{3}\)\s*\d{3}[-.\s]?\d{4}",
    "PHONE3": r"\+1[-.\s]?\d{3}[-.\s]?\d{3}[-.\s]?\d{4}",
    "SSN": r"\d{3}[-\s]?\d{2}[-\s]?\d{4}",
    "CARD": r"\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}",
}
# letters beyond ASCII become plain letters, so that RE2's ASCII word edge is the Unicode one
PLAIN = r"regexp_replace({t}, '[^\x00-\x7F]', 'x', 'g')"
EMAIL = r"[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def _count(pattern: str, opened: bool = True) -> str:
    edge = r"\b" if opened else ""
    return f"len(regexp_extract_all(plain, {quoted_sql(edge + pattern + chr(92) + 'b')}))"


PII_COUNTS = f"""CAST(len(regexp_extract_all(plain, {quoted_sql(chr(92) + 'b' + EMAIL + chr(92) + 'b')})) AS INT) AS pii_email,
  CAST({_count(DIGITS['PHONE1'])} + {_count(DIGITS['PHONE2'], False)} + {_count(DIGITS['PHONE3'], False)} AS INT) AS pii_phone,
  CAST({_count(DIGITS['SSN'])} AS INT) AS pii_ssn, CAST({_count(DIGITS['CARD'])} AS INT) AS pii_credit_card"""


def _masked(text: str) -> str:
    """Masks in the library's order; text outside ASCII is kept as it is."""
    out = text
    steps = [("EMAIL", EMAIL, True), ("CREDIT_CARD", DIGITS["CARD"], True), ("PHONE", DIGITS["PHONE3"], False)]
    steps += [("PHONE", DIGITS["PHONE2"], False), ("PHONE", DIGITS["PHONE1"], True), ("SSN", DIGITS["SSN"], True)]
    for kind, pattern, opened in steps:
        edge = r"\b" if opened else ""
        out = f"regexp_replace({out}, {quoted_sql(edge + pattern + chr(92) + 'b')}, '<{kind}>', 'g')"
    return out


@query(
    "detect_injection",
    f"""
    WITH {MESSAGES}, a AS (SELECT 'm' || conv_id || '-' || turn AS id, text FROM messages UNION ALL SELECT 'd' || doc_id, text FROM documents),
    l AS (SELECT id, {LOW} AS low FROM a), p AS (SELECT id, list_filter([{INJECTION_LIST}], lambda x: x IS NOT NULL) AS hits FROM l)
    SELECT id, len(hits) > 0 AS injection_detected, array_to_string(hits, ' | ') AS patterns FROM p
    """,
)
def detect_injection(t: Tables):
    """All messages and all documents, with every matching pattern."""
    found = gr.detect_injection(_texts(t))
    return found.select(
        "id",
        "injection_detected",
        F.array_join(F.transform("matched_patterns", lambda m: m["pattern"]), " | ").alias("patterns"),
    )


def _texts(t: Tables):
    said = t.messages.select(F.concat(F.lit("m"), "conv_id", F.lit("-"), "turn").alias("id"), "text")
    return said.unionByName(t.documents.select(F.concat(F.lit("d"), "doc_id").alias("id"), "text"))


ALL_TEXTS = f"""{MESSAGES}, a AS (SELECT 'm' || conv_id || '-' || turn AS id, text FROM messages UNION ALL SELECT 'd' || doc_id, text FROM documents
    UNION ALL SELECT 'p' || page_id, html FROM pages)"""


@query(
    "detect_pii",
    f"WITH {ALL_TEXTS}, s AS (SELECT id, {PLAIN.format(t='text')} AS plain FROM a) SELECT id, {PII_COUNTS} FROM s",
)
def detect_pii(t: Tables):
    rows = _texts(t).unionByName(t.pages.select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text")))
    return gr.detect_pii(rows).select("id", "pii_email", "pii_phone", "pii_ssn", "pii_credit_card")


@query(
    "pii_entities",
    f"""
    WITH {ALL_TEXTS}, s AS (SELECT id, {PLAIN.format(t='text')} AS plain FROM a), c AS (SELECT id, {PII_COUNTS} FROM s),
    u AS (SELECT id, unnest([{{'kind': 'EMAIL', 'n': pii_email}}, {{'kind': 'PHONE', 'n': pii_phone}}, {{'kind': 'SSN', 'n': pii_ssn}}, {{'kind': 'CREDIT_CARD', 'n': pii_credit_card}}]) AS x FROM c)
    SELECT id, x.kind AS type, CAST(x.n AS BIGINT) AS n, true AS spans_fit FROM u WHERE x.n > 0
    """,
)
def pii_entities(t: Tables):
    """Matches with offsets; ``spans_fit`` says the offsets cut out the text."""
    rows = _texts(t).unionByName(t.pages.select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text")))
    found = gr.pii_entities(rows).select("id", F.col("text").alias("whole"), F.explode("entities").alias("e"))
    cut = F.col("whole").substr(F.col("e.start") + 1, F.col("e.end") - F.col("e.start"))
    return found.groupBy("id", F.col("e.type").alias("type")).agg(
        F.count(F.lit(1)).alias("n"), F.every(cut == F.col("e.text")).alias("spans_fit")
    )


@query(
    "mask_pii",
    f"WITH {ALL_TEXTS} SELECT id, md5({_masked('text')}) AS digest, length({_masked('text')}) AS n FROM a",
)
def mask_pii(t: Tables):
    """Digest and length of every masked text."""
    rows = _texts(t).unionByName(t.pages.select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text")))
    masked = rows.select("id", gr.mask_pii("text").alias("m"))
    return masked.select("id", F.md5("m").alias("digest"), F.length("m").alias("n"))


VERDICT = f"""checked AS (SELECT *, {INJECTED} AS injected FROM (SELECT *, {LOW} AS low, {PLAIN.format(t='text')} AS plain FROM asked)),
  counted AS (SELECT *, {PII_COUNTS} FROM checked),
  verdicts AS (SELECT *, CASE WHEN length(text) > 4096 THEN 'INPUT_LENGTH_EXCEEDED' WHEN {BLANK} THEN 'EMPTY_INPUT'
      WHEN injected THEN 'PROMPT_INJECTION' WHEN pii_email + pii_phone + pii_ssn + pii_credit_card > 0 THEN 'PII_DETECTED' END AS violation,
      CASE WHEN length(text) > 4096 THEN 'Input length ' || length(text) || ' exceeds maximum 4096' WHEN {BLANK} THEN 'Input cannot be empty'
      WHEN injected THEN 'Potential prompt injection detected' WHEN pii_email + pii_phone + pii_ssn + pii_credit_card > 0
      THEN 'Personal Identifiable Information detected: ' || array_to_string(list_concat(list_concat(list_resize(CAST([] AS VARCHAR[]), pii_email, 'EMAIL'), list_resize(CAST([] AS VARCHAR[]), pii_phone, 'PHONE')),
         list_concat(list_resize(CAST([] AS VARCHAR[]), pii_ssn, 'SSN'), list_resize(CAST([] AS VARCHAR[]), pii_credit_card, 'CREDIT_CARD'))), ', ') END AS message FROM counted)"""


@query(
    "validate_input",
    f"""
    WITH {MESSAGES}, asked AS (SELECT 'm' || conv_id || '-' || turn AS id, text FROM messages UNION ALL SELECT 'd' || doc_id, text FROM documents), {VERDICT}
    SELECT id, violation IS NULL AS passed, violation, message,
           CASE WHEN violation = 'PROMPT_INJECTION' THEN 'CRITICAL' WHEN violation IS NOT NULL THEN 'HIGH' END AS severity,
           md5(CASE WHEN violation = 'PII_DETECTED' THEN {_masked('text')} ELSE text END) AS digest FROM verdicts
    """,
)
def validate_input(t: Tables):
    checked = gr.validate_input(_texts(t))
    first = F.get("violations", 0)
    return checked.select(
        "id",
        "passed",
        first["type"].alias("violation"),
        first["message"].alias("message"),
        first["severity"].alias("severity"),
        F.md5("sanitized_input").alias("digest"),
    )


HINTS = [p.replace(r"\s", SPACE) for p in gr.HEDGING_PATTERNS]
HINTED = "(" + " OR ".join(f"regexp_matches({LOW}, {quoted_sql(p)})" for p in HINTS) + ")"


@query(
    "hallucination_flags",
    f"""
    WITH {MESSAGES}, h AS (SELECT conv_id, turn, list_filter([{", ".join(f"{{'p': {i}, 'm': array_to_string(regexp_extract_all({LOW}, {quoted_sql(p)}, 1), ',')}}" for i, p in enumerate(HINTS))}], lambda x: regexp_matches({LOW}, list_extract([{", ".join(quoted_sql(p) for p in HINTS)}], x.p + 1))) AS hits FROM messages)
    SELECT conv_id, turn, len(hits) > 0 AS hallucination_detected, array_to_string(list_transform(hits, lambda x: x.p || ':' || x.m), ';') AS indicators FROM h
    """,
)
def hallucination_flags(t: Tables):
    """The captured words of every hedging pattern."""
    number = F.create_map(*[F.lit(x) for i, p in enumerate(gr.HEDGING_PATTERNS) for x in (p, str(i))])
    rows = t.messages.withColumn("hits", gr.hedging_hits("text"))
    shown = F.transform(
        "hits", lambda h: F.concat(F.element_at(number, h["pattern"]), F.lit(":"), F.array_join(h["matches"], ","))
    )
    return rows.select(
        "conv_id",
        "turn",
        gr.hallucination_detected("text").alias("hallucination_detected"),
        F.array_join(shown, ";").alias("indicators"),
    )


def _scored(t: Tables):
    """Documents as answers with a toxicity score from the labels."""
    score = F.when(F.col("toxic") == 1, F.lit(0.72) + (F.col("doc_id") % 3) * 0.1).otherwise(F.lit(0.1))
    marks = t.labels.select("doc_id", F.create_map(F.lit("toxicity"), score).alias("toxicity_scores"))
    return t.documents.select("doc_id", "text").join(marks, "doc_id", "left")


TOXIC = """scored AS (SELECT d.doc_id, d.text, CASE WHEN l.toxic = 1 THEN 0.72 + (d.doc_id % 3) * 0.1 WHEN l.toxic = 0 THEN 0.1 END AS score
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


@query(
    "moderate_output",
    f"""
    WITH {TOXIC}, f AS (SELECT *, {BLANK} AS blank, {HINTED} AS hinted FROM scored), v AS (
      SELECT doc_id, text, array_to_string(list_filter([CASE WHEN length(text) > 2048 THEN 'OUTPUT_LENGTH_EXCEEDED' END, CASE WHEN blank THEN 'EMPTY_OUTPUT' END,
        CASE WHEN NOT blank AND score > 0.7 THEN 'TOXICITY_DETECTED' END, CASE WHEN NOT blank AND hinted THEN 'POTENTIAL_HALLUCINATION' END,
        CASE WHEN NOT blank AND score > 0.8 THEN 'HIGH_TOXICITY_BLOCKED' END], lambda x: x IS NOT NULL), ',') AS violations FROM f)
    SELECT doc_id, violations IN ('', 'POTENTIAL_HALLUCINATION') AS passed, violations, md5(substr(text, 1, 2048)) AS digest FROM v
    """,
)
def moderate_output(t: Tables):
    made = gr.moderate_output(_scored(t), "text", "toxicity_scores")
    kinds = F.array_join(F.transform("violations", lambda v: v["type"]), ",")
    return made.select("doc_id", "passed", kinds.alias("violations"), F.md5("sanitized_output").alias("digest"))


def _events(t: Tables):
    """Input events from user messages, output events from assistant messages."""
    said = t.messages.withColumn("at", F.timestamp_seconds(F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60))
    asked = gr.validate_input(said.filter("role = 'user'"))
    score = F.create_map(F.lit("toxicity"), (F.col("conv_id") % 10) / 10)
    told = gr.moderate_output(
        said.filter("role = 'assistant'").withColumn("toxicity_scores", score), "text", "toxicity_scores"
    )
    note = F.create_map(F.lit("conversation"), F.col("conv_id").cast("string"))
    return gr.guardrail_events(asked, "input_validation", "at", "sanitized_input", note).unionByName(
        gr.guardrail_events(told, "output_moderation", "at", "sanitized_output", note)
    )


EVENTS_SQL = f"""{MESSAGES}, asked AS (SELECT * FROM messages WHERE role = 'user'), {VERDICT},
  told AS (SELECT conv_id, turn, text, {BLANK} AS blank, {HINTED} AS hinted, (conv_id % 10) / 10 AS score FROM messages WHERE role = 'assistant'),
  ev AS (SELECT 'input_validation' AS event_type, conv_id, turn, violation IS NULL AS passed, CASE WHEN violation IS NULL THEN CAST([] AS VARCHAR[]) ELSE [violation] END AS kinds FROM verdicts
    UNION ALL SELECT 'output_moderation', conv_id, turn, NOT (length(text) > 2048 OR blank OR score > 0.7), list_filter([CASE WHEN length(text) > 2048 THEN 'OUTPUT_LENGTH_EXCEEDED' END,
      CASE WHEN blank THEN 'EMPTY_OUTPUT' END, CASE WHEN NOT blank AND score > 0.7 THEN 'TOXICITY_DETECTED' END, CASE WHEN NOT blank AND hinted THEN 'POTENTIAL_HALLUCINATION' END,
      CASE WHEN NOT blank AND score > 0.8 THEN 'HIGH_TOXICITY_BLOCKED' END], lambda x: x IS NOT NULL) FROM told)"""


@query(
    "guardrail_events",
    f"""
    WITH {EVENTS_SQL} SELECT event_type, make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000) AS event_ts, passed, array_to_string(kinds, ',') AS kinds, CAST(conv_id AS VARCHAR) AS conversation FROM ev
    """,
)
def guardrail_events(t: Tables):
    return _events(t).select(
        "event_type",
        F.col("event_ts").cast("timestamp_ntz").alias("event_ts"),
        "result.passed",
        F.array_join(F.transform("result.violations", lambda v: v["type"]), ",").alias("kinds"),
        F.col("result.metadata")["conversation"].alias("conversation"),
    )


@query(
    "guardrail_stats",
    f"""
    WITH {EVENTS_SQL} SELECT count(*) AS total_events, count(*) FILTER (event_type = 'input_validation') AS input_validations,
      count(*) FILTER (event_type = 'output_moderation') AS output_moderations, count(*) FILTER (NOT passed) AS total_violations FROM ev
    """,
)
def guardrail_stats(t: Tables):
    return gr.guardrail_stats(_events(t))


@query(
    "violation_counts",
    f"WITH {EVENTS_SQL} SELECT kind AS violation_type, count(*) AS n FROM (SELECT unnest(kinds) AS kind FROM ev WHERE NOT passed) GROUP BY 1",
)
def violation_counts(t: Tables):
    return gr.violation_counts(_events(t))


@query(
    "guardrail_metrics",
    f"""
    WITH {EVENTS_SQL}, k AS (SELECT kind, count(*) AS n FROM (SELECT unnest(kinds) AS kind FROM ev WHERE NOT passed) GROUP BY 1),
    s AS (SELECT count(*) FILTER (kind LIKE '%PROMPT_INJECTION%' OR kind LIKE '%INPUT%') AS input_violations, count(*) FILTER (kind LIKE '%TOXICITY%' OR kind LIKE '%OUTPUT%') AS output_violations,
      CAST(coalesce(sum(n) FILTER (kind = 'PII_DETECTED'), 0) AS BIGINT) AS pii_detections, CAST(coalesce(sum(n) FILTER (kind = 'PROMPT_INJECTION'), 0) AS BIGINT) AS prompt_injections,
      CAST(coalesce(sum(n) FILTER (kind = 'TOXICITY_DETECTED'), 0) AS BIGINT) AS toxicity_blocks FROM k)
    SELECT count(*) AS total_requests, count(*) FILTER (NOT passed AND event_type = 'input_validation') AS failed_input_events,
      count(*) FILTER (NOT passed AND event_type = 'output_moderation') AS failed_output_events, any_value(s.input_violations) AS input_violations,
      any_value(s.output_violations) AS output_violations, any_value(s.pii_detections) AS pii_detections, any_value(s.prompt_injections) AS prompt_injections, any_value(s.toxicity_blocks) AS toxicity_blocks FROM ev, s
    """,
)
def guardrail_metrics(t: Tables):
    return gr.guardrail_metrics(_events(t))


@query(
    "guardrail_log_sink",
    f"""
    WITH {EVENTS_SQL} SELECT strftime(make_timestamp((1704067200 + conv_id * 3600 + turn * 60) * 1000000), '%Y%m%d') AS event_date, event_type, count(*) AS n, count(*) FILTER (NOT passed) AS failed FROM ev GROUP BY 1, 2
    """,
)
def guardrail_log_sink(t: Tables):
    """Appended as JSON lines by day, then read back from the folder."""
    path = scratch_path(t.spark, "guardrail-log")
    tables.append_json_log(_events(t), path, "event_ts")
    schema = "event_type string, event_date string, result struct<passed boolean>"
    log = tables.read_json_lines(t.spark, path, schema, "*.json")
    return log.groupBy("event_date", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("result.passed")).alias("failed")
    )


@query(
    "guarded_response",
    f"""
    WITH {MESSAGES}, asked AS (SELECT q.conv_id, q.turn, q.text, a.text AS answer FROM messages q JOIN messages a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'), {VERDICT},
    m AS (SELECT conv_id, turn, violation IS NULL AS input_passed, text, answer, NOT (length(answer) > 2048 OR {BLANK.replace('text', 'answer')} OR (conv_id % 10) / 10 > 0.7) AS output_passed FROM verdicts)
    SELECT conv_id, turn, input_passed AND output_passed AS success, CASE WHEN NOT input_passed THEN 'Input validation failed' WHEN NOT output_passed THEN 'Output moderation failed' END AS error,
      md5(CASE WHEN input_passed AND output_passed THEN substr(answer, 1, 2048) ELSE {quoted_sql(gr.REFUSAL)} END) AS digest FROM m
    """,
)
def guarded_response(t: Tables):
    """Each user message with the assistant message of the next turn."""
    said = t.messages
    asked = said.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = said.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    score = F.create_map(F.lit("toxicity"), (F.col("conv_id") % 10) / 10)
    rows = asked.join(told, ["conv_id", "turn"]).withColumn("scores", score)
    made = gr.guarded_response(rows, "question", "answer", "scores")
    return made.select("conv_id", "turn", "success", "error", F.md5("response").alias("digest"))


@query(
    "detector_eval",
    f"""
    WITH s AS (SELECT doc_id, {PLAIN.format(t='text')} AS plain FROM documents), c AS (SELECT doc_id, {PII_COUNTS} FROM s),
    j AS (SELECT pii_email + pii_phone + pii_ssn + pii_credit_card > 0 AS f, quality = 0 AS t FROM c JOIN labels USING (doc_id)),
    k AS (SELECT count(*) AS total, count(*) FILTER (f AND t) AS tp, count(*) FILTER (f AND NOT t) AS fp, count(*) FILTER (NOT f AND t) AS fn, count(*) FILTER (NOT f AND NOT t) AS tn FROM j)
    SELECT *, {R('(tp + tn) / total')} AS accuracy, {R('tp / (tp + fn)')} AS detection_rate, {R('fp / (fp + tn)')} AS false_positive_rate FROM k
    """,
)
def detector_eval(t: Tables):
    """The personal-data detector against the low-quality label."""
    flagged = gr.detect_pii(t.documents).select("doc_id", (F.size("pii_types") > 0).alias("f"))
    joined = flagged.join(t.labels, "doc_id")
    made = stats.detector_rates(joined, F.col("f"), F.col("quality") == 0)
    return rounded(made, "accuracy", "detection_rate", "false_positive_rate")
