"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampersift.llm import decontaminate as dc
from ampersift.llm import language, neardup, negatives, packing, pii, prefixtrie, quality, repeats, scoring, secrets, toolcalls, toxicity
from ampersift.llm.common import table, text_crc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql.strip()
        return build

    return register


OP5_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, w[i + 1 : i + least(13, len(w))] AS win
  FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 12, 1))) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
sizes AS (SELECT DISTINCT len(win) AS n FROM item_windows),
doc_windows AS (
  SELECT doc_id, i, n, w[i + 1 : i + n] AS win
  FROM (SELECT doc_id, n, w, unnest(range(0, len(w) - n + 1)) AS i FROM doc_words, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (win)),
covered AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(k, ',' ORDER BY k)) AS digest
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(digest, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op5_benchmark_decontamination", OP5_SQL)
def benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of benchmark windows in every document, and the verdict."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = dc.judged(docs, table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def remainder_is(n: int):
    """Whether crc32(doc_id as text) mod 5 is ``n``; false for a null id."""
    return F.coalesce(text_crc() % 5 == n, F.lit(False))


# The vocabulary that the packing contract names; a parameter of the operator.
def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def language_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled rows that language ID may learn from."""
    return table(spark, folder, "documents").where(text_crc() % 5 != 0).select("text", "lang")


@query("op2_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = language.identify(docs, language_rows(spark, folder))
    return found.select("doc_id", remainder_is(0).alias("held_out"), "lang_pred", "score")


@query("op7_packing")
def packed_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack(table(spark, folder, "documents").select("doc_id", "text"), vocabulary_path())


OP1_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + least(3, len(w))], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, 1))) AS i FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 85 * (x.n + y.n - c)),
reached AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT doc_id, b FROM reached JOIN links ON r = a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""


@query("op1_minhash_near_dedup", OP1_SQL)
def minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return neardup.near_duplicates(table(spark, folder, "documents"), width=3, percent=85)


@query("op3_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base figures and verdict of every document; the field learns from the
    labelled documents outside the held-out fifth."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    field = quality.fit(docs, labels.where(text_crc() % 5 != 0))
    return quality.judge(docs, field).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_lines",
        "n_content_lines",
        "content_share",
    )


@query("op4_secret_scan")
def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document."""
    found = secrets.find_secrets(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@query("op9_personal_data")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document."""
    found = pii.find_personal(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


@query("op10_lm_scoring")
def lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Model and unigram score of every document, learned from four fifths of them."""
    docs = table(spark, folder, "documents").select("doc_id", "text", (~remainder_is(1)).alias("train"))
    return scoring.score(docs).select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        "bits_per_byte",
    )


OP8_SQL = r"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, h, len(h) // 2 AS n FROM bytes),
starts AS (
  SELECT doc_id, p, md5(substr(h, CAST(2 * p + 1 AS BIGINT), 400)) AS s
  FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS p FROM sized WHERE n >= 200)),
often AS (SELECT s FROM starts GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM starts JOIN often USING (s)),
marked AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 200 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hit),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 200 AS b FROM marked GROUP BY 1, 2),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y, b FROM spans),
kept AS (
  SELECT doc_id, string_agg(substr(h, CAST(2 * x + 1 AS BIGINT), CAST(2 * (y - x) AS BIGINT)), '' ORDER BY x)
                 || any_value(substr(h, CAST(2 * e + 1 AS BIGINT))) AS rest
  FROM (SELECT gaps.*, h, max(b) OVER (PARTITION BY doc_id) AS e FROM gaps JOIN sized USING (doc_id)) GROUP BY 1),
total AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY 1)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM sized LEFT JOIN total USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op8_suffix_array_dedup", OP8_SQL)
def suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document inside 200-byte strings that occur elsewhere, and the digest of the rest."""
    found = repeats.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


# Tool-call data derived from the conversations: every user turn is a call of one
# of three tools, the assistant turn behind it the result. A call depends on the
# user turn before it; in some conversations every other call depends on the one
# after it, so that the order of turns is none.
TOOLS = (
    ("search", "query", "string", True),
    ("search", "limit", "integer", True),
    ("lookup", "query", "string", True),
    ("lookup", "exact", "boolean", False),
)


def derived_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of a conversations table."""
    name = lambda turn: F.concat(F.lit("call-"), F.col("conv_id"), F.lit("-"), turn)
    tool = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("browse")), ((F.col("conv_id") + F.col("turn")) % 3 + 1).cast("int"))
    text = toolcalls.quoted(F.coalesce("text", F.lit("")))
    arguments = F.concat(
        F.lit('{"query": '),
        text,
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit(', "limit": '), F.col("turn") + 1)).otherwise(F.lit(', "exact": true')),
        F.lit("}"),
    )
    backwards, even = F.col("conv_id") % 7 == 3, F.floor(F.col("turn") / 2) % 2 == 0
    depends = F.when(backwards & even, F.array(name(F.col("turn") + 2))).when(
        ~backwards & (F.col("turn") >= 2), F.array(name(F.col("turn") - 2))
    )
    rows = conversations.select("conv_id", "turn", "role", "text")
    calls = rows.where("role = 'user'").select(
        "conv_id",
        "turn",
        name(F.col("turn")).alias("call_id"),
        tool.alias("tool"),
        arguments.alias("arguments"),
        F.coalesce(depends, F.array().cast("array<string>")).alias("depends"),
    )
    results = rows.where("role = 'assistant'").select("conv_id", "turn", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


OP6_SQL = r"""
WITH calls AS (
  SELECT conv_id, turn, 'call-' || conv_id || '-' || turn AS call_id,
         ['search', 'lookup', 'browse'][(conv_id + turn) % 3 + 1] AS tool, coalesce(text, '') AS q, turn % 4 = 0 AS has_limit,
         CASE WHEN conv_id % 7 = 3 THEN CASE WHEN (turn // 2) % 2 = 0 THEN turn + 2 END
              WHEN turn >= 2 THEN turn - 2 END AS dep
  FROM conversations WHERE role = 'user'),
linked AS (
  SELECT c.*, d.turn AS found, r.turn AS answered, r.text AS content
  FROM calls c LEFT JOIN calls d ON d.conv_id = c.conv_id AND d.turn = c.dep
  LEFT JOIN conversations r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 AND r.role = 'assistant'),
judged AS (
  SELECT *, CASE WHEN found > turn THEN 1 ELSE 0 END AS level,
         CASE WHEN tool = 'browse' THEN 'unknown_tool'
              WHEN has_limit <> (tool = 'search') THEN 'bad_arguments'
              WHEN dep IS NOT NULL AND found IS NULL THEN 'missing_dependency'
              WHEN answered IS NULL THEN 'no_result' ELSE 'ok' END AS status
  FROM linked)
SELECT conv_id, call_id, turn, tool, level, status,
       '{"after":[' || coalesce('"call-' || conv_id || '-' || dep || '"', '') || '],"arguments":{'
       || CASE WHEN has_limit THEN '"limit":' || (turn + 1) ELSE '"exact":true' END || ',"query":' || to_json(q)
       || '},"id":"' || call_id || '","level":' || level || ',"name":"' || tool || '","result":'
       || coalesce(CAST(to_json(content) AS VARCHAR), 'null') || ',"status":"' || status || '"}' AS json
FROM judged
"""


@query("op6_tool_call_linking", OP6_SQL)
def tool_call_linking(spark: SparkSession, folder: str) -> DataFrame:
    """Calls derived from all conversations, linked, ordered, checked and serialised."""
    calls, results = derived_calls(table(spark, folder, "conversations"))
    schemas = spark.createDataFrame(TOOLS, "tool string, name string, kind string, required boolean")
    return toolcalls.link_calls(calls, results, schemas)


@query("op11_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; the dictionaries learn from three fourths of the labels."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    quarter = F.coalesce(text_crc() % 4 == 2, F.lit(False))
    model = toxicity.fit(docs, table(spark, folder, "labels").select("doc_id", "toxic").where(~quarter))
    return toxicity.score(docs, model).select("doc_id", quarter.alias("held_out"), "score", "predicted")


OP12_SQL = r"""
WITH ordered AS (
  SELECT conv_id AS c, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS e,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n, turn
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(e ORDER BY turn NULLS FIRST, e) AS e, list(n ORDER BY turn NULLS FIRST, e) AS n FROM ordered GROUP BY 1),
kept AS (
  SELECT c, e, n, xor(4294967295, list_reduce(
           list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
           lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                                    lambda v, o: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))) % 4 AS h
  FROM own),
rebuilt AS (
  SELECT k.c, coalesce(b.e[1:k.h], []) || k.e[k.h + 1:] AS e, coalesce(b.n[1:k.h], []) || k.n[k.h + 1:] AS n
  FROM kept k LEFT JOIN own b ON b.c = k.c - k.c % 20),
members AS (
  SELECT c, d, len(e) AS size, array_to_string(e[1:d], '') AS key, CASE WHEN d = 0 THEN 0 ELSE n[d] END AS words
  FROM (SELECT c, e, n, unnest(range(0, len(e) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT d, key, min(c) AS conv, count(*) AS n_convs, any_value(words) AS words, max(size) = d AS leaf,
         coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (size = d), '') AS ends
  FROM members GROUP BY 1, 2),
above AS (
  SELECT x.d, x.conv, y.d AS yd, y.conv AS yc, y.leaf, (y.n_convs - 1) * y.words AS saved
  FROM nodes y JOIN members m ON m.c = y.conv AND m.d <= y.d JOIN nodes x ON x.d = m.d AND x.key = m.key),
sums AS (
  SELECT d, conv, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved, count(*) FILTER (yd = d + 1) AS n_children
  FROM above GROUP BY 1, 2)
SELECT n.conv AS conv_id, n.d AS depth, p.conv AS parent_conv_id, n_convs, n_children, n_leaves,
       CAST(sums.saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM nodes n JOIN sums USING (d, conv) LEFT JOIN above p ON p.yd = n.d AND p.yc = n.conv AND p.d = n.d - 1
"""


@query("op12_prefix_trie", OP12_SQL)
def prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Trie of the prefixes of all rebuilt conversations."""
    return prefixtrie.prefix_trie(table(spark, folder, "conversations"))


OP13_SQL = r"""
WITH rows AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""


@query("op13_hard_negatives", OP13_SQL)
def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    return negatives.mine(table(spark, folder, "embeddings"))
