"""Documents, chunks, retrieval, prompts and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ampersift.functions.columns import cosine
from ampersift.operators import approximate
from ampersift.operators import experiments as ab
from ampersift.operators import guardrails as gr
from ampersift.operators import keyword
from ampersift.operators import retrieval as rt
from ampersift.operators import text
from ampersift.plans import answering
from ampersift.queries.registry import MESSAGES, R, Tables, query, r, rounded
from ampersift.queries.safety import BLANK, VERDICT, quoted_sql
from ampersift.session import freeze, scratch_path
from ampersift.sources import tables

KEYWORDS = ("the", "und", "energy", "que", "Solar")
DIMENSION = 64


@query(
    "load_documents",
    """
    SELECT doc_id, CASE lang WHEN 'en' THEN doc_id || '.txt' ELSE doc_id || '.md' END AS filename, length(text) AS n, md5(text) AS digest
    FROM documents WHERE lang IN ('en', 'fr')
    """,
)
def load_documents(t: Tables):
    """File names by language: txt, md, an unsupported type, hidden files."""
    lang, number = F.col("lang"), F.col("doc_id")
    name = (
        F.when(lang == "en", F.concat(number, F.lit(".txt")))
        .when(lang == "fr", F.concat(number, F.lit(".md")))
        .when(lang == "de", F.concat(number, F.lit(".docx")))
        .otherwise(F.concat(F.lit("."), number, F.lit(".txt")))
    )
    kept = tables.supported_documents(t.documents.withColumn("filename", name))
    return kept.select("doc_id", "filename", F.length("text").alias("n"), F.md5("text").alias("digest"))


FIXED = """fixed AS (
  SELECT doc_id, CAST(i AS INT) AS chunk_pos, substr(text, i * 800 + 1, 1000) AS chunk_text
  FROM documents, range(0, 100000) AS g(i)
  WHERE length(text) > 0 AND i < greatest(ceil((length(text) - 200) / 800.0), 1))"""


@query(
    "chunk_fixed",
    f"""
    WITH {FIXED} SELECT doc_id, chunk_pos, row_number() OVER (ORDER BY doc_id, chunk_pos) - 1 AS chunk_id,
      length(chunk_text) AS chunk_size, md5(chunk_text) AS digest FROM fixed
    """,
)
def chunk_fixed(t: Tables):
    chunks = text.chunk_fixed(t.documents.select("doc_id", "text"))
    slim = chunks.select("doc_id", "chunk_pos", "chunk_size", F.md5("chunk_text").alias("digest"))
    return text.number_chunks(slim)


@query(
    "index_metadata",
    f"""
    WITH {FIXED} SELECT (SELECT count(*) FROM documents) AS num_documents, count(*) AS num_chunks, {R('avg(length(chunk_text))')} AS avg_chunk_size,
      'hashed-tfidf' AS embedding_model, 1000 AS chunk_size, 200 AS chunk_overlap, 64 AS dimension FROM fixed
    """,
)
def index_metadata(t: Tables):
    chunks = text.chunk_fixed(t.documents.select("doc_id", "text"))
    return rounded(text.index_metadata(chunks, t.documents, "hashed-tfidf", DIMENSION), "avg_chunk_size")


@query("chunk_recursive")
def chunk_recursive(t: Tables):
    chunks = text.chunk_recursive(t.documents.select("doc_id", "source", "text"))
    slim = chunks.select("doc_id", "source", "chunk_pos", "chunk_size", F.md5("chunk_text").alias("digest"))
    return text.number_chunks(slim)


def _weights_sql(rows: str) -> str:
    """Words by bucket (tf) of ``rows`` (id, body) and the bucket weights (idf)."""
    return f"""tf AS (SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {DIMENSION} AS b, count(*) AS c
    FROM (SELECT id, unnest(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+')) AS w FROM {rows}) GROUP BY 1, 2),
  idf AS (SELECT b, ln((SELECT count(*) + 1 FROM {rows}) / CAST(count(*) + 1 AS DOUBLE)) AS weight FROM tf GROUP BY 1)"""


def _vectors_sql(name: str, rows: str, tf: str = "tf") -> str:
    """Unit vectors (id, v) of ``rows`` under the name ``name``."""
    return f"""{name}_x AS (SELECT id, b, c * coalesce(weight, ln((SELECT n + 1 FROM fitted))) AS x FROM {tf} LEFT JOIN idf USING (b)),
  {name}_z AS (SELECT id, sqrt(sum(x * x)) AS z FROM {name}_x GROUP BY 1),
  {name} AS (SELECT r.id, list(CASE WHEN z > 0 THEN CAST(coalesce(x, 0) / z AS FLOAT) ELSE 0::FLOAT END ORDER BY g.i) AS v
    FROM (SELECT id FROM {rows}) r CROSS JOIN range({DIMENSION}) g(i) LEFT JOIN {name}_x x ON x.id = r.id AND x.b = g.i LEFT JOIN {name}_z n ON n.id = r.id GROUP BY 1)"""


@query(
    "hash_embed",
    f"""
    WITH body AS (SELECT doc_id AS id, text AS body FROM documents), fitted AS (SELECT count(*) AS n FROM body), {_weights_sql('body')}, {_vectors_sql('made', 'body')}
    SELECT id AS doc_id, list_transform(v, lambda x: round(CAST(x AS DOUBLE), 6) + 0) AS embedding FROM made
    """,
)
def hash_embed(t: Tables):
    made = rt.hash_embed(t.documents.select("doc_id", "text"), dimension=DIMENSION)
    return made.select("doc_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("embedding"))


@query(
    "chunk_function",
    """
    SELECT doc_id, TRUE AS same_rows, TRUE AS short, TRUE AS in_text, TRUE AS complete FROM documents
    WHERE NOT regexp_full_match(coalesce(text, ''), '[\\s\\x1c-\\x1f\\x{0085}\\p{Z}]*')
    """,
)
def chunk_function(t: Tables):
    """Chunks from the SQL table function: the rows of the operator, none longer than
    its size, all from their text, and nothing of a text lost."""
    text.register_chunk(t.spark)
    texts = t.documents.select("doc_id", "text")
    # texts travel once, beside their chunks and not with each of them; a digest stands for them in the key
    marked = texts.withColumn("mark", F.sha2("text", 256))
    made = t.spark.sql("SELECT d.doc_id, d.mark, c.* FROM {docs} d, LATERAL chunk(d.text, 1000, 200) c", docs=marked)
    whole = marked.select("doc_id", "mark", F.col("text").alias("chunk_text")).withColumns(
        {"chunk_pos": F.lit(None).cast("int"), "chunk_size": F.lit(None).cast("int")}
    )
    is_chunk = F.col("chunk_pos").isNotNull()

    def listed(value):
        held = F.collect_list(F.when(is_chunk, F.struct("chunk_pos", value)))
        return F.transform(F.array_sort(held), lambda c: c["col2"])

    # dealt by document once, so that nothing moves again for the grouping and the join
    by_text = (
        made.unionByName(whole).repartition("doc_id").groupBy("doc_id", "mark")
        .agg(F.max(F.when(~is_chunk, F.col("chunk_text"))).alias("text"), listed(F.col("chunk_text").alias("col2")).alias("chunks"), F.max("chunk_size").alias("longest"))
        .filter(F.col("longest").isNotNull())
    )
    # the operator's chunks are compared by their digests
    own = text.chunk_recursive(texts).select("doc_id", "chunk_pos", F.sha2("chunk_text", 256).alias("digest"))
    own = own.repartition("doc_id").groupBy("doc_id").agg(listed(F.col("digest").alias("col2")).alias("_own"))
    checked = text.chunk_coverage(by_text.join(own, "doc_id", "full"), "text", "chunks")
    digests = F.transform("chunks", lambda c: F.sha2(c, 256))
    same = F.coalesce(digests == F.col("_own"), F.lit(False))
    return checked.select("doc_id", same.alias("same_rows"), (F.col("longest") <= 1000).alias("short"), "in_text", "complete")


@query("index_build")
def index_build(t: Tables):
    """Recursive chunks with vectors, stored and described."""
    chunks = text.chunk_recursive(t.documents.select("doc_id", "source", "text"))
    vectors = rt.hash_embed(chunks, "chunk_text", DIMENSION)
    path = scratch_path(t.spark, "index")
    vectors.write.mode("overwrite").parquet(f"{path}/chunks")
    stored = t.spark.read.parquet(f"{path}/chunks")
    described = text.index_metadata(stored, t.documents, "hashed-tfidf", DIMENSION)
    described.write.mode("overwrite").parquet(f"{path}/metadata")
    return t.spark.read.parquet(f"{path}/metadata")


CENTROIDS = """flat AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
  means AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM flat GROUP BY 1, 2),
  queries AS (SELECT label AS query_id, list(m ORDER BY i) AS q FROM means GROUP BY 1)"""
NEAREST = f"""{CENTROIDS},
  gaps AS (SELECT query_id, vec_id AS doc_id, list_sum(list_transform(list_zip(q, CAST(embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM queries, embeddings),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) AS rank, 1 / (1 + d) AS score FROM gaps)"""


def _questions(t: Tables):
    """The mean vector of every label, asked against the whole table."""
    return rt.mean_vectors(t.embeddings, "label").withColumnRenamed("label", "query_id")


def _corpus(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


@query(
    "knn_topk",
    f"WITH {NEAREST} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, CAST(rank AS INT) AS rank, {R('d')} AS distance, {R('score')} AS score FROM ranked WHERE rank <= 10",
)
def knn_topk(t: Tables):
    return rounded(rt.knn_topk(_questions(t), _corpus(t), k=10), "distance", "score")


@query(
    "knn_threshold",
    f"""
    WITH {NEAREST} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, CAST(rank AS INT) AS rank, {R('d')} AS distance, {R('score')} AS score
    FROM ranked WHERE rank <= 10 AND score >= 0.515
    """,
)
def knn_threshold(t: Tables):
    """Original ranks survive the score threshold; blocks meet shards."""
    made = rt.knn_topk(_questions(t), _corpus(t), k=10, score_threshold=0.515, block_rows=4, pair_rows=4)
    return rounded(made, "distance", "score")


@query(
    "hybrid_topk",
    f"WITH {NEAREST} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, CAST(rank AS INT) AS rank, {R('d')} AS distance, {R('score')} AS score FROM ranked WHERE rank <= 3",
)
def hybrid_topk(t: Tables):
    return rounded(rt.hybrid_topk(rt.knn_topk(_questions(t), _corpus(t), k=10), 3), "distance", "score")


@query(
    "retrieval_metrics",
    f"""
    WITH {NEAREST} SELECT CAST(query_id AS BIGINT) AS query_id, {R('avg(score)')} AS avg_score, {R('min(score)')} AS min_score, {R('max(score)')} AS max_score, count(*) AS num_results
    FROM ranked WHERE rank <= 10 GROUP BY 1
    """,
)
def retrieval_metrics(t: Tables):
    made = text.retrieval_metrics(rt.knn_topk(_questions(t), _corpus(t), k=10))
    return rounded(made, "avg_score", "min_score", "max_score")


@query(
    "retrieval_log",
    f"""
    SELECT user_id AS query_id, event_type = 'view' AS first_run, {R('avg(1 / (1 + value))')} AS avg_score, {R('min(1 / (1 + value))')} AS min_score,
      {R('max(1 / (1 + value))')} AS max_score, count(*) AS num_results FROM events GROUP BY 1, 2
    """,
)
def retrieval_log(t: Tables):
    """Metrics of two runs appended to one CSV log and read back."""
    path = scratch_path(t.spark, "retrieval-log")
    scored = t.events.select("user_id", "event_type", (1 / (1 + F.col("value"))).alias("score"))
    figures = ("avg_score", "min_score", "max_score")
    for first in (True, False):
        hits = scored.filter((F.col("event_type") == "view") == first)
        made = rounded(text.retrieval_metrics(hits, "user_id"), *figures).withColumn("first_run", F.lit(first))
        tables.append_csv_rows(made, path)
    schema = "user_id long, avg_score double, min_score double, max_score double, num_results long, first_run boolean"
    return t.spark.read.schema(schema).option("header", True).csv(path).withColumnRenamed("user_id", "query_id")


@query(
    "source_rows",
    f"""
    WITH {NEAREST} SELECT CAST(query_id AS BIGINT) AS query_id, CAST(rank AS INT) AS rank, doc_id, {R('score')} AS score, substr(text, 1, 300) AS content, source
    FROM ranked JOIN documents USING (doc_id) WHERE rank <= 10
    """,
)
def source_rows(t: Tables):
    hits = rt.knn_topk(_questions(t), _corpus(t), k=10)
    return rounded(rt.source_rows(hits, t.documents.select("doc_id", "text", "source")), "score")


@query(
    "build_prompts",
    f"""
    WITH {NEAREST}, c AS (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context FROM ranked JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY 1),
    p AS (SELECT CAST(q.query_id AS BIGINT) AS query_id, 'Context:' || chr(10) || coalesce(context, '') || chr(10) || chr(10) || 'What is group ' || q.query_id || '?' AS prompt FROM queries q LEFT JOIN c USING (query_id))
    SELECT query_id, length(prompt) AS n, md5(prompt) AS digest FROM p
    """,
)
def build_prompts(t: Tables):
    asked = _questions(t)
    hits = rt.knn_topk(asked, _corpus(t), k=3)
    texts = hits.join(t.documents.select("doc_id", F.col("text").alias("chunk_text")), "doc_id")
    questions = asked.select(
        F.col("query_id").cast("long").alias("query_id"),
        F.concat(F.lit("What is group "), "query_id", F.lit("?")).alias("question"),
    )
    made = text.build_prompts(texts, questions, "Context:\n{context}\n\n{input}")
    return made.select("query_id", F.length("prompt").alias("n"), F.md5("prompt").alias("digest"))


@query(
    "cosine_pairs",
    f"""
    WITH {CENTROIDS}, c AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), q) AS s FROM embeddings JOIN queries ON label = query_id)
    SELECT vec_id, {R('s')} AS similarity, CASE WHEN s >= 0.8 THEN 'excellent' WHEN s >= 0.7 THEN 'good' ELSE 'weak' END AS band FROM c
    """,
)
def cosine_pairs(t: Tables):
    """Every vector against the mean of its label."""
    made = rt.similarity_to_mean(t.embeddings, "label")
    return made.select("vec_id", r("similarity").alias("similarity"), text.similarity_band("similarity").alias("band"))


EVALUATED = f"""bodies AS (SELECT 'a' || doc_id AS id, text AS body FROM documents UNION ALL SELECT 't' || item_id, text FROM benchmark), fitted AS (SELECT count(*) AS n FROM bodies),
  {_weights_sql('bodies')}, {_vectors_sql('made', 'bodies')},
  digits AS (SELECT doc_id, source AS strategy, regexp_replace(text, '[^0-9]', '', 'g') AS d FROM documents),
  judged AS (SELECT *, CASE WHEN coalesce(d, '') = '' THEN 3 WHEN length(ltrim(d, '0')) > 1 THEN 5 ELSE greatest(1, least(5, coalesce(TRY_CAST(ltrim(d, '0') AS INT), 0))) END AS score FROM digits),
  pairs AS (SELECT strategy, score, CAST(a.v AS DOUBLE[]) AS x, CAST(b.v AS DOUBLE[]) AS y FROM judged JOIN made a ON a.id = 'a' || doc_id
    JOIN made b ON b.id = 't' || (doc_id % (SELECT count(*) FROM benchmark))),
  sized AS (SELECT *, list_inner_product(x, y) AS xy, sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(y, y)) AS size FROM pairs)"""


@query(
    "answer_eval",
    f"""
    WITH {EVALUATED} SELECT strategy, {R('avg(CASE WHEN size > 0 THEN xy / size ELSE 0 END)')} AS avg_cosine_similarity, {R('avg(score)')} AS avg_quality_score FROM sized GROUP BY 1
    """,
)
def answer_eval(t: Tables):
    """Hashed vectors of documents against benchmark texts, averaged per source.

    The tables hold no true answers: a document stands for an answer and for the
    judge's reply to it, the benchmark item of its number for the truth.
    """
    answers = t.documents.select("doc_id", F.col("source").alias("strategy"), "text")
    total = t.benchmark.agg(F.count(F.lit(1))).scalar()
    keyed = answers.withColumn("item_id", F.pmod(F.col("doc_id"), total))
    both = keyed.select("doc_id", "strategy", "item_id", "text", F.lit("answer").alias("kind")).unionByName(
        t.benchmark.select(
            F.lit(None).cast("long").alias("doc_id"),
            F.lit(None).cast("string").alias("strategy"),
            "item_id",
            "text",
            F.lit("truth").alias("kind"),
        )
    )
    vectors = rt.hash_embed(both, dimension=DIMENSION)
    truth = vectors.filter("kind = 'truth'").select("item_id", F.col("embedding").alias("truth"))
    pairs = vectors.filter("kind = 'answer'").join(truth, "item_id")
    scored = pairs.select(
        "strategy",
        cosine(F.col("embedding"), F.col("truth")).alias("cosine_similarity"),
        text.judge_score("text").alias("quality_score"),
    )
    return rounded(text.strategy_report(scored), "avg_cosine_similarity", "avg_quality_score")


@query(
    "keyword_coverage",
    f"""
    SELECT doc_id, {R(' + '.join(f"CAST(contains(lower(text), '{k.lower()}') AS INT)" for k in KEYWORDS) .join(['(', ') / 5.0']))} AS coverage,
      ({' + '.join(f"CAST(contains(lower(text), '{k.lower()}') AS INT)" for k in KEYWORDS)}) / 5.0 >= 0.5 AS passed FROM documents
    """,
)
def keyword_coverage(t: Tables):
    covered = t.documents.select("doc_id", text.keyword_coverage("text", KEYWORDS).alias("c"))
    return covered.select("doc_id", r("c").alias("coverage"), (F.col("c") >= 0.5).alias("passed"))


@query(
    "text_lint",
    r"""
    SELECT doc_id, regexp_full_match(text, '[\s\x1c-\x1f\x{0085}\p{Z}]*') AS blank, length(text) > 4000 AS too_long FROM documents
    """,
)
def text_lint(t: Tables):
    return t.documents.select("doc_id", *[c.alias(n) for n, c in text.lint_flags("text").items()])


@query(
    "request_rules",
    f"""
    WITH {MESSAGES} SELECT conv_id, turn, length(text) BETWEEN 5 AND 500 AS question_ok, turn BETWEEN 1 AND 10 AS top_k_ok, (conv_id % 8) - 1 BETWEEN 0 AND 5 AS satisfaction_ok,
      length(text) BETWEEN 5 AND 500 AND turn BETWEEN 1 AND 10 AND (conv_id % 8) - 1 BETWEEN 0 AND 5 AS accepted FROM messages
    """,
)
def request_rules(t: Tables):
    rows = t.messages.withColumn("stars", F.col("conv_id") % 8 - 1)
    made = text.request_rules(rows, "text", "turn", "stars")
    return made.select("conv_id", "turn", "question_ok", "top_k_ok", "satisfaction_ok", "accepted")


@query(
    "conversation_history",
    """
    WITH live AS (SELECT conv_id, max(turn) AS current_turn FROM conversations WHERE role = 'user' GROUP BY 1)
    SELECT c.conv_id, current_turn, turn AS position, CASE role WHEN 'user' THEN 'human' ELSE 'assistant' END AS role, text AS content
    FROM conversations c JOIN live USING (conv_id) WHERE turn < current_turn AND role IN ('user', 'assistant')
    """,
)
def conversation_history(t: Tables):
    return text.conversation_history(t.conversations, text.last_user_turns(t.conversations))


QTF = """qtf AS (SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % %d AS b, count(*) AS c
    FROM (SELECT id, unnest(regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+')) AS w FROM ok) GROUP BY 1, 2)""".replace("%d", str(DIMENSION))
ASKED = """asked AS (SELECT m.conv_id, m.text FROM messages m JOIN (SELECT conv_id, max(turn) AS turn FROM messages WHERE role = 'user' GROUP BY 1) USING (conv_id, turn) WHERE m.role = 'user')"""
DENSE = f"""body AS (SELECT doc_id AS id, text AS body FROM documents), fitted AS (SELECT count(*) AS n FROM body),
  {_weights_sql('body')}, {_vectors_sql('chunk', 'body')}, {QTF}, {_vectors_sql('question', 'ok', 'qtf')},
  gap AS (SELECT q.id, c.id AS chunk, list_sum(list_transform(list_zip(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM question q, chunk c),
  near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, chunk) AS rank FROM gap)"""
PROMPTS = f"""{MESSAGES}, {ASKED}, {VERDICT},
  ok AS (SELECT conv_id AS id, text AS body, CAST('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS u FROM verdicts WHERE violation IS NULL),
  {DENSE},
  ctx AS (SELECT n.id, string_agg(b.body, chr(10) || chr(10) ORDER BY rank) AS context FROM near n JOIN body b ON b.id = n.chunk WHERE rank <= 3 GROUP BY 1)"""


@query(
    "prepare_prompts",
    f"""
    WITH {PROMPTS} SELECT id AS query_id, CASE WHEN u <= 40 THEN 'control' WHEN u <= 60 THEN 'concise' WHEN u <= 80 THEN 'detailed' ELSE 'conversational' END AS variant_id,
      length(context) + 2 + length(body) AS n, md5(context || chr(10) || chr(10) || body) AS digest FROM ok JOIN ctx USING (id)
    """,
)
def prepare_prompts(t: Tables):
    """Questions assigned, screened, retrieved for and turned into prompts; all
    documents and questions are embedded."""
    texts = t.documents.select("doc_id", F.col("text").alias("chunk_text"))
    weights = rt.bucket_weights(texts, "chunk_text", DIMENSION)
    asked = t.messages.filter("role = 'user'").withColumn("user_id", F.col("conv_id"))
    live = asked.join(text.last_user_turns(t.messages), ["conv_id", "turn"])
    screened = answering.screen_questions(live, "text").filter("admitted")
    ready = rt.embed(screened.withColumn("query_id", F.col("conv_id")), weights).withColumnRenamed("embedding", "vector")
    chunks = rt.embed(texts, weights, "chunk_text").withColumnRenamed("embedding", "vector")
    made = answering.prepare_prompts(ready, chunks)
    return made.select("query_id", "variant_id", F.length("prompt").alias("n"), F.md5("prompt").alias("digest"))


@query(
    "approximate_topk",
    f"""
    WITH {NEAREST}, hits AS (SELECT query_id, count(*) AS wanted, sum(d) AS total FROM ranked WHERE rank <= 10 GROUP BY 1)
    SELECT CAST(query_id AS BIGINT) AS query_id, wanted, wanted AS found, TRUE AS measured_exactly, TRUE AS recall_reached, TRUE AS few_measured FROM hits
    """,
)
def approximate_topk(t: Tables):
    """Ten nearest of every label's mean through the bucket index, held against the
    exact search: hits, their distances, the overall recall of 0.9, and that fewer
    than all pairs were measured."""
    path = scratch_path(t.spark, "vector-index")
    approximate.build_vector_index(_corpus(t), path)
    asked = freeze(_questions(t))
    found = freeze(approximate.approximate_topk(asked, path, k=10))
    exact = freeze(approximate.approximate_topk(asked, path, k=10, exact=True))
    figures = approximate.recall(found, exact)
    overall = figures.agg(F.sum("met") >= 0.9 * F.sum("wanted")).scalar()
    measured = approximate.candidates(asked, path).agg(F.count(F.lit(1))).scalar()
    pairs = t.embeddings.agg(F.count(F.lit(1)) * F.lit(1)).scalar() * asked.agg(F.count(F.lit(1))).scalar()
    same = exact.select("query_id", "doc_id", F.col("distance").alias("_exact"))
    checked = found.join(same, ["query_id", "doc_id"], "left").groupBy("query_id").agg(
        F.count(F.lit(1)).alias("found"), F.bool_and(F.coalesce(F.abs(F.col("distance") - F.col("_exact")) < 1e-9, F.lit(True))).alias("measured_exactly")
    )
    out = figures.join(checked, "query_id")
    return out.select("query_id", "wanted", "found", "measured_exactly", overall.alias("recall_reached"), (measured < pairs).alias("few_measured"))


BM25 = f"""{MESSAGES}, {ASKED}, ok AS (SELECT conv_id AS id, text AS body FROM asked),
  words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
  posts AS (SELECT term, doc_id, count(*) AS tf, any_value(size) AS size FROM (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM words) GROUP BY 1, 2),
  corpus AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM words),
  held AS (SELECT term, count(*) AS df FROM posts GROUP BY 1),
  wanted AS (SELECT id, term, count(*) AS times FROM (SELECT id, unnest(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+')) AS term FROM ok) GROUP BY 1, 2),
  weighed AS (SELECT id, term, times * ln(1 + (docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS weight FROM wanted JOIN held USING (term), corpus),
  scored AS (SELECT id, doc_id, sum(CAST(round(weight * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * size / mean)), 12) AS DECIMAL(38, 12))) AS score
    FROM posts JOIN weighed USING (term), corpus GROUP BY 1, 2),
  keyword AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS rank FROM scored)"""


def _last_questions(t: Tables):
    asked = t.messages.filter("role = 'user'").join(text.last_user_turns(t.messages), ["conv_id", "turn"])
    return asked.select(F.col("conv_id").alias("query_id"), "text")


def _keyword_index(t: Tables) -> str:
    path = scratch_path(t.spark, "keyword-index")
    keyword.build_keyword_index(t.documents, path)
    return path


@query(
    "bm25_topk",
    f"WITH {BM25} SELECT id AS query_id, doc_id, CAST(rank AS INT) AS rank, {R('score')} AS score FROM keyword WHERE rank <= 10",
)
def bm25_topk(t: Tables):
    """The last question of every conversation against the words of all documents."""
    return rounded(keyword.bm25_topk(_last_questions(t), _keyword_index(t)), "score")


@query(
    "hybrid_fused",
    f"""
    WITH {BM25}, {DENSE},
    legs AS (SELECT id, chunk AS doc_id, rank AS dense, NULL AS keyword FROM near WHERE rank <= 50 UNION ALL SELECT id, doc_id, NULL, rank FROM keyword WHERE rank <= 50),
    fused AS (SELECT id, doc_id, min(dense) AS dense, min(keyword) AS keyword, sum(CAST(round(1 / CAST(60 + coalesce(dense, keyword) AS DOUBLE), 12) AS DECIMAL(38, 12))) AS score FROM legs GROUP BY 1, 2)
    SELECT id AS query_id, doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) AS INT) AS rank, {R('score')} AS score,
      CAST(dense AS INT) AS dense_rank, CAST(keyword AS INT) AS keyword_rank FROM fused QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, doc_id) <= 10
    """,
)
def hybrid_fused(t: Tables):
    """Dense and keyword rankings of every last question over all documents, fused."""
    texts = t.documents.select("doc_id", "text")
    weights = rt.bucket_weights(texts, dimension=DIMENSION)
    questions = _last_questions(t)
    vectors = [rt.embed(df, weights).withColumnRenamed("embedding", "vector") for df in (questions, texts)]
    dense = rt.knn_topk(*vectors, k=50)
    return rounded(keyword.hybrid_search(questions, dense, _keyword_index(t)), "score")


# What each variant puts before its context.
STYLES = {
    "control": "Use these passages.\n{context}",
    "concise": "Answer in one sentence.\n{context}",
    "detailed": "Give every detail.\n{context}",
    "conversational": "Answer as in a talk.\n{context}",
}

RAG = f"""{MESSAGES}, asked AS (SELECT m.conv_id, m.text FROM messages m JOIN (SELECT conv_id, max(turn) AS turn FROM messages WHERE role = 'user' GROUP BY 1) USING (conv_id, turn) WHERE m.role = 'user'),
  {VERDICT}, ok AS (SELECT conv_id AS id, text AS body, CAST('0x' || substr(md5(CAST(conv_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS u FROM verdicts WHERE violation IS NULL),
  {FIXED}, body AS (SELECT row_number() OVER (ORDER BY doc_id, chunk_pos) - 1 AS id, chunk_text AS body FROM fixed), fitted AS (SELECT count(*) AS n FROM body),
  {_weights_sql('body')}, {_vectors_sql('chunk', 'body')},
  qtf AS (SELECT id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {DIMENSION} AS b, count(*) AS c
    FROM (SELECT id, unnest(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}]+')) AS w FROM ok) GROUP BY 1, 2),
  {_vectors_sql('question', 'ok', 'qtf')},
  gap AS (SELECT q.id, c.id AS chunk, list_sum(list_transform(list_zip(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM question q, chunk c),
  near AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, chunk) AS rank FROM gap),
  ctx AS (SELECT n.id, string_agg(b.body, chr(10) || chr(10) ORDER BY rank) AS context FROM near n JOIN body b ON b.id = n.chunk WHERE rank <= 3 GROUP BY 1),
  made AS (SELECT id, CASE WHEN u <= 40 THEN 'control' WHEN u <= 60 THEN 'concise' WHEN u <= 80 THEN 'detailed' ELSE 'conversational' END AS variant_id, coalesce(context, '') AS context, body FROM ok LEFT JOIN ctx USING (id)),
  filled AS (SELECT id, variant_id, CASE variant_id {" ".join(f"WHEN '{k}' THEN {quoted_sql(v.split(chr(10))[0])}" for k, v in STYLES.items())} END || chr(10) || context || chr(10) || chr(10) || body AS prompt FROM made)"""


@query(
    "rag_end_to_end",
    f"WITH {RAG} SELECT id AS query_id, variant_id, length(prompt) AS n, md5(prompt) AS digest FROM filled",
)
def rag_end_to_end(t: Tables):
    """All documents chunked, embedded and stored; all last questions screened,
    embedded, matched with the stored chunks and put into their variant's prompt."""
    path = scratch_path(t.spark, "rag-index")
    weights = answering.build_index(t.documents.select("doc_id", "text"), path, DIMENSION)
    asked = t.messages.filter("role = 'user'").join(text.last_user_turns(t.messages), ["conv_id", "turn"])
    asked = asked.select(F.col("conv_id").alias("query_id"), F.col("conv_id").alias("user_id"), F.col("text").alias("question"))
    made = answering.answer_from_index(asked, path, weights, experiment=ab.LIVE.with_prompts(STYLES))
    return made.select("query_id", "variant_id", F.length("prompt").alias("n"), F.md5("prompt").alias("digest"))


@query(
    "log_answers",
    f"""
    WITH {MESSAGES}, a AS (SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM messages q JOIN messages a ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'),
    g AS (SELECT conv_id, turn, question, CASE WHEN length(answer) > 2048 OR {BLANK.replace('text', 'answer')} THEN {quoted_sql(gr.BLOCKED_ANSWER)} ELSE answer END AS reply FROM a)
    SELECT conv_id, turn, md5(reply) AS digest, length(question) // 4 AS tokens_input, length(reply) // 4 AS tokens_output,
      {R("(length(question) // 4) * (0.075::DOUBLE / 1000000) + (length(reply) // 4) * (0.30::DOUBLE / 1000000)", 9)} AS cost FROM g
    """,
)
def log_answers(t: Tables):
    """Assistant turns moderated, blocked where needed, priced and logged."""
    said = t.messages
    asked = said.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    told = said.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    made = answering.log_answers(asked.join(told, ["conv_id", "turn"]), "question")
    return made.select("conv_id", "turn", F.md5("answer").alias("digest"), "tokens_input", "tokens_output", r("cost", 9).alias("cost"))
