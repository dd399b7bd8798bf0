"""Chunking, prompts, scores and text rules."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ampersift.functions.columns import as_col, quoted
from ampersift.operators.ordering import row_numbers
from ampersift.operators.upserts import first_n
from ampersift.session import freeze

CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
SEPARATORS = ("\n\n", "\n", ". ", " ", "")

# Keywords the prompt check looks for.
PROMPT_KEYWORDS = ("energy", "heating", "solar panels", "household energy use", "efficiency")


def _pieces(text: str, separator: str) -> list[str]:
    """Split before every separator, which stays with the piece it opens."""
    if not separator:
        return list(text)
    head, *tail = text.split(separator)
    return [p for p in [head, *[separator + t for t in tail]] if p]


def _pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Join neighbouring pieces up to ``size``, carrying back up to ``overlap``."""
    chunks: list[str] = []
    start = end = width = 0
    while end < len(pieces):
        extra = len(pieces[end])
        if width + extra > size and end > start:
            chunks.append("".join(pieces[start:end]).strip())
            while width > overlap or (width and width + extra > size):
                width -= len(pieces[start])
                start += 1
        width += extra
        end += 1
    if end > start:
        chunks.append("".join(pieces[start:end]).strip())
    return [c for c in chunks if c]


def split_recursive(
    text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: Sequence[str] = SEPARATORS
) -> list[str]:
    """Chunks of at most ``size`` characters cut at the coarsest separator that works."""
    at = next((i for i, s in enumerate(separators) if not s or s in text), len(separators) - 1)
    finer = separators[at + 1 :]
    chunks: list[str] = []
    run: list[str] = []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            run.append(piece)
            continue
        chunks += _pack(run, size, overlap)
        run = []
        chunks += split_recursive(piece, size, overlap, finer) if finer else [piece]
    return chunks + _pack(run, size, overlap)


def chunk_recursive(
    df: DataFrame,
    text: str = "text",
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: Sequence[str] = SEPARATORS,
) -> DataFrame:
    """One row per chunk: ``chunk_pos``, ``chunk_text``, ``chunk_size``."""

    @F.pandas_udf("array<string>")
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: split_recursive(t, size, overlap, separators) if t else [])

    kept = [quoted(c) for c in df.columns if c != text]
    return df.select(*kept, F.posexplode(split(quoted(text))).alias("chunk_pos", "chunk_text")).withColumn(
        "chunk_size", F.length("chunk_text")
    )


class Chunk:
    """Handler of the table function ``chunk(text, size, overlap)``."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str, int]]:
        for pos, piece in enumerate(split_recursive(text, size, overlap) if text else []):
            yield pos, piece, len(piece)


def register_chunk(spark: SparkSession, name: str = "chunk") -> None:
    """Make recursive chunking callable from SQL, rows passing in Arrow batches:

    ``SELECT d.doc_id, c.* FROM documents d, LATERAL chunk(d.text, 1000, 200) c``
    """
    made = F.udtf(Chunk, returnType="chunk_pos int, chunk_text string, chunk_size int", useArrow=True)
    spark.udtf.register(name, made.asDeterministic())


def chunk_coverage(df: DataFrame, text: str, chunks: str) -> DataFrame:
    """``df`` with ``in_text`` and ``complete``: whether the array ``chunks`` holds
    parts of the text, and whether one after the other they cover it but for white
    space."""
    t = quoted(text)
    blank = r"^[\s\x1c-\x1f\x85\p{Z}]*"
    state = F.struct(F.lit(0).alias("end"), F.lit(True).alias("in_text"), F.lit(True).alias("complete"))

    def step(acc: Column, chunk: Column) -> Column:
        # white space behind what is covered; a chunk that starts later leaves a gap
        skip = F.length(F.regexp_extract(t.substr(acc["end"] + 1, F.length(t)), blank, 0))
        size = F.length(chunk)
        head = t.substr(F.lit(1), acc["end"] + skip + size)
        # its last place without a gap covers most, also in a text that repeats itself
        back = F.position(F.reverse(chunk), F.reverse(head))
        end = F.length(head) - back + 1
        return F.struct(
            F.when(back > 0, F.greatest(acc["end"], end)).otherwise(acc["end"]).alias("end"),
            (acc["in_text"] & t.contains(chunk)).alias("in_text"),
            (acc["complete"] & (back > 0)).alias("complete"),
        )

    walked = F.aggregate(quoted(chunks), state, step)
    rest = t.substr(F.col("_w.end") + 1, F.length(t))
    out = df.withColumn("_w", walked)
    return out.withColumns({"in_text": F.col("_w.in_text"), "complete": F.col("_w.complete") & rest.rlike(blank + "$")}).drop("_w")


def chunk_fixed(
    df: DataFrame, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """Character-level chunking: fixed strides, the splitter's last resort.

    Whole texts are cut; the last chunk ends at the end of the text.
    """
    step = size - overlap
    t = quoted(text)
    length = F.length(t)
    last = F.greatest(F.ceil((length - F.lit(overlap)) / F.lit(float(step))), F.lit(1)) - 1
    kept = [quoted(c) for c in df.columns if c != text]
    return (
        df.filter(length > 0)
        .select(*kept, t.alias("_t"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("chunk_pos"))
        .withColumn("chunk_text", F.col("_t").substr(F.col("chunk_pos") * step + 1, F.lit(size)))
        .withColumn("chunk_size", F.length("chunk_text"))
        .drop("_t")
    )


def number_chunks(chunks: DataFrame, order: Sequence[str] = ("doc_id", "chunk_pos")) -> DataFrame:
    """A dense ``chunk_id`` from 0 over all chunks in document order."""
    # range bounds are sampled first, which would split every text a second time
    return row_numbers(freeze(chunks), list(order), name="chunk_id").withColumn("chunk_id", F.col("chunk_id") - 1)


def index_metadata(
    chunks: DataFrame,
    documents: DataFrame,
    embedding_model: str,
    dimension: int,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """The one-row description saved beside an index."""
    counted = chunks.agg(
        F.count(F.lit(1)).alias("num_chunks"), F.avg("chunk_size").alias("avg_chunk_size")
    )
    n_docs = documents.agg(F.count(F.lit(1))).scalar()
    return counted.select(
        n_docs.alias("num_documents"),
        "num_chunks",
        "avg_chunk_size",
        F.lit(embedding_model).alias("embedding_model"),
        F.lit(size).alias("chunk_size"),
        F.lit(overlap).alias("chunk_overlap"),
        F.lit(dimension).alias("dimension"),
    )


def build_prompts(
    hits: DataFrame,
    questions: DataFrame,
    template: str | Column,
    query_id: str = "query_id",
    question: str = "question",
    content: str = "chunk_text",
    rank: str = "rank",
) -> DataFrame:
    """Fill ``{context}`` and ``{input}`` from the ranked hits of each question.

    ``hits`` holds at most k rows per question.
    """
    context = hits.groupBy(query_id).agg(
        F.concat_ws(
            "\n\n",
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.col(rank), F.col(content)))), lambda x: x[content]
            ),
        ).alias("context")
    )
    shape = F.lit(template) if isinstance(template, str) else template
    joined = questions.join(context, query_id, "left").withColumn(
        "context", F.coalesce("context", F.lit(""))
    )
    filled = F.replace(
        F.replace(shape, F.lit("{context}"), F.col("context")), F.lit("{input}"), quoted(question)
    )
    return joined.withColumn("prompt", filled)


def conversation_history(
    df: DataFrame,
    current: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    content: str = "text",
) -> DataFrame:
    """The messages before each current turn, as ordered rows.

    ``current`` names one live turn per conversation, so the result is no
    larger than the log; rows rather than one array per turn keep a long
    conversation spread over tasks. Only user and assistant turns are history.
    """
    live = current.select(conversation, F.col(turn).alias("current_turn"))
    said = df.filter(F.col(role).isin("user", "assistant"))
    return said.join(live, conversation).filter(F.col(turn) < F.col("current_turn")).select(
        conversation,
        "current_turn",
        F.col(turn).alias("position"),
        F.when(F.col(role) == "user", "human").otherwise("assistant").alias("role"),
        F.col(content).alias("content"),
    )


def last_user_turns(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role"
) -> DataFrame:
    """The latest user turn of every conversation."""
    return df.filter(F.col(role) == "user").groupBy(conversation).agg(F.max(turn).alias(turn))


def judge_score(reply: str | Column) -> Column:
    """The integer formed by all digits of a reply, clamped to 1..5; 3 without digits."""
    digits = F.regexp_replace(as_col(reply), "[^0-9]", "")
    value = F.regexp_replace(digits, "^0+", "")
    return (
        F.when(F.coalesce(F.length(digits), F.lit(0)) == 0, 3)
        .when(F.length(value) > 1, 5)
        .otherwise(F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(F.try_to_number(value, F.lit("9")).cast("int"), F.lit(0)))))
    )


def similarity_band(score: str | Column) -> Column:
    s = as_col(score)
    return F.when(s >= 0.80, "excellent").when(s >= 0.70, "good").otherwise("weak")


def composite_quality(factual: Column, helpful: Column, complete: Column, clear: Column) -> Column:
    return factual * 0.4 + helpful * 0.3 + complete * 0.2 + clear * 0.1


def keyword_coverage(text: str | Column, keywords: Sequence[str] = PROMPT_KEYWORDS) -> Column:
    """Share of the keywords contained in the text, ignoring case."""
    low = F.lower(as_col(text))
    hits = [F.contains(low, F.lit(k.lower())).cast("int") for k in keywords]
    total = hits[0]
    for h in hits[1:]:
        total = total + h
    return total / F.lit(float(len(keywords)))


def is_blank(text: str | Column) -> Column:
    return as_col(text).rlike(r"^[\s\x1c-\x1f\x85\p{Z}]*$")


def lint_flags(text: str | Column, limit: int = 4000) -> dict[str, Column]:
    t = as_col(text)
    return {"blank": is_blank(t), "too_long": F.length(t) > limit}


def request_rules(
    df: DataFrame, question: str = "question", top_k: str = "top_k", satisfaction: str | None = None
) -> DataFrame:
    """Boolean rule columns and ``accepted`` for incoming requests."""
    rules = {
        "question_ok": F.coalesce(F.length(quoted(question)).between(5, 500), F.lit(False)),
        "top_k_ok": F.coalesce(quoted(top_k).between(1, 10), F.lit(True)),
    }
    if satisfaction:
        rules["satisfaction_ok"] = F.coalesce(quoted(satisfaction).between(0, 5), F.lit(True))
    passed = F.lit(True)
    for rule in rules.values():
        passed = passed & rule
    return df.withColumns(rules).withColumn("accepted", passed)


def strategy_report(df: DataFrame) -> DataFrame:
    """Mean similarity and judge score per strategy."""
    return df.groupBy("strategy").agg(
        F.avg("cosine_similarity").alias("avg_cosine_similarity"),
        F.avg("quality_score").alias("avg_quality_score"),
    )


def strategy_examples(df: DataFrame, order: str, n: int = 2) -> DataFrame:
    """The first ``n`` answers of each strategy, rendered as report text."""
    kept = first_n(df, n, ["strategy"], [F.col(order)])
    return kept.withColumn(
        "report_text",
        F.concat(
            F.lit("**Q:** "),
            F.col("question"),
            F.lit("\n**Generated:** "),
            F.col("generated_answer"),
            F.lit("\n**Score:** "),
            F.col("quality_score").cast("string"),
            F.lit("/5\n---\n"),
        ),
    )


def retrieval_metrics(hits: DataFrame, query: str = "query_id", score: str = "score") -> DataFrame:
    """Mean, least and greatest score and the number of hits per query; 0 if none."""
    s = quoted(score)
    return hits.groupBy(query).agg(
        F.coalesce(F.avg(s), F.lit(0.0)).alias("avg_score"),
        F.coalesce(F.min(s), F.lit(0.0)).alias("min_score"),
        F.coalesce(F.max(s), F.lit(0.0)).alias("max_score"),
        F.count(s).alias("num_results"),
    )


def metric_exposition(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Lower-cased metric names with one ``name value`` line each."""
    name = F.lower(quoted(key))
    return df.select(
        name.alias("metric"),
        F.coalesce(
            F.element_at(F.create_map(*[F.lit(x) for kv in _METRIC_NOTES.items() for x in kv]), quoted(key)),
            F.lit("No description available"),
        ).alias("description"),
        F.concat(name, F.lit(" "), quoted(value).cast("string")).alias("line"),
    )


# Descriptions of the exported metrics.
_METRIC_NOTES = {
    "api_success_rate": "API call success rate (1 = success)",
    "avg_api_response_time": "Avg API response time in seconds",
    "rmse": "Root Mean Squared Error of predictions",
    "mae": "Mean Absolute Error of predictions",
}
