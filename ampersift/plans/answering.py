"""Question answering as a batch: assign, screen, retrieve, prompt; then log."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampersift.functions.columns import quoted
from ampersift.operators import experiments as ab
from ampersift.operators import guardrails as gr
from ampersift.operators.retrieval import bucket_weights, embed, knn_topk
from ampersift.operators.text import (
    CHUNK_OVERLAP,
    CHUNK_SIZE,
    build_prompts,
    chunk_fixed,
    index_metadata,
    number_chunks,
)
from ampersift.session import freeze
from ampersift.sources.tables import save_index


def screen_questions(
    questions: DataFrame,
    question: str = "question",
    user: str = "user_id",
    override: str | None = None,
    experiment: ab.Experiment = ab.LIVE,
) -> DataFrame:
    """Questions with their variant, verdict and ``admitted`` flag."""
    assigned = ab.assign_variant(questions, user, override, experiment)
    checked = gr.validate_input(assigned, question)
    return checked.withColumn("admitted", F.col("passed") & ~F.col("rejected"))


def build_index(documents: DataFrame, path: str, dimension: int = 384, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> np.ndarray:
    """Cut documents into chunks, give them numbers and vectors and store them under
    ``path``; returns the bucket weights, with which questions are embedded alike."""
    chunks = number_chunks(chunk_fixed(documents, size=size, overlap=overlap))
    weights = bucket_weights(chunks, "chunk_text", dimension)
    stored = embed(chunks, weights, "chunk_text").withColumnRenamed("embedding", "vector")
    save_index(stored, index_metadata(stored, documents, "hashed-tfidf", dimension, size, overlap), path)
    return weights


def answer_from_index(
    questions: DataFrame,
    path: str,
    weights: np.ndarray,
    question: str = "question",
    user: str = "user_id",
    experiment: ab.Experiment = ab.LIVE,
    k: int = 3,
) -> DataFrame:
    """Questions (``query_id``) screened, embedded, matched with a stored index and
    put into the prompt of their variant."""
    admitted = screen_questions(questions, question, user, experiment=experiment).filter("admitted")
    # screened and embedded once; the search and the prompts both read it
    asked = freeze(embed(admitted, weights, question).withColumnRenamed("embedding", "vector"))
    chunks = questions.sparkSession.read.parquet(f"{path}/chunks")
    return prepare_prompts(asked, chunks, experiment, k, chunk_id="chunk_id")


def prepare_prompts(
    admitted: DataFrame,
    chunks: DataFrame,
    experiment: ab.Experiment = ab.LIVE,
    k: int = 3,
    score_threshold: float | None = None,
    chunk_id: str = "doc_id",
) -> DataFrame:
    """Prompts of admitted questions (``query_id``, ``vector``, ``sanitized_input``).

    ``chunks`` holds ``vector``, ``chunk_text`` and ``chunk_id``, a number of
    its own for every chunk; ``doc_id`` will do where a document is one chunk.
    """
    hits = knn_topk(admitted, chunks, k, score_threshold, doc_id=chunk_id).withColumnRenamed("doc_id", "_chunk")
    # k rows per question meet the chunk table on its id
    texts = hits.join(chunks.select(quoted(chunk_id).cast("long").alias("_chunk"), "chunk_text"), "_chunk")
    template = F.lit(None).cast("string")
    for variant in experiment.variants:
        template = F.when(F.col("variant_id") == variant.id, variant.prompt + "\n\n{input}").otherwise(template)
    return build_prompts(texts, admitted, template, question="sanitized_input")


def log_answers(
    answered: DataFrame, question: str = "sanitized_input", answer: str = "answer", scores: str | None = None
) -> DataFrame:
    """Moderated answers with token counts and cost, ready for the result log."""
    moderated = gr.moderate_output(answered, answer, scores)
    final = moderated.withColumn(
        answer, gr.api_answer(F.col(answer), F.col("violations"), F.col("passed"))
    )
    counted = final.withColumns(
        {"tokens_input": ab.estimate_tokens(F.col(question)), "tokens_output": ab.estimate_tokens(F.col(answer))}
    )
    return counted.withColumn("cost", ab.token_cost(F.col("tokens_input"), F.col("tokens_output")))
