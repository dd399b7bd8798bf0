"""The corpus pipeline: language ID, near-dedup, decontamination, PII, packing.

Every stage takes the documents its predecessor kept. Language ID drops texts
without a letter, near-dedup keeps one document of each group (five words,
similarity 0.8), decontamination drops contaminated documents, the PII stage
replaces personal data by its kind, and packing returns the pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ampersift.llm import decontaminate, language, neardup, packing, pii
from ampersift.llm.common import ready, store, table, without
from ampersift.llm.queries import language_rows, vocabulary_path


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language; texts without a letter go."""
    judged = language.identify(without(docs, *language.FIELDS.names), language_rows(spark, sf_dir))
    return judged.where(judged["lang_pred"] != language.UNKNOWN).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark passages."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("language_id", identify),
    ("minhash_near_dedup", deduplicate),
    ("benchmark_decontamination", decontaminated),
    ("personal_data", redact),
    ("packing", pack),
]

# The language, personal-data and packing stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder before the next."""
    docs = table(ready(spark), sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = store(docs, name)
    return docs
