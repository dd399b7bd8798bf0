"""Approximate nearest vectors: bucketed random projections.

Spark ML projects every vector on random directions and cuts each projection into
buckets. The index stores, sorted by table and bucket, which vectors a bucket
holds. A question looks into its own bucket and those beside it in every table;
vectors met in enough tables are candidates, and these alone are measured
exactly. ``exact=True`` measures all vectors instead.
"""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH, BucketedRandomProjectionLSHModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ampersift.functions.columns import quoted, similarity, squared_l2
from ampersift.operators.keyword import ranked
from ampersift.operators.retrieval import knn_topk
from ampersift.session import small_side

# Directions, and the width of a bucket as a share of the vectors' root mean square.
TABLES, WIDTH = 32, 0.1
# Buckets to look into on either side, and tables that have to agree.
PROBES, AGREE = 1, 22
SEED = 42


def _complete(df: DataFrame, row_id: str, vector: str) -> DataFrame:
    """Rows whose vector is complete, as doubles."""
    v = quoted(vector).cast("array<double>")
    whole = F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    return df.select(quoted(row_id).cast("long").alias("id"), v.alias("vector")).filter(whole)


def _buckets(model: BucketedRandomProjectionLSHModel, rows: DataFrame) -> DataFrame:
    """One row per vector and table with its bucket."""
    hashed = model.transform(rows.withColumn("features", array_to_vector("vector")))
    numbers = F.transform("hashes", lambda h: F.get(vector_to_array(h), 0).cast("long"))
    return hashed.select("id", F.posexplode(numbers).alias("table", "bucket"))


def build_vector_index(
    corpus: DataFrame,
    path: str,
    doc_id: str = "doc_id",
    vector: str = "vector",
    tables: int = TABLES,
    width: float = WIDTH,
    seed: int = SEED,
) -> None:
    """Store directions, buckets and vectors of ``corpus`` under ``path``.

    The directions are drawn, not learned, so nothing is fitted on a sample; a
    bucket is ``width`` of the root mean square length wide. Vectors that are
    incomplete or of another length than the longest are no hits.
    """
    rows = _complete(corpus, doc_id, vector)
    length = rows.agg(F.max(F.size("vector"))).scalar()
    rows = rows.filter(F.size("vector") == length)
    rows.withColumnRenamed("id", "doc_id").write.mode("overwrite").parquet(f"{path}/vectors")
    stored = corpus.sparkSession.read.parquet(f"{path}/vectors").withColumnRenamed("doc_id", "id")
    mean = stored.agg(F.sqrt(F.avg(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))).first()[0]
    if mean is None:
        return
    projection = BucketedRandomProjectionLSH(
        inputCol="features", outputCol="hashes", numHashTables=tables, bucketLength=width * (mean or 1.0), seed=seed
    )
    model = projection.fit(stored.withColumn("features", array_to_vector("vector")).limit(1))
    model.write().overwrite().save(f"{path}/directions")
    placed = _buckets(model, stored).withColumnRenamed("id", "doc_id")
    # neighbouring buckets lie together, so a probe skips most row groups
    placed.repartitionByRange("table", "bucket", "doc_id").sortWithinPartitions("table", "bucket").write.mode("overwrite").parquet(f"{path}/buckets")


def candidates(
    questions: DataFrame, path: str, probes: int = PROBES, agree: int = AGREE, query_id: str = "query_id", vector: str = "vector"
) -> DataFrame:
    """(query_id, doc_id) met in at least ``agree`` tables, ``probes`` buckets to
    either side. Meetings are counted in each task before they are shuffled."""
    spark = questions.sparkSession
    model = BucketedRandomProjectionLSHModel.load(f"{path}/directions")
    asked = _buckets(model, _complete(questions, query_id, vector)).withColumnRenamed("id", "query_id")
    near = F.explode(F.sequence(F.col("bucket") - probes, F.col("bucket") + probes))
    wanted = small_side(asked.select("query_id", "table", near.alias("bucket")))
    met = spark.read.parquet(f"{path}/buckets").join(wanted, ["table", "bucket"])
    return met.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("tables")).filter(F.col("tables") >= agree).drop("tables")


def approximate_topk(
    questions: DataFrame,
    path: str,
    k: int = 3,
    score_threshold: float | None = None,
    exact: bool = False,
    probes: int = PROBES,
    agree: int = AGREE,
    query_id: str = "query_id",
    vector: str = "vector",
) -> DataFrame:
    """The k nearest of a stored index: query_id, doc_id, rank, distance, score.

    As ``knn_topk``, but of the candidates only; ``exact=True`` looks at all
    vectors. Distances are exact either way. More ``probes`` or a lower ``agree``
    find more and measure more.
    """
    spark = questions.sparkSession
    stored = spark.read.parquet(f"{path}/vectors")
    if exact or stored.isEmpty():
        return knn_topk(questions, stored, k, score_threshold, query_id, vector)
    length = stored.agg(F.max(F.size("vector"))).scalar()
    asked = questions.filter(F.size(quoted(vector)) == length)
    found = candidates(asked, path, probes, agree, query_id, vector)
    whole = small_side(_complete(asked, query_id, vector).select(F.col("id").alias("query_id"), F.col("vector").alias("_q")))
    measured = found.join(stored, "doc_id").join(whole, "query_id").select("query_id", "doc_id", squared_l2(F.col("_q"), F.col("vector")).alias("distance"))
    best = ranked(measured.withColumn("score", -F.col("distance")), k)
    out = best.select("query_id", "doc_id", "rank", (-F.col("score")).alias("distance")).withColumn("score", similarity(F.col("distance")))
    return out.filter(F.col("score") >= score_threshold) if score_threshold else out


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Of the exact hits of each question, how many were found: query_id, wanted, met."""
    met = exact.join(found.select("query_id", "doc_id", F.lit(1).alias("_met")), ["query_id", "doc_id"], "left")
    return met.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"), F.count("_met").alias("met"))


def open_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vectors")
