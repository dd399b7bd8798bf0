"""Exact nearest-vector search and embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ampersift.functions.columns import cosine, quoted, similarity
from ampersift.functions.words import letters, word_columns, words_of
from ampersift.session import small_side, trim

# Most query vectors carried to the tasks in one closure (2,048 x 384 doubles = 6 MB).
BLOCK_ROWS = 2048
# Sizes of a block and a shard that meet in one task (65,536 + 50,000 vectors of
# 384 floats = 180 MB); the corpus is copied once per block. A small corpus is cut
# into two shards a core, of LEAST_SHARD rows at least.
PAIR_ROWS = 65_536
SHARD_ROWS = 50_000
LEAST_SHARD = 4096
# Queries and vectors measured at a time, and pairs measured again at a time: what
# a task needs beside its two matrices does not depend on their sizes.
_STRIP_ROWS, _TILE_ROWS, _AGAIN = 256, 4096, 16_384
_MERGE_LANES = 64
# Words whose buckets a task remembers.
_KNOWN_WORDS = 300_000


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    rows = len(column)
    made = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return made.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _square_sums(m: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", m, m)


def _closest(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, position, squared distance) of the k nearest of every query, ties
    by id; in order of the queries, nearest first."""
    k = min(k, len(ids))
    longest = max((float(np.abs(m).max()) for m in (queries, vectors) if m.size), default=0.0)
    # rough distances in single precision, unless their squares do not fit
    kind = np.float32 if longest < 1e15 else np.float64
    rough = vectors.astype(kind, copy=False)
    lengths = _square_sums(rough)
    found = []
    for first in range(0, len(queries), _STRIP_ROWS):
        strip = queries[first : first + _STRIP_ROWS]
        near = strip.astype(kind)
        own = _square_sums(near)
        # the expanded form loses digits, n roundings of what is added up at most on each of the two
        # sides that are compared, and some more; everything close to the limit is measured again
        slack = 3 * (strip.shape[1] + 8) * np.finfo(kind).eps * (own + float(lengths.max()) + np.finfo(kind).tiny)
        near *= -2
        limit = np.full(len(strip), np.inf)
        held, kept, open_ = [], 0, 0
        for at in range(0, len(vectors), _TILE_ROWS):
            # squared distances less ``own``
            gaps = near @ rough[at : at + _TILE_ROWS].T
            gaps += lengths[None, at : at + _TILE_ROWS]
            if not at and gaps.shape[1] >= k:
                limit = np.partition(gaps, k - 1, axis=1)[:, k - 1] + slack
            flat = np.flatnonzero(gaps <= limit.astype(kind)[:, None])
            rows, spots = np.divmod(flat, gaps.shape[1])
            held.append((rows, spots + at, gaps.ravel()[flat]))
            open_ += len(flat)
            if open_ > kept + _AGAIN or at + _TILE_ROWS >= len(vectors):
                rows, spots, gaps = (np.concatenate(x) for x in zip(*held, strict=True))
                order = np.lexsort((gaps, rows))
                ends = np.cumsum(np.bincount(rows, minlength=len(strip)))
                last = np.diff(ends, prepend=0) - k
                limit = np.where(last >= 0, gaps[order[np.maximum(ends - 1 - last, 0)]] + slack, limit) if len(rows) else limit
                near_ = np.flatnonzero(gaps <= limit.astype(kind)[rows])
                held, kept, open_ = [(rows[near_], spots[near_], gaps[near_])], len(near_), 0
        rows, spots, _ = held[0]
        exact = [np.zeros(0)]
        for a in range(0, len(rows), _AGAIN):
            r, c = rows[a : a + _AGAIN], spots[a : a + _AGAIN]
            exact.append(((vectors[c].astype(np.float64) - strip[r].astype(np.float64)) ** 2).sum(1))
        rows, spots, exact = _first_k(rows, spots, np.concatenate(exact), ids, k)
        found.append((rows + first, spots, exact))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _first_k(rows: np.ndarray, spots: np.ndarray, gaps: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k of every row by distance and id, sorted."""
    order = np.lexsort((ids[spots], gaps, rows))
    rows = rows[order]
    starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
    rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
    kept = order[rank < k]
    return rows[rank < k], spots[kept], gaps[kept]


def _measurable(df: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows whose ``vector`` is complete and as long as the longest one of ``queries``."""
    length = queries.agg(F.max(F.size("vector"))).scalar()
    whole = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    return df.filter(F.col("vector").isNotNull() & (F.size("vector") > 0) & (F.size("vector") == length) & whole)


def _merge(partial: DataFrame, k: int) -> DataFrame:
    """Ranks 1..k per query from per-task candidates, in two steps, so the last
    step reads a fixed number of rows per query."""
    nearest = [F.col("distance"), F.col("doc_id")]
    lane = Window.partitionBy("query_id", "lane").orderBy(*nearest)
    final = Window.partitionBy("query_id").orderBy(*nearest)
    return (
        partial.withColumn("_r", F.row_number().over(lane))
        .filter(F.col("_r") <= k)
        .withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= k)
        .select("query_id", "doc_id", "rank", "distance")
    )


def _carried(queries: pd.DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """One pass over the corpus with the query block inside the closure."""
    q_ids = queries["query_id"].to_numpy()
    q_mat = np.array(queries["vector"].tolist())
    schema = pa.schema(
        [("query_id", pa.int64()), ("doc_id", pa.int64()), ("distance", pa.float64())]
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            rows, spots, gaps = _closest(q_mat, _matrix(batch.column("vector")), ids, k)
            rows, ids, gaps = (np.concatenate(x) for x in zip(best, (rows, ids[spots], gaps), strict=True))
            rows, spots, gaps = _first_k(rows, np.arange(len(ids)), gaps, ids, k)
            best = rows, ids[spots], gaps
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[best[0]], pa.int64()), *map(pa.array, best[1:])], schema=schema)

    partial = corpus.mapInArrow(scan, "query_id long, doc_id long, distance double")
    return partial.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(_MERGE_LANES)))


def _blocked(queries: DataFrame, corpus: DataFrame, k: int, blocks: int, shards: int) -> DataFrame:
    """Query blocks against corpus shards, each pair one bounded task."""
    q = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<bigint>"))
    )
    c = corpus.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards))).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>"))
    )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            found, lane = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), 0
        else:
            ids, lane = right["doc_id"].to_numpy(), right["shard"][0].as_py() % _MERGE_LANES
            rows, spots, gaps = _closest(_matrix(left["vector"]), _matrix(right["vector"]), ids, k)
            found = left["query_id"].to_numpy()[rows], ids[spots], gaps
        trim()
        return pa.Table.from_arrays(
            [*map(pa.array, found), pa.array(np.full(len(found[0]), lane, np.int32))], names=["query_id", "doc_id", "distance", "lane"]
        )

    return (
        q.groupBy("block", "shard")
        .cogroup(c.groupBy("block", "shard"))
        .applyInArrow(search, "query_id long, doc_id long, distance double, lane int")
    )


def knn_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 3,
    score_threshold: float | None = None,
    query_id: str = "query_id",
    query_vector: str = "vector",
    doc_id: str = "doc_id",
    doc_vector: str = "vector",
    block_rows: int = BLOCK_ROWS,
    pair_rows: int = PAIR_ROWS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """The k nearest corpus vectors of every query by squared L2 distance.

    Ranks are those before thresholding; a threshold of 0 or None keeps all. Up
    to ``block_rows`` queries (checked by counting) travel with the tasks and
    the corpus is read once without a shuffle; more queries are cut into blocks
    of about ``pair_rows`` that meet corpus shards of about ``shard_rows``.
    Vectors that are missing, hold a missing number or differ in length from the
    longest query vector have no distance: such queries have no hits, such
    corpus rows are no hit.
    """
    q = queries.select(quoted(query_id).cast("long").alias("query_id"), quoted(query_vector).alias("vector"))
    c = corpus.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(doc_vector).alias("vector"))
    q, c = _measurable(q, q), _measurable(c, q)
    head = q.limit(block_rows + 1).toPandas()
    if head.empty:
        partial = c.limit(0).selectExpr("doc_id as query_id", "doc_id", "0D as distance", "0 as lane")
    elif len(head) <= block_rows:
        partial = _carried(head, c, k)
    else:
        blocks = -(-q.count() // pair_rows)
        # for the size of the shards only: nothing has to be embedded for it
        rows = corpus.count()
        shards = max(1, -(-rows // shard_rows), min(2 * c.sparkSession.sparkContext.defaultParallelism, rows // LEAST_SHARD))
        partial = _blocked(q, c, k, blocks, shards)
    ranked = _merge(partial, k).withColumn("score", similarity(F.col("distance")))
    return ranked.filter(F.col("score") >= score_threshold) if score_threshold else ranked


def hybrid_topk(dense_hits: DataFrame, k: int = 3) -> DataFrame:
    """The first k dense hits; the dense ranking is the only leg there is."""
    return dense_hits.filter(F.col("rank") <= k)


def mean_vectors(df: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per group, combined map-side."""
    return df.groupBy(by).agg(
        vector_to_array(Summarizer.mean(array_to_vector(quoted(vector).cast("array<double>")))).alias("vector")
    )


def similarity_to_mean(df: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """Cosine ``similarity`` of every vector to the mean of its group."""
    means = small_side(mean_vectors(df, by, vector).withColumnRenamed("vector", "_mean"))
    return df.join(means, by).withColumn("similarity", cosine(quoted(vector), F.col("_mean"))).drop("_mean")


def source_rows(hits: DataFrame, documents: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """Hits with the first 300 characters, source and score of their document."""
    return hits.join(documents, "doc_id").select(
        "query_id",
        "rank",
        "doc_id",
        "score",
        F.substring(quoted(text), 1, 300).alias("content"),
        F.coalesce(quoted(source), F.lit("unknown")).alias("source"),
    )


class _Buckets:
    """The bucket of every word: the first 32 bits of its md5 by ``dimension``, looked
    up once for the different words of a batch."""

    def __init__(self, dimension: int, letters_: np.ndarray):
        self.dimension, self.letters, self.known = dimension, letters_, {}

    def counts(self, plain: pa.Array, words: pa.Array) -> np.ndarray:
        """(rows x dimension) words in each bucket."""
        row, words = words_of(self.letters, plain, words)
        coded, known, found = words.dictionary_encode(), self.known, []
        if len(known) > _KNOWN_WORDS:
            known.clear()
        for word in coded.dictionary.to_pylist():
            at = known.get(word)
            if at is None:
                at = known[word] = int(md5(word.encode(), usedforsecurity=False).hexdigest()[:8], 16) % self.dimension
            found.append(at)
        at = row * self.dimension + np.array(found, np.int64)[coded.indices.to_numpy()]
        return np.bincount(at, minlength=len(plain) * self.dimension).reshape(-1, self.dimension)


def bucket_weights(df: DataFrame, text: str = "text", dimension: int = 384) -> np.ndarray:
    """Inverse document frequency of every bucket; one number per dimension comes to the driver."""

    table = letters(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, held = _Buckets(dimension, table), np.zeros(dimension + 1, np.int64)
        for batch in batches:
            held[:-1] += (buckets.counts(*batch.columns) > 0).sum(axis=0)
            held[-1] += batch.num_rows
        buckets = None
        trim()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimension + 1)), pa.array(held)], names=["b", "n"])

    found = np.zeros(dimension + 1)
    for b, n in df.select(*word_columns(text)).mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n")).collect():
        found[b] = n
    return np.log((found[-1] + 1) / (found[:-1] + 1))


def embed(df: DataFrame, weights: np.ndarray, text: str = "text") -> DataFrame:
    """Unit-length weighted bucket counts in column ``embedding``; a text without
    words, or of buckets without weight only, has the zero vector."""
    dimension, table = len(weights), letters(df.sparkSession)

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        buckets = _Buckets(dimension, table)
        for batch in batches:
            counts = buckets.counts(*batch)
            out = np.zeros(counts.shape, np.float32)
            for row, v in enumerate(counts * weights):
                size = np.sqrt((v * v).sum())
                out[row] = v / size if size > 0 else v
            yield pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * dimension, pa.int32()), pa.array(out.ravel()))
        buckets = counts = out = None
        trim()

    return df.withColumn("embedding", vectors(*word_columns(text)))


def hash_embed(df: DataFrame, text: str = "text", dimension: int = 384) -> DataFrame:
    """Hashed TF-IDF vectors in column ``embedding``, weighted by the rows of ``df``."""
    return embed(df, bucket_weights(df, text, dimension), text)
