"""Bucketed random projections against the exact search."""

import numpy as np
import pytest

from ampersift.operators import approximate
from ampersift.operators.retrieval import knn_topk


def clustered(spark, n=4000, size=24, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (80, size))
    rows = [(i, [float(x) for x in centres[i % 80] + rng.normal(0, 0.05, size)]) for i in range(n)]
    asked = [(i, [float(x) for x in centres[i] + rng.normal(0, 0.05, size)]) for i in range(0, 80, 2)]
    return spark.createDataFrame(rows, "doc_id long, vector array<double>"), spark.createDataFrame(asked, "query_id long, vector array<double>")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_recall_and_work_on_clustered_vectors(spark, out_dir):
    corpus, asked = clustered(spark)
    approximate.build_vector_index(corpus, out_dir)
    exact = approximate.approximate_topk(asked, out_dir, k=10, exact=True)
    assert rows(exact.select("query_id", "doc_id", "rank")) == rows(knn_topk(asked, corpus, 10).select("query_id", "doc_id", "rank"))
    found = approximate.approximate_topk(asked, out_dir, k=10).cache()
    figures = approximate.recall(found, exact).groupBy().sum("met", "wanted").first()
    assert figures[0] >= 0.95 * figures[1]
    assert approximate.candidates(asked, out_dir).count() <= 0.1 * 4000 * 40
    # what was found has its exact distance, in order
    known = {(q, d): g for q, d, g in exact.select("query_id", "doc_id", "distance").collect()}
    for q, d, g in found.select("query_id", "doc_id", "distance").collect():
        assert (q, d) not in known or known[q, d] == pytest.approx(g, rel=1e-9)


def test_probes_and_agreement_widen_the_search(spark, out_dir):
    corpus, asked = clustered(spark, 800, 8)
    approximate.build_vector_index(corpus, out_dir, tables=16)
    sizes = [approximate.candidates(asked, out_dir, probes, agree).count() for probes, agree in ((0, 12), (1, 12), (3, 12), (3, 4))]
    assert sizes == sorted(sizes) and sizes[0] < sizes[-1]


def test_incomplete_vectors_thresholds_and_empty_tables(spark, out_dir, tmp_path):
    corpus = spark.createDataFrame(
        [(1, [0.0, 0.0]), (2, [0.1, 0.0]), (3, [None, 1.0]), (4, [1.0]), (5, None), (6, [float("nan"), 0.0]), (7, [5.0, 5.0])],
        "doc_id long, vector array<double>",
    )
    asked = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0]), (3, None)], "query_id long, vector array<double>")
    approximate.build_vector_index(corpus, out_dir, tables=8, width=0.5)
    got = rows(approximate.approximate_topk(asked, out_dir, 3, agree=1).select("query_id", "doc_id", "rank"))
    assert got[:2] == [(1, 1, 1), (1, 2, 2)] and {r[0] for r in got} == {1} and {r[1] for r in got} <= {1, 2, 7}
    assert rows(approximate.approximate_topk(asked, out_dir, 3, 0.999, agree=1).select("doc_id")) == [(1,)]
    empty = str(tmp_path / "none")
    approximate.build_vector_index(corpus.limit(0), empty)
    assert approximate.approximate_topk(asked, empty).count() == 0


def test_vectors_of_zeros(spark, out_dir):
    corpus = spark.createDataFrame([(i, [0.0, 0.0, 0.0]) for i in range(5)], "doc_id long, vector array<double>")
    approximate.build_vector_index(corpus, out_dir)
    asked = spark.createDataFrame([(9, [0.0, 0.0, 0.0])], "query_id long, vector array<double>")
    assert rows(approximate.approximate_topk(asked, out_dir, 2).select("doc_id", "rank")) == [(0, 1), (1, 2)]
