"""Registered queries against their SQL, and the pipeline against its stages' contracts."""

import duckdb
import pytest

import corpus_pipeline
from ampersift.llm import decontaminate, queries

TABLES = "documents benchmark conversations labels embeddings"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(name, llm, small_dir):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small_dir}/{t}.parquet'")
    df = queries.QUERIES[name](llm, small_dir)
    columns = sorted(df.columns)
    cursor = con.execute(queries.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    spots = [names.index(c) for c in columns]
    want = sorted(tuple(row[i] for i in spots) for row in cursor.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == want


def test_pipeline_stages(llm, small_dir):
    docs = llm.read.parquet(f"{small_dir}/documents.parquet")
    before = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(llm, before, small_dir)
        assert after.columns == docs.columns, name
        after = llm.createDataFrame(after.collect(), docs.schema)
        kept.append({r["doc_id"] for r in after.select("doc_id").collect()})
        before = after
    every = {r["doc_id"] for r in docs.collect()}
    assert kept[0] == every and kept[1] < kept[0] and kept[2] <= kept[1] and kept[3] == kept[2]
    benchmark = llm.read.parquet(f"{small_dir}/benchmark.parquet")
    assert not decontaminate.judged(before, benchmark).where("contaminated").count()
    assert not before.where("text RLIKE '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9-]+'").count()
    packed = corpus_pipeline.run(llm, small_dir).collect()
    assert {r["doc_id"] for r in packed} == kept[3]
