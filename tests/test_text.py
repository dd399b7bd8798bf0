import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ampersift.operators import text


def brute_force(s, size, overlap, separators):
    """The same splitting rule, written over lists of pieces."""
    sep = next((x for x in separators if x == "" or x in s), separators[-1])
    rest = separators[separators.index(sep) + 1 :]
    if sep:
        parts = s.split(sep)
        parts = [p for p in [parts[0]] + [sep + p for p in parts[1:]] if p]
    else:
        parts = list(s)

    def flush(run):
        done, current = [], []
        for p in run:
            if sum(map(len, current)) + len(p) > size and current:
                done.append("".join(current).strip())
                while sum(map(len, current)) > overlap or (current and sum(map(len, current)) + len(p) > size):
                    current = current[1:]
            current.append(p)
        if current:
            done.append("".join(current).strip())
        return [d for d in done if d]

    out, run = [], []
    for p in parts:
        if len(p) < size:
            run.append(p)
        else:
            out += flush(run)
            run = []
            out += brute_force(p, size, overlap, rest) if rest else [p]
    return out + flush(run)


def random_text(rng):
    words = ["a", "energy", "wind.", "solar panel", "x" * 30, "\n", "\n\n", ". ", "  "]
    return " ".join(rng.choice(words) for _ in range(rng.randrange(0, 120)))


def test_splitter_matches_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        s = random_text(rng)
        size = rng.choice([10, 25, 60])
        overlap = rng.choice([0, 3, size // 2])
        assert text.split_recursive(s, size, overlap) == brute_force(s, size, overlap, list(text.SEPARATORS))


def test_chunks_on_documents_respect_size_and_cover(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    chunks = text.chunk_recursive(docs)
    assert chunks.filter("chunk_size > 1000 or chunk_size = 0").count() == 0
    got = chunks.groupBy("doc_id").agg(F.collect_list(F.struct("chunk_pos", "chunk_text")).alias("c")).join(docs, "doc_id")
    for row in got.limit(40).collect():
        assert [c.chunk_text for c in sorted(row.c)] == text.split_recursive(row.text)
        squeezed = "".join(row.text.split())
        at = 0
        for c in sorted(row.c):
            piece = "".join(c.chunk_text.split())
            found = squeezed.rfind(piece, 0, at + len(piece))
            assert found >= 0
            at = max(at, found + len(piece))
        assert at == len(squeezed)


def test_empty_and_null_texts_have_no_chunks(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, " \n "), (4, "ok")], "doc_id int, text string")
    assert [r.doc_id for r in text.chunk_recursive(df).collect()] == [4]
    assert sorted(r.doc_id for r in text.chunk_fixed(df).collect()) == [3, 4]


def test_fixed_chunks_equal_the_character_level_splitter(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdef") for _ in range(n)) for n in (1, 99, 100, 101, 180, 181, 260, 777)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {}
    for r in text.chunk_fixed(df, size=100, overlap=20).orderBy("doc_id", "chunk_pos").collect():
        got.setdefault(r.doc_id, []).append(r.chunk_text)
    assert got == {i: text.split_recursive(t, 100, 20, [""]) for i, t in enumerate(texts)}


def test_dense_ids_follow_document_order(spark):
    df = spark.createDataFrame([(2, "x" * 2500), (1, "y" * 1200)], "doc_id int, text string")
    rows = text.number_chunks(text.chunk_fixed(df)).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.doc_id, r.chunk_pos) for r in rows] == [(0, 1, 0), (1, 1, 1), (2, 2, 0), (3, 2, 1), (4, 2, 2)]


def test_judge_scores(spark):
    replies = ["4", "Score: 5/5", "none", "", "0", "007", "9", "1 2", None, "9" * 40]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "id int, r string")
    got = [x.s for x in df.orderBy("id").select(text.judge_score("r").alias("s")).collect()]
    assert got == [4, 5, 3, 3, 1, 5, 5, 5, 3, 5]


def test_prompt_filling_and_missing_context(spark):
    hits = spark.createDataFrame([(1, 2, "second"), (1, 1, "first")], "query_id int, rank int, chunk_text string")
    asked = spark.createDataFrame([(1, "why?"), (2, "how?")], "query_id int, question string")
    out = {r.query_id: r.prompt for r in text.build_prompts(hits, asked, "C: {context} Q: {input}").collect()}
    assert out == {1: "C: first\n\nsecond Q: why?", 2: "C:  Q: how?"}


def test_history_before_the_last_user_turn(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "user", "u2"), (1, 4, "assistant", "a2"), (2, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    out = text.conversation_history(df, text.last_user_turns(df)).orderBy("position").collect()
    assert [(r.conv_id, r.role, r.content) for r in out] == [(1, "human", "u1"), (1, "assistant", "a1")]


def test_request_rules(spark):
    df = spark.createDataFrame([("ok question", None, 5.0), ("no", 3, None), ("ok question", 11, 6.0)], "question string, top_k int, s double")
    out = [tuple(r)[3:] for r in text.request_rules(df, satisfaction="s").collect()]
    assert out == [(True, True, True, True), (False, True, True, False), (True, False, False, False)]


def test_lint_and_coverage(spark):
    df = spark.createDataFrame([("  ",), ("solar PANELS and heating",), ("z" * 4001,)], "t string")
    flags = [tuple(r) for r in df.select(*text.lint_flags("t").values()).collect()]
    assert flags == [(True, False), (False, False), (False, True)]
    assert [r[0] for r in df.select(text.keyword_coverage("t")).collect()] == pytest.approx([0, 0.4, 0])


def test_exposition_lines(spark):
    df = spark.createDataFrame([("RMSE", 0.5), ("rmse", 0.25)], "key string, value double")
    rows = text.metric_exposition(df).collect()
    assert [tuple(r) for r in rows] == [
        ("rmse", "No description available", "rmse 0.5"),
        ("rmse", "Root Mean Squared Error of predictions", "rmse 0.25"),
    ]


def test_chunk_function_in_sql(spark):
    texts = ["", None, "  \n ", "short", "a. b. c\n\n" * 300, "x" * 2500, "word " * 900, "é ü. " * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    text.register_chunk(spark)
    made = spark.sql("SELECT d.doc_id, c.* FROM {docs} d, LATERAL chunk(d.text, 300, 50) c", docs=docs)
    want = text.chunk_recursive(docs, size=300, overlap=50).select("doc_id", "chunk_pos", "chunk_text", "chunk_size")
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, want.collect())) and made.count() > 20


def test_chunk_coverage_sees_what_is_lost(spark):
    rows = [
        (1, "one two three", ["one two", "two three"], True, True),
        (2, "one two three", ["one", "three"], True, False),
        (3, "one two three", ["three", "four"], False, False),
        (4, " one\n\ntwo ", ["one", "two"], True, True),
        (5, "one two", ["one"], True, False),
        (6, "aaa aaa aaa", ["aaa", "aaa", "aaa"], True, True),
        (7, "one two three", ["three", "one two"], True, False),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, chunks array<string>")
    got = {r["doc_id"]: (r["in_text"], r["complete"]) for r in text.chunk_coverage(df, "text", "chunks").collect()}
    assert got == {r[0]: r[3:] for r in rows}


def test_a_worker_gets_batches_bounded_by_bytes(spark):
    @F.pandas_udf("long")
    def batch_size(texts: pd.Series) -> pd.Series:
        return pd.Series([texts.str.len().sum()] * len(texts))

    long_texts = spark.range(0, 24, 1, 1).select(F.repeat(F.lit("abcdefgh"), 250_000).alias("text"))
    # 48 MB in all
    assert long_texts.select(batch_size("text").alias("n")).agg(F.max("n")).first()[0] <= 16_000_000


def test_chunk_function_moves_no_text_with_each_chunk(spark, tmp_path):
    from ampersift.queries import answers
    from ampersift.queries.registry import QUERIES

    rows = [(1, "a b. " * 700), (2, ""), (3, None), (4, "x" * 2500), (5, " \n")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    made = QUERIES["chunk_function"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in made.collect()) == [(i, True, True, True, True) for i in (1, 4)]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    keys = re.findall(r"Aggregate \[([^\]]*)\]", plan)
    assert keys and not any("text#" in k for k in keys)
