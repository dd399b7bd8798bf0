import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampersift.operators import ordering, sequences


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.6 else rng.choice("abc"), float(rng.randrange(40))) for i in range(500)]
    return rows, spark.createDataFrame(rows, "id int, g string, v double")


def test_row_numbers_with_one_hot_group(skewed):
    rows, df = skewed
    got = {r.id: (r.row_no, r.n) for r in ordering.row_numbers(df, ["v", "id"], ["g"], total="n").collect()}
    for group in {"hot", "a", "b", "c"}:
        members = sorted((v, i) for i, g, v in rows if g == group)
        for k, (_, i) in enumerate(members, 1):
            assert got[i] == (k, len(members))


def test_row_numbers_over_the_whole_table(skewed):
    rows, df = skewed
    got = [r.id for r in ordering.row_numbers(df, ["v", "id"]).orderBy("row_no").collect()]
    assert got == [i for _, i in sorted((v, i) for i, _, v in rows)]


def test_descending_order(skewed):
    _, df = skewed
    out = ordering.row_numbers(df.select("id"), [F.col("id").desc()]).orderBy("row_no").first()
    assert out.id == 499 and out.row_no == 1


def test_prefix_sums_and_previous_value(skewed):
    rows, df = skewed
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = {(r.g, r.v): r for r in ordering.prefix_sums(counts, ["v"], ["n"], ["g"], previous="v").collect()}
    for group in {"hot", "a", "b", "c"}:
        values = [v for _, g, v in rows if g == group]
        for k, v in enumerate(sorted(set(values))):
            row = got[group, v]
            assert row.cum_n == sum(x <= v for x in values) and row.all_n == len(values)
            assert row.prev_v == (sorted(set(values))[k - 1] if k else None)


def test_null_groups_survive(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id int, g string")
    got = {r.id: r.row_no for r in ordering.row_numbers(df, ["id"], ["g"]).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_exact_quantiles_match_numpy(skewed):
    rows, df = skewed
    got = {r.g: r for r in ordering.exact_quantiles(df, "v", {"q10": 0.1, "q50": 0.5, "q99": 0.99}, ["g"]).collect()}
    for group in {"hot", "a", "b", "c"}:
        values = [v for _, g, v in rows if g == group]
        assert [got[group].q10, got[group].q50, got[group].q99] == pytest.approx(list(np.quantile(values, [0.1, 0.5, 0.99])))


def test_splits_of_odd_and_empty_tables(spark):
    five = spark.range(5)
    halves = sequences.half_split(five, ["id"]).groupBy("half").count().collect()
    assert {r.half: r["count"] for r in halves} == {"reference": 2, "current": 3}
    train = sequences.chrono_split(five, ["id"]).filter("split = 'train'").count()
    assert train == 4
    assert sequences.half_split(five.limit(0), ["id"]).count() == 0


def test_selection_with_ties_and_groups(skewed):
    rows, df = skewed
    for share in (0.0, 0.13, 0.5, 0.8, 1.0):
        got = {r.id: r.leading for r in ordering.leading_share(df, ["v", "id"], share, ["g"]).collect()}
        for group in {"hot", "a", "b", "c"}:
            members = [i for _, i in sorted((v, i) for i, g, v in rows if g == group)]
            cut = int(share * len(members))
            assert [got[i] for i in members] == [k < cut for k in range(len(members))]


def test_selection_falls_back_when_the_sketch_misses(skewed, monkeypatch):
    rows, df = skewed
    full = ordering._condensed
    monkeypatch.setattr(ordering, "_condensed", lambda values, shares, by: full(values, [0.01], by))
    got = ordering.exact_quantiles(df, "v", {"q": 0.7}).first().q
    assert got == pytest.approx(np.quantile([v for _, _, v in rows], 0.7))


def test_quantiles_of_many_distinct_values(spark):
    rng = np.random.default_rng(0)
    values = rng.lognormal(size=20_000)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(6)
    wanted = {"a": 0.001, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0, "f": 0.0}
    row = ordering.exact_quantiles(df, "v", wanted).first()
    assert [row[k] for k in wanted] == pytest.approx(list(np.quantile(values, list(wanted.values()))))


def test_condensed_cells_are_few(spark):
    df = spark.range(50_000).select(F.rand(1).alias("_v")).repartition(6)
    cells = ordering._condensed(df, [0.5], [])
    assert cells.count() < 600 and cells.agg(F.sum("n")).first()[0] == 50_000


def test_null_group_and_text_order(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, "x")], "id int, g string")
    got = {r.id: r.leading for r in ordering.leading_share(df, ["id"], 0.5, ["g"]).collect()}
    assert got == {1: True, 2: False, 3: True, 4: False}
    with pytest.raises(TypeError):
        ordering.leading_share(df, ["g"], 0.5)


def test_many_groups_are_joined_without_broadcast(skewed, monkeypatch):
    rows, df = skewed
    monkeypatch.setattr("ampersift.session.BROADCAST_ROWS", 0)
    got = {r.id: r.row_no for r in ordering.row_numbers(df, ["v", "id"], ["g"]).collect()}
    hot = [i for _, i in sorted((v, i) for i, g, v in rows if g == "hot")]
    assert [got[i] for i in hot] == list(range(1, len(hot) + 1))
    assert ordering.exact_quantiles(df, "v", {"q": 0.5}, ["g"]).count() == 4


def test_prefix_sums_across_small_batches_and_null_groups(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(1, 5), rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, v int, n int, w double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.v: r for r in ordering.prefix_sums(df, ["v"], ["n", "w"], ["g"], previous="v").collect()}
        whole = {r.v: r.cum_n for r in ordering.prefix_sums(df.select("v", "n"), ["v"], ["n"]).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    running, last, everything = {}, {}, 0
    for g, v, n, w in rows:
        running[g] = (running.get(g, (0, 0.0))[0] + n, running.get(g, (0, 0.0))[1] + w)
        everything += n
        assert got[v].cum_n == running[g][0] and got[v].cum_w == pytest.approx(running[g][1])
        assert got[v].prev_v == last.get(g) and whole[v] == everything
        last[g] = v
