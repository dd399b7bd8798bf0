import pytest
from pyspark.sql import functions as F

from ampersift.operators import experiments as ab
from ampersift.plans import answering


def test_bucket_edges_are_inclusive(spark):
    df = spark.range(100).select("id", ab.variant_for(F.col("id") / 100.0).alias("v"))
    counts = {r.v: (r.n, r.lo, r.hi) for r in df.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()}
    assert counts == {"control": (41, 0, 40), "concise": (20, 41, 60), "detailed": (20, 61, 80), "conversational": (19, 81, 99)}


def test_assignment_is_stable_and_overrides_are_checked(spark):
    df = spark.createDataFrame([("u1", None), ("u1", None), ("u2", "technical"), ("u3", "poetic"), (None, None), ("", "")], "user_id string, asked string")
    rows = ab.assign_variant(df, "user_id", "asked").collect()
    assert rows[0].variant_id == rows[1].variant_id
    assert (rows[2].variant_id, rows[2].rejected) == ("technical", False)
    assert (rows[3].variant_id, rows[3].rejected) == (None, True)
    assert rows[4].variant_id in ab.TRAFFIC_SPLIT and rows[5].variant_id in ab.TRAFFIC_SPLIT


def test_anonymous_questions_follow_the_split(spark):
    df = spark.range(20_000).select(F.lit(None).cast("string").alias("user_id"))
    share = {r.variant_id: r["count"] / 20_000 for r in ab.assign_variant(df).groupBy("variant_id").count().collect()}
    assert share == pytest.approx(ab.TRAFFIC_SPLIT, abs=0.02)


def test_enabled_subset_and_default_shares():
    two = ab.Experiment.with_enabled(["concise", "unknown", "technical"])
    assert [v.id for v in two.variants] == ["concise", "technical"] and two.fallback == "concise"
    assert two.shares == {"concise": 0.5, "technical": 0.5}
    assert len(ab.Experiment.with_enabled().variants) == 5


LOG = "variant_id string, latency double, tokens_input int, tokens_output int, cost double, satisfaction_score double"


def test_stats_skip_zero_ratings_and_cover_idle_variants(spark):
    log = spark.createDataFrame([("control", 1.0, 10, 20, 0.1, 0.0), ("control", 3.0, 10, 20, 0.3, 4.0), ("concise", 1.0, 1, 1, 0.1, None)], LOG)
    rows = {r.variant_id: r for r in ab.variant_stats(log).collect()}
    assert rows["control"].avg_satisfaction == 4.0 and rows["control"].avg_tokens == 30.0
    assert rows["detailed"].total_queries == 0 and rows["detailed"].total_cost == 0
    summary = {r.variant_id: r for r in ab.ab_summary(log).collect()}
    assert summary["control"].satisfaction_mean == 2.0 and summary["concise"].satisfaction_count == 0
    report = {r.variant_id: r.score for r in ab.variant_report(log).collect()}
    assert report["control"] == pytest.approx(0.3 / 2.1 + 0.3 / 0.201 + 1.6) and report["detailed"] is None


def test_winner_ties_go_to_the_first_variant(spark):
    log = spark.createDataFrame([("detailed", 1.0, 1, 1, 0.1, 3.0), ("concise", 1.0, 1, 1, 0.1, 3.0)], LOG)
    assert ab.comparison_winner(log).first().winner == "concise"
    assert ab.comparison_winner(log.limit(0)).first().winner is None
    ranked = ab.recommend(log).orderBy("rank").collect()
    assert [r.is_winner for r in ranked] == [True, False]


def test_costs(spark):
    row = spark.createDataFrame([("abcdefghi",)], "t string").select(ab.estimate_tokens("t").alias("n")).first()
    assert row.n == 2
    cost = spark.range(1).select(ab.token_cost(F.lit(846), F.lit(187))).first()[0]
    assert cost == pytest.approx(846 * 0.075e-6 + 187 * 0.3e-6)


def test_question_batch(spark):
    asked = spark.createDataFrame([(1, "how to save energy", "u1", [1.0, 0.0]), (2, "jailbreak now", "u2", [0.0, 1.0])], "query_id long, question string, user_id string, vector array<double>")
    screened = answering.screen_questions(asked)
    assert {r.query_id: r.admitted for r in screened.collect()} == {1: True, 2: False}
    chunks = spark.createDataFrame([(i, [float(i), 0.0], f"chunk {i}") for i in range(5)], "doc_id long, vector array<double>, chunk_text string")
    prompts = answering.prepare_prompts(screened.filter("admitted"), chunks, k=2).collect()
    assert len(prompts) == 1 and prompts[0].prompt == "chunk 1\n\nchunk 0\n\nhow to save energy"
    answered = screened.filter("admitted").drop("passed", "violations").withColumn("answer", F.lit("Insulate well."))
    row = answering.log_answers(answered).first()
    assert (row.tokens_input, row.tokens_output) == (4, 3)
