import datetime as dt

from pyspark.sql import functions as F

from ampersift.operators import rollups
from ampersift.operators.upserts import keep_last
from ampersift.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def many_files(df, path, n):
    df.repartition(n).write.parquet(path)
    return path


def test_upsert_over_batches_equals_one_pass(spark, tmp_path):
    rows = [(i % 7, T0 + dt.timedelta(seconds=(i * 37) % 500), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, v int")
    src = many_files(df, f"{tmp_path}/src", 4)
    stream = jobs.stream_table(spark, src, df.schema, files_per_batch=1)
    shaped = stream.withColumn("_seen", F.struct("ts", "v"))
    jobs.upsert_stream(shaped, f"{tmp_path}/out", f"{tmp_path}/ck", ["k"], ["ts", "v"])
    stored = spark.read.parquet(f"{tmp_path}/out")
    assert stored.select("batch").distinct().count() == 4
    got = keep_last(stored.drop("batch", "_seen"), ["k"], ["ts", "v"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, keep_last(df, ["k"], ["ts", "v"]).collect()))
    jobs.compact(spark, f"{tmp_path}/out", f"{tmp_path}/fresh", ["k"], ["ts", "v"])
    again = jobs.read_latest(spark, f"{tmp_path}/fresh", ["k"], ["ts", "v"])
    assert again.count() == 7 and spark.read.parquet(f"{tmp_path}/fresh").count() == 7


def test_windowed_counts_equal_batch(spark, tmp_path):
    rows = [("ab"[i % 2], T0 + dt.timedelta(seconds=i * 13)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
    stream = jobs.stream_table(spark, many_files(df, f"{tmp_path}/src", 3), df.schema, files_per_batch=1)
    jobs.drain(jobs.windowed_counts(stream, ["k"]), f"{tmp_path}/out", f"{tmp_path}/ck", mode="update")
    got = jobs.read_latest(spark, f"{tmp_path}/out", ["window_start", "k"])
    want = df.groupBy(F.window("ts", "5 minutes").alias("w"), "k").count().select("w.start", "k", "count")
    assert sorted(map(tuple, got.select("window_start", "k", "n").collect())) == sorted(map(tuple, want.collect()))


def test_rows_that_come_weeks_late_are_counted(spark, tmp_path):
    for number, day in enumerate((40, 0, 39)):
        rows = [("a", T0 + dt.timedelta(days=day, seconds=60 * i)) for i in range(7)]
        batch = spark.createDataFrame(rows, "k string, ts timestamp_ntz")
        batch.coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
        stream = jobs.stream_table(spark, f"{tmp_path}/src", batch.schema)
        jobs.count_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck", ["k"])
        got = jobs.read_sums(spark, f"{tmp_path}/out", ["window_start", "k"])
        assert got.count() == 2 * (number + 1) and got.agg(F.sum("n")).first()[0] == 7 * (number + 1)


def test_restart_does_not_double_rows(spark, tmp_path):
    df = spark.createDataFrame([(i, T0) for i in range(10)], "k int, ts timestamp_ntz")
    src = many_files(df, f"{tmp_path}/src", 2)
    for _ in range(2):
        jobs.drain(jobs.stream_table(spark, src, df.schema), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10


def test_nothing_to_stream_is_an_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "k int, v int")
    df.write.parquet(f"{tmp_path}/src")
    jobs.upsert_stream(jobs.stream_table(spark, f"{tmp_path}/src", df.schema), f"{tmp_path}/out", f"{tmp_path}/ck", ["k"], ["v"])
    assert jobs.read_latest(spark, f"{tmp_path}/out", ["k"], ["v"]).count() == 0


def test_violation_windows(spark, tmp_path):
    rows = [("fine", T0), ("jailbreak", T0), ("a@b.com", T0 + dt.timedelta(hours=2))]
    df = spark.createDataFrame(rows, "text string, ts timestamp_ntz")
    df.write.parquet(f"{tmp_path}/src")
    counts = jobs.violation_windows(jobs.stream_table(spark, f"{tmp_path}/src", df.schema), "text", "ts")
    jobs.drain(counts, f"{tmp_path}/out", f"{tmp_path}/ck", mode="update")
    got = {(r.window_start.hour, r.outcome): r.n for r in jobs.read_latest(spark, f"{tmp_path}/out", ["window_start", "outcome"]).collect()}
    assert got == {(0, "PASSED"): 1, (0, "PROMPT_INJECTION"): 1, (2, "PII_DETECTED"): 1}


def test_streamed_alerts_equal_batch_spells(spark, tmp_path):
    steady = [("a", T0 + dt.timedelta(seconds=s)) for s in range(0, 1500, 5)]
    burst = [("b", T0 + dt.timedelta(seconds=s)) for s in range(60)]
    events = spark.createDataFrame(steady + burst, "label string, ts timestamp_ntz")
    rates = rollups.rate_sliding(events, "ts", ["label"], 300, 30).select(
        "label", (F.col("window_start") + F.expr("interval 300 seconds")).alias("at"), "rate"
    )
    for part, (low, high) in enumerate([(0, 9), (9, 100)]):
        cut = rates.filter((F.col("at") >= T0 + dt.timedelta(minutes=low)) & (F.col("at") < T0 + dt.timedelta(minutes=high)))
        cut.coalesce(1).write.mode("append").parquet(f"{tmp_path}/src")
        stream = jobs.stream_table(spark, f"{tmp_path}/src", rates.schema)
        jobs.drain(jobs.duration_alerts(stream, "label", "at", "rate", 0.15), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = spark.read.parquet(f"{tmp_path}/out").select("label", "firing_from")
    want = rollups.alert_for_duration(events, 0.15, "ts", ["label"]).filter("fired").select("label", "firing_from")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
