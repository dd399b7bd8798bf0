"""Alerts on timers, streamed sessions, feedback joined as a stream."""

from datetime import datetime, timedelta

import pytest

from ampersift.operators import rollups
from ampersift.streaming import jobs, stateful

START = datetime(2024, 3, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def own(spark):
    return stateful.stateful_session(spark, 2)


class Feed:
    """A folder that a stream reads, one file a batch."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema = spark, str(folder), schema
        spark.createDataFrame([], schema).coalesce(1).write.mode("append").parquet(self.folder)

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)

    @property
    def stream(self):
        schema = self.spark.createDataFrame([], self.schema).schema
        return jobs.stream_table(self.spark, self.folder, schema, files_per_batch=1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def alerts(spark, target):
    return rows(spark.read.parquet(target).select("label", "pending_from", "firing_from"))


def test_a_spell_fires_without_a_next_row(spark, own, tmp_path):
    feed = Feed(own, tmp_path / "in", "label string, ts timestamp_ntz")
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: jobs.drain(stateful.alert_stream(feed.stream, {"a": (0.01, 120), "b": (9.0, 60)}, late="60 seconds"), target, state)
    # ten rows in each half minute for three minutes: over 3 a 300 seconds from the first evaluation on
    feed.add([("a", at(t + i)) for t in range(0, 180, 30) for i in range(10)])
    run()
    before = alerts(spark, target)
    # only another label's row moves the watermark
    feed.add([("b", at(3600))])
    run()
    want = [("a", at(30), at(150))]
    assert before == [] and alerts(spark, target) == want
    # the spell has ended; a new one, over the threshold from 4050 on, fires once more
    feed.add([("a", at(4000 + t)) for t in range(0, 300, 10)])
    feed.add([("b", at(9000))])
    run()
    assert alerts(spark, target) == sorted([*want, ("a", at(4050), at(4170))], key=str)


def test_alerts_equal_batch_islands_over_many_batches(spark, own, tmp_path):
    feed = Feed(own, tmp_path / "in", "label string, ts timestamp_ntz")
    points = [(label, at(600 * b + (i * 37 * (1 + b % 3)) % 600)) for b in range(6) for label, n in (("x", 8 * (b % 2) + 1), ("y", 4)) for i in range(n)]
    for b in range(6):
        feed.add(sorted(p for p in points if at(600 * b) <= p[1] < at(600 * (b + 1))))
    feed.add([("z", at(20_000))])
    target = str(tmp_path / "out")
    rules = {"x": (0.015, 120), "y": (0.005, 300), "z": (1.0, 30)}
    jobs.drain(stateful.alert_stream(feed.stream, rules, late="10 seconds"), target, str(tmp_path / "state"))
    want = []
    for label, (threshold, wait) in rules.items():
        own_rows = spark.createDataFrame([p for p in [*points, ("z", at(20_000))] if p[0] == label], "label string, ts timestamp_ntz")
        found = rollups.alert_for_duration(own_rows, threshold, "ts", ["label"], for_seconds=wait).filter("fired")
        want += rows(found.select("label", "pending_from", "firing_from"))
    assert alerts(spark, target) == sorted(want, key=str) and want


def test_rules_must_fit_the_grid(own, tmp_path):
    feed = Feed(own, tmp_path / "in", "label string, ts timestamp_ntz")
    with pytest.raises(ValueError):
        stateful.alert_stream(feed.stream, {}, range_seconds=100, eval_seconds=30)


def test_sessions_merge_over_batches_and_late_rows_are_kept_apart(spark, own, tmp_path):
    feed = Feed(own, tmp_path / "in", "user string, ts timestamp_ntz, value double")
    feed.add([("u", at(0), 1.0), ("u", at(1700), 2.0), ("v", at(100), 4.0)])
    feed.add([("u", at(3000), 8.0), ("v", at(1900), 16.0)])  # u goes on, v's gap is reached exactly
    feed.add([("w", at(20_000), 32.0)])
    feed.add([("u", at(40), 64.0), ("w", at(20_100), 128.0)])  # the first row is late
    feed.add([("w", at(90_000), 256.0)])
    target, late = str(tmp_path / "out"), str(tmp_path / "late")
    jobs.drain(stateful.session_stream(feed.stream, ["user"], value="value"), target, str(tmp_path / "s1"))
    stateful.late_rows(feed.stream, late, str(tmp_path / "s2"))
    closed = rows(spark.read.parquet(target).drop("batch"))
    on_time = [("u", 0, 1.0), ("u", 1700, 2.0), ("v", 100, 4.0), ("u", 3000, 8.0), ("v", 1900, 16.0), ("w", 20_000, 32.0), ("w", 20_100, 128.0)]
    batch = rollups.sessions(spark.createDataFrame([(u, at(t), v) for u, t, v in on_time], "user string, ts timestamp_ntz, value double"), ["user"], 1800, "ts", "value")
    assert closed == rows(batch)
    assert ("v", at(100), at(100), 1, 4.0) in closed and ("u", at(0), at(3000), 3, 11.0) in closed
    assert rows(spark.read.parquet(late).drop("batch")) == [("u", at(40), 64.0)]


def test_feedback_meets_the_latest_result_or_is_kept(spark, own, tmp_path):
    made = "result_id long, timestamp timestamp_ntz, query string, variant_id string"
    told = "query string, variant_id string, feedback_no long, given_at timestamp_ntz, satisfaction_score double"
    results, feedback = Feed(own, tmp_path / "r", made), Feed(own, tmp_path / "f", told)
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: stateful.feedback_stream(feedback.stream, results.stream, target, state, ["query", "variant_id"])
    stored = [(1, at(0), "q", "a"), (2, at(600), "q", "a"), (3, at(700), "q", "b"), (4, at(50), "p", "a"), (5, at(100_000), "z", "z")]
    results.add(stored[:4])
    feedback.add([("q", "a", 1, at(900), 2.0), ("q", "a", 2, at(950), 5.0), ("q", "b", 3, at(600), 1.0), ("p", "a", 4, at(9000), 3.0), ("none", "a", 5, at(800), 4.0)])
    run()
    results.add(stored[4:])
    feedback.add([("z", "z", 6, at(100_001), 1.5)])
    run()
    run()
    table = spark.createDataFrame([(*r, 0.0) for r in stored], f"{made}, satisfaction_score double")
    updated, lost = stateful.read_feedback(spark, target, table)
    assert {r["result_id"]: r["satisfaction_score"] for r in updated.collect()} == {1: 0.0, 2: 5.0, 3: 0.0, 4: 0.0, 5: 1.5}
    # before its result, too long after it, and of no result at all
    assert sorted(r["feedback_no"] for r in lost.collect()) == [3, 4, 5]


def test_feedback_makes_one_row_for_its_latest_result(spark, own, tmp_path):
    made = "result_id long, timestamp timestamp_ntz, query string, variant_id string"
    told = "query string, variant_id string, feedback_no long, given_at timestamp_ntz, satisfaction_score double"
    results, feedback = Feed(own, tmp_path / "r", made), Feed(own, tmp_path / "f", told)
    target, state = str(tmp_path / "out"), str(tmp_path / "state")
    run = lambda: stateful.feedback_stream(feedback.stream, results.stream, target, state, ["query", "variant_id"])
    stored = [(i, at(i), "q", "a") for i in range(200)] + [((1 << 60) + 1, at(150), "q", "a"), (1 << 60, at(150), "q", "a"), (301, at(170), None, "a")]
    results.add(stored)
    feedback.add([("q", "a", n, at(50 + n), float(n)) for n in range(200)] + [(None, "a", 900, at(180), 1.0)])
    run()
    met = lambda: [(r["feedback_no"], r["result_result_id"]) for r in spark.read.parquet(target).filter("result_result_id IS NOT NULL").collect()]
    want = [(n, (1 << 60) + 1 if n == 100 else min(50 + n, 199)) for n in range(200)]
    # not a row for every earlier result
    assert sorted(met()) == sorted(want)
    # a later result that comes in after its feedback
    results.add([(400, at(240) + timedelta(microseconds=7), "q", "a"), (500, at(90_000), "z", "z")])
    feedback.add([("z", "z", 901, at(90_001), 2.0)])
    run()
    run()
    later = [(n, 400) for n in range(191, 200)] + [(901, 500)]
    assert sorted(met()) == sorted(want + later)
    assert [r[0] for r in spark.read.parquet(target).filter("result_result_id IS NULL").select("feedback_no").collect()] == [900]
