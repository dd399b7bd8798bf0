"""Tables stored by day: what an append reads, rewrites and leaves alone."""

import glob
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ampersift.plans.energy import append_day
from ampersift.sources.daily import DailyTable

SCHEMA = "station string, datetime timestamp_ntz, value double"


def at(day, hour=0):
    return datetime(2024, 5, 1) + timedelta(days=day, hours=hour)


def table(spark, path, **more):
    return DailyTable(spark, path, spark.createDataFrame([], SCHEMA).schema, ["station", "datetime"], **more)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(path):
    """Every data file by day, with its time of writing."""
    found = {}
    for f in glob.glob(f"{path}/_day=*/*.parquet"):
        found.setdefault(f.split("_day=")[1].split("/")[0], set()).add((f, os.stat(f).st_mtime_ns))
    return found


@pytest.fixture
def stored(spark, tmp_path):
    made = table(spark, str(tmp_path / "t"))
    made.append(spark.createDataFrame([("a", at(d, h), float(d)) for d in range(5) for h in range(3)], SCHEMA))
    return made


def test_append_rewrites_its_days_only(spark, stored):
    before = files(stored.path)
    days = stored.append(spark.createDataFrame([("a", at(3, 1), 30.0), ("b", at(3, 1), 31.0), ("a", at(9), 9.0)], SCHEMA))
    after = files(stored.path)
    assert days == ["2024-05-04", "2024-05-10"]
    assert {d for d in before if before[d] != after[d]} == {"2024-05-04"} and set(after) - set(before) == {"2024-05-10"}
    want = [("a", at(d, h), float(d)) for d in range(5) for h in range(3) if (d, h) != (3, 1)]
    want += [("a", at(3, 1), 30.0), ("b", at(3, 1), 31.0), ("a", at(9), 9.0)]
    assert rows(stored.read()) == sorted(want, key=str)
    assert not os.path.exists(stored._stage)


def test_only_touched_folders_are_scanned(spark, stored):
    plan = stored._stored(["2024-05-02"])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(_day" in plan and "2024-05-02" in plan
    assert len(stored._stored(["2024-05-02"]).inputFiles()) >= 1
    assert rows(stored.read("2024-05-02", "2024-05-03")) == [("a", at(d, h), float(d)) for d in (1, 2) for h in range(3)]


def test_repeated_append_changes_nothing(spark, stored):
    new = spark.createDataFrame([("a", at(1), 7.0), ("c", at(1), 8.0)], SCHEMA)
    stored.append(new)
    once = rows(stored.read())
    stored.append(new)
    assert rows(stored.read()) == once


def test_first_wins_and_order_decides(spark, tmp_path):
    first = table(spark, str(tmp_path / "f"), keep="first")
    first.append(spark.createDataFrame([("a", at(0), 1.0)], SCHEMA))
    first.append(spark.createDataFrame([("a", at(0), 2.0), ("b", at(0), 3.0)], SCHEMA))
    assert rows(first.read()) == [("a", at(0), 1.0), ("b", at(0), 3.0)]
    ordered = table(spark, str(tmp_path / "o"), order=["value"])
    ordered.append(spark.createDataFrame([("a", at(0), 5.0), ("a", at(0), 4.0)], SCHEMA))
    ordered.append(spark.createDataFrame([("a", at(0), 3.0)], SCHEMA))
    assert rows(ordered.read()) == [("a", at(0), 5.0)]
    with pytest.raises(ValueError):
        table(spark, str(tmp_path / "x"), keep="any")


def test_rows_without_a_time_and_empty_appends(spark, stored):
    assert stored.append(spark.createDataFrame([], SCHEMA)) == []
    assert stored.append(spark.createDataFrame([("n", None, 1.0), ("n", None, 2.0)], SCHEMA)) == ["none"]
    stored.append(spark.createDataFrame([("n", None, 3.0), (None, at(0), 4.0)], SCHEMA))
    kept = rows(stored.read())
    assert ("n", None, 3.0) in kept and (None, at(0), 4.0) in kept and len(kept) == 17


def test_columns_are_cast_and_extra_ones_left_out(spark, stored):
    wide = spark.createDataFrame([(1, "a", at(0), 5)], "extra int, station string, datetime timestamp_ntz, value int")
    stored.append(wide)
    assert ("a", at(0), 5.0) in rows(stored.read()) and stored.read().columns == ["station", "datetime", "value"]


def test_dead_append_is_finished_by_the_next_use(spark, stored, monkeypatch):
    new = spark.createDataFrame([("a", at(2), 99.0)], SCHEMA)
    monkeypatch.setattr(DailyTable, "_put_in_place", lambda self: (_ for _ in ()).throw(RuntimeError("driver lost")))
    with pytest.raises(RuntimeError):
        stored.append(new)
    monkeypatch.undo()
    assert ("a", at(2), 99.0) in rows(stored.read())
    # a stage without its mark of success is what a dying task left behind
    os.makedirs(f"{stored._stage}/_temporary")
    assert stored.recover() is False and not os.path.exists(stored._stage)


def test_daily_plan_takes_all_then_one_day(spark, tmp_path):
    made = table(spark, str(tmp_path / "t"))
    history = spark.createDataFrame([("a", at(d), float(d)) for d in range(4)], SCHEMA)
    assert len(append_day(made, history, "2024-05-05")) == 4
    later = history.withColumn("value", F.col("value") + 100)
    assert append_day(made, later, "2024-05-03") == ["2024-05-02"]
    assert rows(made.read()) == [("a", at(0), 0.0), ("a", at(1), 101.0), ("a", at(2), 2.0), ("a", at(3), 3.0)]


def test_stream_rewrites_days_by_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    parts = [[("a", at(0), 1.0), ("a", at(1), 2.0)], [("a", at(1), 3.0), ("b", at(2), 4.0)]]
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        made = table(spark, str(tmp_path / "t"))
        before = files(made.path)
        made.append_stream(spark.readStream.schema(SCHEMA).parquet(source), str(tmp_path / "state"))
        if i:
            after = files(made.path)
            assert before["2024-05-01"] == after["2024-05-01"] and before["2024-05-02"] != after["2024-05-02"]
    assert rows(made.read()) == [("a", at(0), 1.0), ("a", at(1), 3.0), ("b", at(2), 4.0)]
