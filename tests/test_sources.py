import datetime as dt

import pytest
from pyspark.sql import functions as F

from ampersift.sources import feeds, tables


def payload(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "payload string")


def test_weather_arrays(spark):
    text = '{"hourly": {"time": ["2024-10-29T00:00", "2024-10-29T01:00"], "temperature_2m": [12.5, null], "wind_speed_10m": [3.0, 4.0]}}'
    rows = feeds.parallel_arrays(payload(spark, text), "payload", feeds.WEATHER_SERIES).orderBy("datetime").collect()
    assert rows[0]["temperature_C"] == 12.5 and rows[1]["temperature_C"] is None
    assert rows[1]["datetime"] == dt.datetime(2024, 10, 29, 1) and rows[0]["humidity_%"] is None


def test_carbon_records(spark):
    text = (
        '{"data": [{"from": "2024-10-29T00:00Z", "intensity": null}, {"from": "2024-10-29T00:30Z"},'
        '{"intensity": {"actual": 1}}, {"from": "soon", "intensity": {"actual": 5}},'
        '{"from": "2024-10-29T01:00Z", "intensity": {"actual": 210, "forecast": 215, "index": "moderate"}}]}'
    )
    everything = feeds.carbon_records(payload(spark, text), "payload")
    assert everything.count() == 4
    day = feeds.carbon_records(payload(spark, text, '{"data": []}'), "payload", F.lit("2024-10-29").cast("date"))
    assert sorted((r.datetime.hour, r.datetime.minute, r.carbon_intensity_actual) for r in day.collect() if r.carbon_intensity_actual) == [(1, 0, 210)]
    assert day.count() == 3
    empty = feeds.carbon_records(payload(spark, '{"data": []}'), "payload")
    assert empty.count() == 0 and len(empty.columns) == 4


def test_generation_mix_keeps_listed_fuels(spark):
    text = '{"data": {"from": "2024-10-29T00:00Z", "generationmix": [{"fuel": "Biomass", "perc": 8}, {"fuel": "gas", "perc": 45}, {"fuel": "Coal", "perc": 1}, {"fuel": "other", "perc": 2}]}}'
    row = feeds.generation_mix(payload(spark, text), "payload").first()
    assert row["uk_gen_biomass_%"] == 8 and row["uk_gen_gas_%"] == 45 and row["uk_gen_wind_%"] is None
    assert not [c for c in row.asDict() if "coal" in c or "other" in c]


def test_tariff_codes(spark):
    with_link = '{"results": [{"code": "FIX-1"}, {"code": "AGILE-2", "links": [{"href": "/a/b/"}, {"href": "/x/electricity-tariffs/E-1R-AGILE-2-C/"}]}]}'
    without = '{"results": [{"code": "AGILE-3", "links": []}]}'
    codes = [tuple(feeds.tariff_of(payload(spark, t), "payload").first()) for t in (with_link, without)]
    assert codes == [("AGILE-2", "E-1R-AGILE-2-C"), ("AGILE-3", "E-1R-AGILE-3-A")]
    with pytest.raises(Exception, match="No matching tariffs"):
        feeds.tariff_of(payload(spark, '{"results": []}'), "payload").collect()


def test_paged_rates(spark):
    pages = (
        '{"results": [{"valid_from": "2024-10-29T00:00:00Z", "value_inc_vat": 25.0}], "next": "page2"}',
        '{"results": [{"valid_from": "2024-10-28T23:30:00Z", "value_inc_vat": 30.0}], "next": null}',
    )
    rates = feeds.price_rates(payload(spark, *pages), "payload")
    assert sorted(r[1] for r in rates.collect()) == [0.25, 0.3]
    assert feeds.price_rates(payload(spark, *pages), "payload", F.lit("2024-10-29").cast("date")).count() == 1


def test_csv_roundtrip_and_missing_path(spark, out_dir):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 5), 1.5), (dt.datetime(2024, 1, 1, 4), None)], "datetime timestamp_ntz, temperature_C double")
    tables.write_csv(df, out_dir, text_time=True)
    back = tables.read_hourly_csv(spark, out_dir, df.schema)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert tables.read_previous(spark, out_dir + "/absent").count() == 0
    assert tables.read_previous(spark, out_dir, df.schema).count() == 2


def test_documents_from_files(spark, tmp_path):
    for name, body in {"a.txt": "alpha\nbeta", "b.md": "# t", "c.pdf": "x", ".hidden.txt": "no", "d.docx": "x"}.items():
        (tmp_path / name).write_text(body, encoding="utf-8")
    rows = {r.filename: r.text for r in tables.read_documents(spark, str(tmp_path)).collect()}
    assert rows == {"a.txt": "alpha\nbeta", "b.md": "# t"}
    (tmp_path / "bad.txt").write_bytes(b"caf\xe9 \xff")
    found = {r.filename: (r.text, r.error) for r in tables.read_documents(spark, str(tmp_path)).collect()}
    assert found == {"a.txt": ("alpha\nbeta", None), "b.md": ("# t", None), "bad.txt": (None, "not UTF-8")}
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        tables.read_documents(spark, str(tmp_path / "none"))


def test_json_lines_skip_blanks_and_globs(spark, tmp_path):
    (tmp_path / "guardrails_1.jsonl").write_text('{"event_type": "input_validation", "result": {"passed": true}}\n\n', encoding="utf-8")
    (tmp_path / "other.jsonl").write_text('{"event_type": "x"}\n', encoding="utf-8")
    log = tables.read_json_lines(spark, str(tmp_path), tables.GUARDRAIL_EVENT_SCHEMA, "guardrails_*.jsonl")
    assert [r.result.passed for r in log.collect()] == [True]
    lines = spark.createDataFrame([('{"k": 1}',), ("  ",), (None,)], "line string")
    assert tables.json_lines(lines, "line", "k int").count() == 1


def test_metric_snapshots_merge(spark):
    old = spark.createDataFrame([("rmse", 1.0, 1), ("mae", 2.0, 1)], "key string, value double, ts int")
    new = spark.createDataFrame([("rmse", 3.0, 0)], "key string, value double, ts int")
    assert {r.key: r.value for r in tables.metric_upsert(old, new).collect()} == {"rmse": 3.0, "mae": 2.0}


def test_logs_append(spark, out_dir):
    df = spark.createDataFrame([(dt.datetime(2025, 12, 10), 1)], "at timestamp_ntz, n int")
    tables.append_json_log(df, out_dir, "at")
    tables.append_json_log(df, out_dir, "at")
    assert spark.read.json(out_dir).filter("event_date = 20251210").count() == 2
    tables.append_csv_rows(df, out_dir + "-csv")
    assert spark.read.option("header", True).csv(out_dir + "-csv").count() == 1
    tables.save_index(df, df, out_dir + "-index")
    assert spark.read.parquet(out_dir + "-index/metadata").count() == 1
