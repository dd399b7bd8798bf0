"""Readers and writers for tables, feature CSVs and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ampersift.functions.columns import quoted
from ampersift.operators.upserts import keep_last

TIMESTAMP_TEXT = "yyyy-MM-dd HH:mm:ss"

# The hourly energy table.
ENERGY_SCHEMA = T.StructType(
    [T.StructField("datetime", T.TimestampNTZType())]
    + [
        T.StructField(n, T.DoubleType())
        for n in (
            "temperature_C",
            "humidity_%",
            "wind_speed_mps",
            "cloud_cover_%",
            "solar_radiation_Wm2",
            "pm10",
            "pm2_5",
            "co",
            "no2",
            "so2",
            "o3",
            "aqi_us",
            "carbon_intensity_actual",
            "carbon_intensity_forecast",
        )
    ]
    + [T.StructField("carbon_index", T.StringType())]
    + [
        T.StructField(n, T.DoubleType())
        for n in (
            "retail_price_£_per_kWh",
            "uk_gen_biomass_%",
            "uk_gen_imports_%",
            "uk_gen_gas_%",
            "uk_gen_nuclear_%",
            "uk_gen_solar_%",
            "uk_gen_wind_%",
        )
    ]
)

AB_RESULT_SCHEMA = (
    "variant_id string, variant_name string, query string, answer string, latency double, "
    "tokens_input int, tokens_output int, cost double, timestamp string, "
    "satisfaction_score double, retrieval_scores array<double>"
)

GUARDRAIL_EVENT_SCHEMA = (
    "event_type string, timestamp string, result struct<passed boolean, "
    "violations array<struct<type string, message string, severity string>>, "
    "sanitized_input string, sanitized_output string, "
    "pii_detected array<struct<type string, score double, start int, end int, text string>>, "
    "injection_detected boolean, toxicity_scores map<string,double>, hallucination_detected boolean, "
    "metadata map<string,string>, timestamp string, latency_ms double>"
)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly when a scan yields fewer partitions than cores.

    For costly per-row work on a few unsplittable files. A large table has more
    scan partitions than cores and stays as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_hourly_csv(
    spark: SparkSession, path: str, schema: T.StructType = ENERGY_SCHEMA, ts: str = "datetime"
) -> DataFrame:
    """A feature CSV with typed columns; rows are sorted where they are written."""
    return spark.read.schema(schema).option("header", True).csv(path)


def read_previous(spark: SparkSession, path: str, schema: T.StructType = ENERGY_SCHEMA) -> DataFrame:
    """Like ``read_hourly_csv``; a path that does not exist is an empty table."""
    try:
        return read_hourly_csv(spark, path, schema)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        return spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str, ts: str | None = "datetime", text_time: bool = False) -> None:
    """Overwrite a CSV table with header; optionally render the time as text."""
    out = df
    if ts:
        out = out.orderBy(quoted(ts))
        if text_time:
            out = out.withColumn(ts, F.date_format(quoted(ts), TIMESTAMP_TEXT))
    out.write.mode("overwrite").option("header", True).csv(path)


def json_lines(df: DataFrame, line: str, schema: str) -> DataFrame:
    """Parse a column of JSON lines; blank lines are skipped."""
    text = quoted(line)
    return df.filter(F.trim(text) != "").withColumn("_j", F.from_json(text, schema)).select(
        *[quoted(c) for c in df.columns if c != line], "_j.*"
    )


def read_json_lines(spark: SparkSession, path: str, schema: str, glob: str | None = None) -> DataFrame:
    """A JSON-lines file, or those files of a folder that match ``glob``."""
    reader = spark.read.schema(schema)
    return reader.option("pathGlobFilter", glob).json(path) if glob else reader.json(path)


def append_json_log(df: DataFrame, path: str, ts: str) -> None:
    """Append events to a JSON-lines log with one folder per day."""
    dated = df.withColumn("event_date", F.date_format(quoted(ts), "yyyyMMdd"))
    dated.write.mode("append").partitionBy("event_date").json(path)


def append_csv_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def metric_upsert(
    existing: DataFrame, updates: DataFrame, key: str = "key", order: Sequence[str] = ("ts",)
) -> DataFrame:
    """Merge metric snapshots: an update replaces the stored value of its key."""
    both = existing.withColumn("_src", F.lit(0)).unionByName(
        updates.withColumn("_src", F.lit(1)), allowMissingColumns=True
    )
    return keep_last(both, [key], ["_src", *order]).drop("_src")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Whole txt and md files as rows (``filename``, ``source``, ``text``, ``error``).

    Hidden files are skipped by Spark, other types by the name filter. A file that
    is not UTF-8 has no text and says so in ``error``; others have none.
    """
    content = F.col("content").cast("string")
    sound = F.is_valid_utf8(content)
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{txt,md}")
        .load(folder)
        .select(
            F.col("_metadata.file_name").alias("filename"),
            F.col("_metadata.file_path").alias("source"),
            F.when(sound, content).alias("text"),
            F.when(~sound, "not UTF-8").alias("error"),
        )
    )
    if files.isEmpty():
        raise ValueError(f"No documents found in {folder}")
    return files


def supported_documents(df: DataFrame, filename: str = "filename") -> DataFrame:
    """The file-name rules of ``read_documents`` for documents already in a table."""
    name = quoted(filename)
    return df.filter(~name.startswith(".") & (name.endswith(".txt") | name.endswith(".md")))


def save_index(chunks: DataFrame, metadata: DataFrame, path: str) -> None:
    """Chunk table and its one-row description."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    metadata.write.mode("overwrite").parquet(f"{path}/metadata")


def to_utc(ts: str | Column, zone: str) -> Column:
    """Local wall time of ``zone`` as zone-less UTC."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), t.cast(T.TimestampNTZType()))
