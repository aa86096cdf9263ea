"""Session directories: metadata.json, transcript.jsonl and events.jsonl below a folder named as the session (S3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _session() -> Column:
    return F.element_at(F.split(F.input_file_name(), "/"), -2)


def _lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Raw lines with their session and place; blank ones are passed over."""
    rows = spark.read.text(f"{path}/*/{name}", lineSep="\n").select(F.url_decode(_session()).alias("session_id"), F.monotonically_increasing_id().alias("line_no"), F.trim("value").alias("line"))
    return rows.filter("line <> ''")


def _time(line: Column) -> Column:
    """metadata.timestamp, else ts, else timestamp."""
    return F.coalesce(*(F.get_json_object(line, p) for p in ("$.metadata.timestamp", "$.ts", "$.timestamp"))).try_cast("timestamp")


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    at = lambda p: F.get_json_object("line", p)
    return _lines(spark, path, "transcript.jsonl").select("session_id", "line_no", at("$.role").alias("role"), at("$.content").alias("content"), at("$.turn").cast("int").alias("turn"), _time(F.col("line")).alias("ts"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    at = lambda p: F.get_json_object("line", p)
    return _lines(spark, path, "events.jsonl").select("session_id", "line_no", at("$.event").alias("event"), at("$.lvl").alias("lvl"), at("$.turn").cast("int").alias("turn"), _time(F.col("line")).alias("ts"), F.col("line").alias("data"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Whole metadata files; what no column holds stays in metadata. The project is "unknown" if not given."""
    at = lambda p: F.get_json_object("value", p)
    rows = spark.read.text(f"{path}/*/metadata.json", wholetext=True)
    return rows.select(
        F.url_decode(_session()).alias("session_id"), at("$.user_id").alias("user_id"), at("$.host_id").alias("host_id"), F.coalesce(at("$.project_slug"), F.lit("unknown")).alias("project_slug"), at("$.bundle").alias("bundle"),
        at("$.created").try_cast("timestamp").alias("created"), at("$.updated").try_cast("timestamp").alias("updated"), F.coalesce(at("$.turn_count").cast("int"), F.lit(0)).alias("turn_count"), F.col("value").alias("metadata"),
    )
