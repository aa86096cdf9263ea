"""The star-schema test tables seen as sessions, messages, events and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.layout import by_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sessions(spark: SparkSession, sf_dir: str, counted: bool = True) -> DataFrame:
    """Orders; counted ones have turn_count and updated from their line items."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("project_slug"), F.col("o_orderstatus").alias("bundle"), F.col("o_orderdate").alias("created"))
    if not counted:
        return o
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("session_id")).agg(F.count("*").cast("int").alias("turn_count"), F.max("l_shipdate").alias("updated"))
    return o.join(n, "session_id", "left").withColumn("turn_count", F.coalesce("turn_count", F.lit(0)))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_shipdate").alias("ts"), F.col("l_returnflag").alias("role"))


def numbered_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a sequence within their order; the number given to them isn't unique."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return by_key(table(spark, sf_dir, "lineitem"), "l_orderkey").select(F.col("l_orderkey").alias("session_id"), (F.row_number().over(w) - 1).alias("sequence"), F.col("l_linenumber").alias("turn"), F.col("l_shipdate").alias("ts"), F.col("l_returnflag").alias("role"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.col("conv_id").cast("string"), F.lit("_msg_"), F.col("turn").cast("string")).alias("id"), F.lit("u").alias("user_id"), F.lit("p").alias("project_slug"), F.col("conv_id").alias("session_id"), F.col("turn").cast("int").alias("sequence"), "role", F.col("text").alias("content"), F.lit(None).cast("timestamp").alias("ts"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("sequence"), F.col("user_id").alias("session_id"), "user_id", F.col("event_type").alias("event"), "ts", "value", F.col("props").alias("data"))


def vectors(spark: SparkSession, sf_dir: str, parent: str = "label") -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("id"), F.col(parent).cast("long").alias("parent_id"), F.col("embedding").alias("vector"), F.lit("user_query").alias("content_type"))


def message_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th vector as that of the n-th message, for as many as there are of both."""
    n = F.row_number().over(Window.orderBy("session_id", "sequence")) - 1
    kind = F.when(F.col("role") == "user", "user_query").when(F.col("role") == "assistant", "assistant_response").otherwise("tool_output")
    m = messages(spark, sf_dir).select("id", "user_id", "session_id", "project_slug", "content", kind.alias("content_type"), n.alias("n"))
    rows = m.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("n"), F.col("embedding").alias("vector")), "n")
    spans = [F.lit(0).alias("chunk_index"), F.lit(0).alias("span_start"), F.length("content").alias("span_end")]
    return rows.select(
        F.concat_ws("_", "id", "content_type", F.lit("0")).alias("id"), F.col("id").alias("parent_id"), "user_id", "session_id", "project_slug",
        "content_type", *spans, F.col("content").alias("source_text"), "vector",
    )


def block_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of which every fifth is a tool's, and those of assistants in turns 1, 4, 7... hold lists of blocks."""
    m = messages(spark, sf_dir).withColumn("role", F.when(F.col("sequence") % 5 == 4, "tool").otherwise(F.col("role")))
    thought = F.concat(F.lit("thought "), F.col("sequence").cast("string"))
    blocks = [
        {"type": F.lit("text"), "text": F.col("content")}, {"type": F.lit("thinking"), "thinking": thought},
        {"type": F.lit("tool_use"), "name": F.lit("ls")}, {"type": F.lit("text"), "text": F.lit("more")},
    ]
    none = F.lit(None).cast("string")
    listed = F.to_json(F.array(*(F.struct(*(b.get(k, none).alias(k) for k in ("type", "text", "thinking", "name"))) for b in blocks)))
    return m.withColumn("content", F.when((F.col("role") == "assistant") & (F.col("sequence") % 3 == 1), listed).otherwise(F.col("content")))


def tool_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a payload of tool, model, provider and agent."""
    k = F.col("sequence")
    name = lambda mark, m: F.concat(F.lit(mark), (k % m).cast("string"))
    inside = F.struct(name("t", 3).alias("tool_name"), name("m", 2).alias("model"), F.lit("p").alias("provider"), F.lit("a").alias("agent_name"))
    e = events(spark, sf_dir).withColumn("data", F.to_json(F.struct(inside.alias("data"))))
    return e.withColumns({"lvl": F.when(k % 5 == 0, "info").otherwise("debug"), "project_slug": F.when(F.col("user_id") < 500, "few").otherwise("many")})
