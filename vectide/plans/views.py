"""Views derived from the input tables, the inputs of the registered queries.

Embeddings become a store, events its access log. Everything is over whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vectide.functions.keys import cache_key
from vectide.functions.numbers import timestamp
from vectide.operators.store import live_entries
from vectide.operators.ttl import ttl_hits
from vectide.sources.tables import EVENTS_SCHEMA, read_table, stream_table

# Fixed values of the test setting.
DIM = 64
AS_OF_EPOCH = 1706659200.0
TTL_SECONDS = 3600
WINDOW_HOURS = 720.0
SHARDS = 6
SESSION_GAP = 21600
STORE_START_US = 1705708800000000  # 2024-01-20 00:00 UTC
NEW_IDS = 1_000_000


def as_of() -> Column:
    return timestamp("2024-01-31 00:00:00")


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings")


def store(spark: SparkSession, folder: str) -> DataFrame:
    """One row per vector: three models, writes 30 minutes apart, a week to live or no TTL."""
    minutes = F.col("vec_id") % 500 * 30
    return embeddings(spark, folder).select(
        F.col("vec_id").alias("embedding_id"), "embedding",
        F.concat(F.lit("model_"), (F.col("vec_id") % 3).cast("string")).alias("model_name"),
        F.col("label").alias("similarity_cluster"),
        F.timestamp_micros(STORE_START_US + minutes * 60_000_000).alias("created_at"),
        F.when(F.col("vec_id") % 5 != 0, 604800).alias("ttl_seconds"),
        F.lit(1).alias("access_count"))


def live_store(spark: SparkSession, folder: str) -> DataFrame:
    return live_entries(store(spark, folder), as_of())


def log_of(events: DataFrame) -> DataFrame:
    """Events as accesses: the key is in `props`, the value is the latency."""
    ok = F.col("event_type") != "error"
    return events.select(
        "event_id", "ts", "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("embedding_id"),
        F.col("event_type").alias("op"), F.col("value").alias("latency_ms"), ok.alias("success"),
        F.when(ok, F.least(F.lit(1.0), F.col("value") / 500.0)).alias("similarity_score"))


def access_log(spark: SparkSession, folder: str) -> DataFrame:
    return log_of(read_table(spark, folder, "events"))


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    return stream_table(spark, folder, "events", EVENTS_SCHEMA)


def key_columns(spark: SparkSession, folder: str) -> DataFrame:
    return store(spark, folder).select(
        "embedding_id", F.col("similarity_cluster").alias("cluster_id"), F.size("embedding").alias("vector_size"),
        "model_name")


def keyed_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log with cluster, vector size and model of each key."""
    return access_log(spark, folder).join(key_columns(spark, folder), "embedding_id")


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log with `cache_hit`, under a TTL of an hour."""
    return ttl_hits(access_log(spark, folder), ttl_seconds=TTL_SECONDS)


def query_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The vector of each key that the log asks for."""
    asked = access_log(spark, folder).select(F.col("embedding_id").alias("vec_id")).distinct()
    return embeddings(spark, folder).join(asked, "vec_id", "left_semi").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"), "label")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as text requests; the language stands for the model version."""
    return read_table(spark, folder, "documents").select("doc_id", "text", F.col("lang").alias("model_version"))


def text_store(spark: SparkSession, folder: str) -> DataFrame:
    """Keys of the documents that have a label, the cached part of the texts."""
    labelled = read_table(spark, folder, "labels").select("doc_id")
    keys = documents(spark, folder).select("doc_id", cache_key("model_version", "text").alias("key"))
    return keys.join(labelled, "doc_id", "left_semi").groupBy("key").agg(F.min("doc_id").alias("stored_doc"))


def writes_of(log: DataFrame, vectors: DataFrame) -> DataFrame:
    """Store writes in the log: purchases rewrite their key, signups write a new id, errors carry a cut-off vector."""
    joined = log.filter(F.col("op").isin("purchase", "signup", "error")).join(
        vectors.select(F.col("vec_id").alias("embedding_id"), "embedding", "label"), "embedding_id")
    return joined.select(
        F.when(F.col("op") == "signup", F.col("user_id") + NEW_IDS).otherwise(F.col("embedding_id")).alias("embedding_id"),
        F.when(F.col("op") == "error", F.slice("embedding", F.lit(1), (F.col("user_id") % 4).cast("int")))
        .otherwise(F.col("embedding")).alias("embedding"),
        F.lit("model_new").alias("model_name"), F.col("label").alias("similarity_cluster"),
        F.col("ts").alias("created_at"), F.col("event_id").alias("write_id"))


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    return writes_of(access_log(spark, folder), embeddings(spark, folder))
