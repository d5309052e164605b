"""Registered queries: streaming jobs, run over what is there and read back."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, functions as F

from vectide.functions.vectors import dot
from vectide.operators import clusters
from vectide.plans import views
from vectide.plans.metrics_queries import WINDOW_RATE
from vectide.plans.registry import query
from vectide.plans.rounding import nudged
from vectide.plans.search_queries import FALLBACK_SQL
from vectide.plans.store_queries import UPSERTED, _entry, _logged_store, sharded
from vectide.session import new_folder
from vectide.sources.tables import stream_table
from vectide.streaming import jobs


def _folders(spark, name: str) -> tuple[str, str]:
    base = new_folder(spark, name)
    return f"{base}/out", f"{base}/checkpoint"


@contextlib.contextmanager
def _rocksdb(spark):
    """The state store that stateful processors need, for the streams started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, jobs.ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _log_stream(spark, folder) -> DataFrame:
    return views.log_of(views.event_stream(spark, folder))


@query("stream_hit_rate", WINDOW_RATE.format(width="1 DAY", having="""
HAVING epoch_us(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '2024-01-01')) + 86400000000
  <= (SELECT max(epoch_us(ts)) FROM access_log) - 3600000000"""))
def stream_hit_rate(spark, folder):
    """Closed days of the labelled log; the last, open day is not written."""
    labelled = f"{new_folder(spark, 'request-log')}/log"
    views.request_log(spark, folder).select("ts", "cache_hit").write.parquet(labelled)
    requests = spark.readStream.schema("ts timestamp, cache_hit boolean").parquet(labelled)
    out, checkpoint = _folders(spark, "hit-rate")
    jobs.stream_hit_rate(requests, out, checkpoint, seconds=86400).awaitTermination()
    return spark.read.parquet(out).select(
        F.unix_micros("window_start").alias("window_us"), "hits", "requests", nudged("hit_rate", 6).alias("hit_rate"))


@query("stream_lookup", """
SELECT event_id, l.embedding_id, s.embedding_id IS NOT NULL AS found, s.model_name
FROM access_log l LEFT JOIN live_store s USING (embedding_id)""")
def stream_lookup(spark, folder):
    out, checkpoint = _folders(spark, "lookup")
    requests = _log_stream(spark, folder).select("event_id", "embedding_id")
    jobs.stream_lookup(requests, lambda now: views.live_store(now, folder), out, checkpoint).awaitTermination()
    return jobs.read_batches(spark, out).select("event_id", "embedding_id", "found", "model_name")


@query("stream_lookup_fallback", FALLBACK_SQL.format(id="event_id"))
def stream_lookup_fallback(spark, folder):
    """The lookup of each micro-batch, with the similarity fallback."""
    out, checkpoint = _folders(spark, "lookup-fallback")
    requests = _log_stream(spark, folder).select("event_id", "embedding_id")
    vectors = views.embeddings(spark, folder).select(F.col("vec_id").alias("embedding_id"), "embedding")
    jobs.stream_lookup(requests, lambda now: views.live_store(now, folder), out, checkpoint, vectors, 0.28,
                       dim=views.DIM).awaitTermination()
    return jobs.read_batches(spark, out).drop("batch")


@query("stream_upsert", UPSERTED)
def stream_upsert(spark, folder):
    _, checkpoint = _folders(spark, "upsert")
    log = _logged_store(spark, folder, "store")
    writes = views.writes_of(_log_stream(spark, folder), views.embeddings(spark, folder))
    jobs.stream_upsert(writes, log, sharded, checkpoint, views.DIM).awaitTermination()
    return _entry(log.read())


@query("stream_route", "SELECT embedding_id, cluster FROM routed")
def stream_route(spark, folder):
    means = clusters.group_means(views.store(spark, folder), "similarity_cluster")
    labels, centres = clusters.centroid_matrix(means, "similarity_cluster")
    out, checkpoint = _folders(spark, "route")
    vectors = stream_table(spark, folder, "embeddings", "vec_id long, embedding array<float>").withColumnRenamed(
        "vec_id", "embedding_id")
    jobs.stream_route(vectors, labels, centres, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query("stream_access_stats", """
SELECT embedding_id, access_count, epoch_us(last_access) AS last_us, round(average_interval + 1e-7, 4) AS average_interval,
       round(avg_similarity + 1e-11, 8) AS avg_similarity FROM key_stats""")
def stream_access_stats(spark, folder):
    out, checkpoint = _folders(spark, "access-stats")
    with _rocksdb(spark):
        jobs.stream_access_stats(_log_stream(spark, folder), out, checkpoint).awaitTermination()
    return jobs.access_stats_after(spark, out).select(
        "embedding_id", "access_count", F.unix_micros("last_access").alias("last_us"),
        nudged("average_interval", 4).alias("average_interval"), nudged("avg_similarity", 8).alias("avg_similarity"))


@query("stream_access_patterns", """
SELECT event_id, embedding_id, row_number() OVER w AS access_frequency,
       round(coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 0) + 1e-9, 6) AS time_since_last_access
FROM access_log WHERE epoch_us(ts) <= (SELECT max(epoch_us(ts)) FROM access_log) // 1000 * 1000 - 3600000000
WINDOW w AS (PARTITION BY embedding_id ORDER BY ts, event_id)""")
def stream_access_patterns(spark, folder):
    """Accesses up to the watermark, an hour before the last."""
    out, checkpoint = _folders(spark, "access-patterns")
    with _rocksdb(spark):
        jobs.stream_access_patterns(_log_stream(spark, folder), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).select(
        "event_id", "embedding_id", "access_frequency", nudged("time_since_last_access", 6).alias("time_since_last_access"))


@query("stream_ttl_store", """
SELECT embedding_id, epoch_us(created_at) AS created_us FROM (
  SELECT *, max(created_at) OVER () AS final FROM (
    SELECT CASE WHEN op = 'signup' THEN 1000000 + user_id ELSE embedding_id END AS embedding_id, max(ts) AS created_at
    FROM access_log WHERE op IN ('signup', 'purchase') GROUP BY 1))
WHERE epoch_us(created_at) // 1000 + 86400000 + 1 <= epoch_us(final) // 1000""")
def stream_ttl_store(spark, folder):
    """Writes of the log with a day to live, as they expire up to the last write."""
    log = _log_stream(spark, folder).filter(F.col("op").isin("signup", "purchase"))
    writes = log.select(
        F.when(F.col("op") == "signup", F.col("user_id") + views.NEW_IDS).otherwise(F.col("embedding_id")).alias("embedding_id"),
        F.col("ts").alias("created_at"), F.lit(86400).alias("ttl_seconds"))
    out, checkpoint = _folders(spark, "ttl-store")
    with _rocksdb(spark):
        # as they expire up to the last write: nothing may come after it
        jobs.stream_ttl_store(writes, out, checkpoint, late_seconds=0).awaitTermination()
    return spark.read.schema("embedding_id long, created_us long, expired_ms long").parquet(out).select(
        "embedding_id", "created_us")


@query("periodic_refresh", """
WITH ends AS (SELECT DISTINCT (epoch_us(created_at) // 86400000000 + 1) * 86400000000 AS refreshed_us FROM store)
SELECT refreshed_us, similarity_cluster AS label, count(*) AS entries,
       round(avg(list_dot_product(v, range(1, 65)::DOUBLE[])) + 1e-9, 6) AS weighted
FROM ends JOIN store ON epoch_us(created_at) < refreshed_us GROUP BY 1, 2""")
def periodic_refresh(spark, folder):
    """Centroids as they are at the end of each day on which entries were written."""
    daily = clusters.refreshed_means(views.store(spark, folder), "similarity_cluster", 86400)
    return daily.select(F.unix_micros("refreshed_at").alias("refreshed_us"), F.col("similarity_cluster").alias("label"), "entries",
                        nudged(dot("centroid", F.sequence(F.lit(1), F.lit(views.DIM))), 6).alias("weighted"))
