"""Registered queries: access statistics, TTL labels and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectide.operators import access, predict, sessions
from vectide.plans import views
from vectide.plans.registry import query
from vectide.plans.rounding import nudged
from vectide.session import cut_lineage, new_folder
from vectide.sources import models


@query("ttl_hit_label", "SELECT event_id, embedding_id, cache_hit FROM request_log")
def ttl_hit_label(spark, folder):
    return views.request_log(spark, folder).select("event_id", "embedding_id", "cache_hit")


@query("access_patterns", """
SELECT event_id, embedding_id, access_frequency, round(time_since_last_access + 1e-9, 6) AS time_since_last_access FROM patterns""")
def access_patterns(spark, folder):
    return access.access_patterns(views.access_log(spark, folder)).select(
        "event_id", "embedding_id", "access_frequency", nudged("time_since_last_access", 6).alias("time_since_last_access"))


@query("running_avg_interval", """
SELECT event_id, embedding_id, round(avg(CASE WHEN access_frequency > 1 THEN time_since_last_access END) OVER (
  PARTITION BY embedding_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + 1e-5, 2) AS average_interval FROM patterns""")
def running_avg_interval(spark, folder):
    return access.running_avg_interval(views.access_log(spark, folder)).select(
        "event_id", "embedding_id", nudged("average_interval", 2).alias("average_interval"))


@query("rolling_score_100", """
SELECT event_id, embedding_id, round(avg(similarity_score) OVER (
  PARTITION BY embedding_id ORDER BY ts, event_id ROWS 99 PRECEDING) + 1e-11, 8) AS rolling_score
FROM access_log WHERE similarity_score IS NOT NULL""")
def rolling_score_100(spark, folder):
    return access.rolling_score(views.access_log(spark, folder)).select(
        "event_id", "embedding_id", nudged("rolling_score", 8).alias("rolling_score"))


@query("rolling_latency_1000", """
SELECT event_id, op, round(avg(latency_ms) OVER (
  PARTITION BY op ORDER BY ts, event_id ROWS 999 PRECEDING) + 1e-9, 6) AS rolling_latency_ms FROM access_log""")
def rolling_latency_1000(spark, folder):
    return access.rolling_latency(views.access_log(spark, folder), "op").select(
        "event_id", "op", nudged("rolling_latency_ms", 6).alias("rolling_latency_ms"))


@query("key_access_stats", """
SELECT embedding_id, access_count, epoch_us(last_access) AS last_us, round(average_interval + 1e-7, 4) AS average_interval,
       round(avg_similarity + 1e-11, 8) AS avg_similarity FROM key_stats""")
def key_access_stats(spark, folder):
    return access.key_access_stats(views.access_log(spark, folder)).select(
        "embedding_id", "access_count", F.unix_micros("last_access").alias("last_us"),
        nudged("average_interval", 4).alias("average_interval"), nudged("avg_similarity", 8).alias("avg_similarity"))


@query("latest_pattern", """
SELECT embedding_id, event_id, access_frequency, round(time_since_last_access + 1e-9, 6) AS time_since_last_access FROM (
  SELECT *, row_number() OVER (PARTITION BY embedding_id ORDER BY ts DESC, event_id DESC) AS rn FROM patterns) WHERE rn = 1""")
def latest_pattern(spark, folder):
    patterns = access.access_patterns(views.access_log(spark, folder).select("event_id", "embedding_id", "ts"))
    return access.latest_pattern(patterns).select(
        "embedding_id", "event_id", "access_frequency",
        nudged("time_since_last_access", 6).alias("time_since_last_access"))


@query("sample_per_shard", """
SELECT shard, embedding_id, rank::INTEGER AS rank FROM (
  SELECT CAST(similarity_cluster % 6 AS INTEGER) AS shard, embedding_id,
         row_number() OVER (PARTITION BY similarity_cluster % 6 ORDER BY embedding_id) AS rank FROM store) WHERE rank <= 100""")
def sample_per_shard(spark, folder):
    from vectide.operators.clusters import assign_shard

    sharded = views.store(spark, folder).withColumn("shard", assign_shard("similarity_cluster", views.SHARDS))
    return access.sample_per_shard(sharded, 100).select("shard", "embedding_id", "rank")


@query("bounded_history", "SELECT event_id, embedding_id FROM access_log ORDER BY ts DESC, event_id DESC LIMIT 10000")
def bounded_history(spark, folder):
    return access.bounded_history(views.access_log(spark, folder)).select("event_id", "embedding_id")


@query("training_window", """
SELECT event_id, embedding_id FROM access_log WHERE ts > TIMESTAMP '2024-01-30'
  AND (SELECT count(*) FROM access_log WHERE ts > TIMESTAMP '2024-01-30') >= 50""")
def training_window(spark, folder):
    return access.training_window(views.access_log(spark, folder), views.as_of()).select("event_id", "embedding_id")


@query("usage_patterns", """
SELECT embedding_id, access_count, round(hours_since_access + 1e-9, 6) AS hours_since_access,
       round(access_frequency + 1e-11, 8) AS access_frequency, round(vector_norm + 1e-9, 6) AS vector_norm, dimension::INTEGER AS dimension, similarity_group,
       round(label + 1e-11, 8) AS label FROM usage""")
def usage_patterns(spark, folder):
    rows = access.usage_patterns(views.access_log(spark, folder), views.store(spark, folder), views.as_of(), views.WINDOW_HOURS)
    return rows.select(
        "embedding_id", "access_count", nudged("hours_since_access", 6).alias("hours_since_access"),
        nudged("access_frequency", 8).alias("access_frequency"), nudged("vector_norm", 6).alias("vector_norm"),
        "dimension", "similarity_group", nudged("label", 8).alias("label"))


@query("top_accessed", """
SELECT embedding_id, count(*) AS access_count FROM access_log GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_accessed(spark, folder):
    return access.top_accessed(views.access_log(spark, folder))


@query("predictor_summary", """
SELECT count(*) AS total_patterns, count(DISTINCT embedding_id) AS tracked_embeddings, true AS model_trained,
       epoch_us(TIMESTAMP '2024-01-31') AS last_training_us FROM access_log""")
def predictor_summary(spark, folder):
    """Patterns and keys of the log, with the state and the time that the stored model gives."""
    log, base = views.access_log(spark, folder), new_folder(spark, "model")
    rows = access.usage_patterns(log, views.store(spark, folder), views.as_of(), views.WINDOW_HOURS)
    net, _ = predict.fit_precompute_classifier(rows, epochs=1)
    models.save_model(net, spark.range(1).select(views.as_of().alias("trained_at")), base)
    status, info = models.model_info(spark, base)
    summary = access.predictor_summary(log, status == "ready", F.lit(info.first()["trained_at"]))
    return summary.withColumn("last_training_us", F.unix_micros("last_training_time")).drop("last_training_time")


@query("pattern_similarity", """
WITH latest AS (
  SELECT embedding_id, max(access_frequency) AS f, max(vector_size) AS size, max(cluster_id) AS c FROM patterns GROUP BY 1),
refs AS (SELECT * FROM latest ORDER BY f DESC, embedding_id LIMIT 10)
SELECT reference_key, embedding_id, round(similarity + 1e-9, 6) AS similarity, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY reference_key ORDER BY similarity DESC, embedding_id) AS rank FROM (
    SELECT r.embedding_id AS reference_key, l.embedding_id,
           round(((1 - abs(l.size - r.size) / greatest(l.size, r.size)) + (1 - abs(l.f - r.f) / greatest(l.f, r.f))
             + CASE WHEN l.c = r.c THEN 2.0 ELSE 0.0 END) / 3 + 1e-12, 9) AS similarity
    FROM refs r JOIN latest l ON r.embedding_id <> l.embedding_id) WHERE similarity > 0.3) WHERE rank <= 10""")
def pattern_similarity(spark, folder):
    """Keys like the ten most used ones."""
    log = views.keyed_log(spark, folder)
    top = [r["embedding_id"] for r in access.top_accessed(views.access_log(spark, folder)).collect()]
    found = access.pattern_similarity(access.latest_access(log), top)
    return found.withColumn("similarity", nudged("similarity", 6))


@query("next_key_ngram", """
WITH pairs AS (
  SELECT before_key AS embedding_id, embedding_id AS next_key, count(*) AS follows FROM user_steps
  WHERE gap_us <= 21600000000 GROUP BY 1, 2)
SELECT embedding_id, next_key, follows, rank::INTEGER AS rank, round(follows / total + 1e-9, 6) AS share FROM (
  SELECT *, row_number() OVER (PARTITION BY embedding_id ORDER BY follows DESC, next_key) AS rank,
         sum(follows) OVER (PARTITION BY embedding_id) AS total FROM pairs) WHERE rank <= 3""")
def next_key_ngram(spark, folder):
    found = sessions.next_key_ngram(views.access_log(spark, folder), views.SESSION_GAP)
    return found.withColumn("share", nudged("share", 6))


@query("next_key_backoff", """
WITH one AS (
  SELECT user_id, ts, event_id, embedding_id, CASE WHEN gap_us <= 21600000000 THEN before_key END AS p1 FROM user_steps),
two AS (SELECT *, CASE WHEN p1 IS NOT NULL THEN lag(p1) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS p2 FROM one),
three AS (SELECT *, CASE WHEN p1 IS NOT NULL THEN lag(p2) OVER (PARTITION BY user_id ORDER BY ts, event_id) END AS p3 FROM two),
counts AS (
  SELECT context, embedding_id AS next_key, count(*) AS follows FROM (
    SELECT [p1] AS context, embedding_id FROM three WHERE p1 IS NOT NULL UNION ALL
    SELECT [p1, p2], embedding_id FROM three WHERE p2 IS NOT NULL UNION ALL
    SELECT [p1, p2, p3], embedding_id FROM three WHERE p3 IS NOT NULL) GROUP BY 1, 2),
model AS (
  SELECT * FROM (
    SELECT *, sum(follows) OVER (PARTITION BY context) AS total,
           row_number() OVER (PARTITION BY context ORDER BY follows DESC, next_key) AS rank FROM counts)
  WHERE rank <= 3 AND (total >= 2 OR len(context) = 1)),
last AS (SELECT user_id, list_filter([embedding_id, p1, p2], lambda x: x IS NOT NULL) AS history FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM three) WHERE rn = 1),
asked AS (SELECT user_id, history[1:k] AS context, k FROM last, (SELECT unnest([1, 2, 3]) AS k) WHERE k <= len(history)),
longest AS (SELECT user_id, max(k) AS k FROM asked WHERE context IN (SELECT context FROM model) GROUP BY 1)
SELECT user_id, k AS context_length, next_key, rank::INTEGER AS rank, round((follows - 0.5) / total + 1e-9, 6) AS share
FROM longest JOIN asked USING (user_id, k) JOIN model USING (context)""")
def next_key_backoff(spark, folder):
    """For each user the likely next keys after the last access of the log, from contexts of up to three keys."""
    steps = cut_lineage(sessions.context_steps(views.access_log(spark, folder), views.SESSION_GAP, 3))
    last = steps.groupBy("user_id").agg(F.max_by(
        F.slice(F.concat(F.array("embedding_id"), "context"), 1, 3), F.struct("ts", "event_id")).alias("context"))
    found = sessions.predict_next(last, sessions.backoff_model(steps, 3), 3, ["user_id"])
    return found.withColumn("share", nudged("share", 6))


@query("session_drift", """
SELECT user_id, epoch_us(session_start) AS session_us, count(*) AS accesses,
       round(avg(list_cosine_similarity(a.v, b.v)) + 1e-9, 6) AS mean_similarity
FROM session_rows r LEFT JOIN vectors a ON a.vec_id = r.embedding_id LEFT JOIN vectors b ON b.vec_id = r.previous_key
GROUP BY user_id, session_start""")
def session_drift(spark, folder):
    vectors = views.embeddings(spark, folder).select(F.col("vec_id").alias("embedding_id"), "embedding")
    drift = sessions.session_drift(views.access_log(spark, folder), vectors, views.SESSION_GAP)
    return drift.select("user_id", F.unix_micros("session_start").alias("session_us"), "accesses",
                        nudged("mean_similarity", 6).alias("mean_similarity"))


@query("compute_saved", """
SELECT op, count(*) AS lookups, count(*) FILTER (cache_hit) AS hits, round(0.02 * count(*) FILTER (cache_hit) + 1e-9, 6) AS seconds_saved,
       round(0.02 * count(*) FILTER (cache_hit) / count(*) + 1e-9, 6) AS seconds_saved_per_lookup FROM request_log GROUP BY op""")
def compute_saved(spark, folder):
    saved = sessions.compute_saved(views.request_log(spark, folder), 0.02, ["op"])
    return saved.withColumn("seconds_saved", nudged("seconds_saved", 6)).withColumn(
        "seconds_saved_per_lookup", nudged("seconds_saved_per_lookup", 6))
