"""Registered queries: metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from vectide.functions.numbers import timestamp
from vectide.functions.vectors import vector_bytes
from vectide.operators import metrics
from vectide.plans import views
from vectide.plans.predict_queries import needs
from vectide.plans.registry import query
from vectide.plans.rounding import nudged, rounded
from vectide.session import cut_lineage, new_folder


@query("cache_stats", """
SELECT count(*) AS total_requests, count(*) FILTER (cache_hit) AS cache_hits, count(*) FILTER (NOT cache_hit) AS cache_misses,
       round(avg(latency_ms) + 1e-9, 6) AS avg_response_ms, round(count(*) FILTER (cache_hit) / count(*) + 1e-9, 6) AS hit_rate
FROM request_log""")
def cache_stats(spark, folder):
    return rounded(metrics.cache_stats(views.request_log(spark, folder)), 6, "avg_response_ms", "hit_rate")


@query("load_metrics", """
SELECT count(*) AS total_requests, count(*) FILTER (success) AS successful_requests,
       count(*) FILTER (NOT success) AS failed_requests, round(avg(latency_ms) + 1e-9, 6) AS avg_latency_ms,
       list_sort(list(latency_ms))[1 + floor(0.95 * count(*))::BIGINT] AS p95_latency_ms,
       list_sort(list(latency_ms))[1 + floor(0.99 * count(*))::BIGINT] AS p99_latency_ms, max(latency_ms) AS max_latency_ms,
       round(count(*) / 2592000.0 + 1e-12, 9) AS requests_per_second, round(count(*) FILTER (cache_hit) / count(*) + 1e-9, 6) AS cache_hit_rate,
       round(count(*) FILTER (NOT success) / count(*) + 1e-9, 6) AS error_rate, 2592000.0::DOUBLE AS duration_seconds
FROM request_log""")
def load_metrics(spark, folder):
    found = metrics.load_metrics(
        views.request_log(spark, folder), 30 * 86400.0, latencies=views.access_log(spark, folder))
    return rounded(rounded(found, 6, "avg_latency_ms", "cache_hit_rate", "error_rate"), 9, "requests_per_second")


@query("hit_miss_speedup", """
SELECT round(avg(latency_ms) FILTER (cache_hit) + 1e-9, 6) AS avg_hit_ms,
       (list_sort(list(latency_ms) FILTER (cache_hit)))[1 + floor(0.95 * count(*) FILTER (cache_hit))::BIGINT] AS p95_hit_ms,
       round(avg(latency_ms) FILTER (NOT cache_hit) + 1e-9, 6) AS avg_miss_ms,
       (list_sort(list(latency_ms) FILTER (NOT cache_hit)))[1 + floor(0.95 * count(*) FILTER (NOT cache_hit))::BIGINT] AS p95_miss_ms,
       round(avg(latency_ms) FILTER (NOT cache_hit) / avg(latency_ms) FILTER (cache_hit) + 1e-9, 6) AS speedup
FROM request_log""")
def hit_miss_speedup(spark, folder):
    labelled = cut_lineage(views.request_log(spark, folder).select("cache_hit", "latency_ms"))  # read twice
    return rounded(metrics.hit_miss_speedup(labelled), 6, "avg_hit_ms", "avg_miss_ms", "speedup")


def histogram_sql(source: str, value: str, bounds: list[float], by: dict[str, str]) -> str:
    """Bucket counts as one UNION ALL branch per bound."""
    labels = ", ".join(f"{expr} AS {name}" for name, expr in by.items())
    labels = labels + ", " if labels else ""
    group = "GROUP BY " + ", ".join(by.values()) if by else ""
    tail = f"round(sum({value}) + 1e-7, 4) AS total_sum, count({value}) AS total_count FROM {source} WHERE {value} IS NOT NULL {group}"
    parts = [f"SELECT {labels}'{b}' AS le, count(*) FILTER ({value} <= {b}) AS bucket_count, {tail}" for b in bounds]
    parts.append(f"SELECT {labels}'+Inf' AS le, count(*) AS bucket_count, {tail}")
    return "\nUNION ALL\n".join(parts)


@query("latency_histogram", histogram_sql(
    "access_log", "(latency_ms / 1000.0::DOUBLE)", metrics.LATENCY_BOUNDS, {"operation": "op"}))
def latency_histogram(spark, folder):
    rows = views.access_log(spark, folder).select(F.col("op").alias("operation"), (F.col("latency_ms") / 1000.0).alias("seconds"))
    return rounded(metrics.histogram(rows, "seconds", metrics.LATENCY_BOUNDS, ["operation"]), 4, "total_sum")


@query("similarity_histogram", histogram_sql("access_log", "similarity_score", metrics.SCORE_BOUNDS, {}))
def similarity_histogram(spark, folder):
    rows = views.access_log(spark, folder).select("similarity_score")
    return rounded(metrics.histogram(rows, "similarity_score", metrics.SCORE_BOUNDS, []), 4, "total_sum")


# the operation of an event stands for the method; writes and reads go to an endpoint and a service each
STATUS = "CASE WHEN success THEN 'success' ELSE 'error' END"
WRITES = "op IN ('purchase', 'signup')"
HTTP_LABELS = {"method": "op", "endpoint": f"CASE WHEN {WRITES} THEN '/embeddings' ELSE '/similar' END", "status": STATUS}
GRPC_LABELS = {"service": f"CASE WHEN {WRITES} THEN 'store' ELSE 'search' END", "method": "op", "status": STATUS}
SECONDS = "(latency_ms / 1000.0::DOUBLE)"
HTTP_SQL = histogram_sql("access_log", SECONDS, metrics.DEFAULT_BOUNDS, HTTP_LABELS)
GRPC_SQL = histogram_sql("access_log", SECONDS, metrics.DEFAULT_BOUNDS, GRPC_LABELS)


def _durations(spark, folder, labels: dict[str, str]) -> DataFrame:
    rows = views.access_log(spark, folder).select(
        *[F.expr(sql).alias(name) for name, sql in labels.items()], (F.col("latency_ms") / 1000.0).alias("seconds"))
    return rounded(metrics.histogram(rows, "seconds", metrics.DEFAULT_BOUNDS, list(labels)), 4, "total_sum")


@query("request_duration_histogram", HTTP_SQL)
def request_duration_histogram(spark, folder):
    return _durations(spark, folder, HTTP_LABELS)


@query("call_duration_histogram", GRPC_SQL)
def call_duration_histogram(spark, folder):
    return _durations(spark, folder, GRPC_LABELS)


def _labels_sql(**labels: str) -> str:
    return " || ',' || ".join(f"'{name}=\"' || {column} || '\"'" for name, column in labels.items()) or "''"


def _counter_sql(name: str, where: str = "true", **labels: str) -> str:
    return (f"SELECT '{name}' AS counter, {_labels_sql(**labels)} AS labels, count(*) AS count FROM labelled_log "
            f"WHERE {where} GROUP BY ALL HAVING count(*) > 0")


COUNTERS_SQL = " UNION ALL ".join([
    _counter_sql(metrics.CACHE_OPERATIONS, operation="op", status="status"),
    _counter_sql(metrics.EMBEDDING_OPERATIONS, operation="op", model="model"),
    _counter_sql(metrics.ERRORS, "status = 'error'", component="component", error_type="op"),
    _counter_sql(metrics.REQUESTS, method="method", status="status"),
    _counter_sql(metrics.SIMILARITY_REQUESTS, cache_status="cache_status", similarity_method="similarity_method"),
    _counter_sql(metrics.HITS, "cache_status = 'hit'"),
    _counter_sql(metrics.MISSES, "cache_status = 'miss'"),
    _counter_sql(metrics.SEARCHES, "similarity_method = 'exact'"),
])
LABELLED = """
WITH labelled_log AS (
  SELECT op, CASE WHEN success THEN 'success' ELSE 'error' END AS status, model_name AS model,
         'shard_' || (embedding_id % 6) AS component,
         CASE WHEN op IN ('purchase', 'signup') THEN 'StoreEmbedding' ELSE 'RetrieveEmbedding' END AS method,
         CASE WHEN event_id IN (SELECT event_id FROM miss_events) THEN 'miss' ELSE 'hit' END AS cache_status,
         CASE WHEN similarity_score IS NULL THEN 'unknown' ELSE 'exact' END AS similarity_method FROM keyed_log)"""


def labelled_log(spark, folder) -> DataFrame:
    models = views.key_columns(spark, folder).select("embedding_id", F.col("model_name").alias("model"))
    return views.request_log(spark, folder).join(models, "embedding_id").select(
        F.col("op").alias("operation"), F.when(F.col("success"), "success").otherwise("error").alias("status"), "model",
        F.concat(F.lit("shard_"), (F.col("embedding_id") % views.SHARDS).cast("string")).alias("component"),
        F.col("op").alias("error_type"),
        F.when(F.col("op").isin("purchase", "signup"), "StoreEmbedding").otherwise("RetrieveEmbedding").alias("method"),
        F.when(F.col("cache_hit"), "hit").otherwise("miss").alias("cache_status"),
        F.when(F.col("similarity_score").isNull(), "unknown").otherwise("exact").alias("similarity_method"))


def counters(spark, folder) -> DataFrame:
    return metrics.label_counters(labelled_log(spark, folder), {
        metrics.CACHE_OPERATIONS: (["operation", "status"], None),
        metrics.EMBEDDING_OPERATIONS: (["operation", "model"], None),
        metrics.ERRORS: (["component", "error_type"], F.col("status") == "error"),
        metrics.REQUESTS: (["method", "status"], None),
        metrics.SIMILARITY_REQUESTS: (["cache_status", "similarity_method"], None),
        metrics.HITS: ([], F.col("cache_status") == "hit"),
        metrics.MISSES: ([], F.col("cache_status") == "miss"),
        metrics.SEARCHES: ([], F.col("similarity_method") == "exact")})


@query("label_counters", f"{LABELLED} {COUNTERS_SQL}")
def label_counters(spark, folder):
    return counters(spark, folder)


def _histogram_samples(name: str, body: str, **labels: str) -> str:
    """The samples of a histogram as (name, labels, value)."""
    own, with_bound = _labels_sql(**labels), _labels_sql(**labels, le="le")
    return f"""SELECT '{name}_bucket' AS name, {with_bound} AS labels, bucket_count::VARCHAR AS value FROM ({body})
UNION ALL SELECT '{name}_sum', {own}, total_sum::DECIMAL(38, 6)::VARCHAR FROM ({body}) WHERE le = '+Inf'
UNION ALL SELECT '{name}_count', {own}, total_count::VARCHAR FROM ({body}) WHERE le = '+Inf'"""


LATENCY_SQL = histogram_sql("access_log", SECONDS, metrics.LATENCY_BOUNDS, {"operation": "op"})
SCORES_SQL = histogram_sql("access_log", "similarity_score", metrics.SCORE_BOUNDS, {})
FAMILIES_SQL = ", ".join(f"('{name}', '{kind}', '{text}')" for name, (kind, text) in metrics.FAMILIES.items())


@query("export_metrics_text", f"""{LABELLED}, counters AS ({COUNTERS_SQL}),
samples AS (
  SELECT counter AS name, labels, count::VARCHAR AS value FROM counters
  UNION ALL {_histogram_samples(metrics.LATENCY, LATENCY_SQL, operation="operation")}
  UNION ALL {_histogram_samples(metrics.SCORES, SCORES_SQL)}
  UNION ALL {_histogram_samples(metrics.HTTP_DURATION, HTTP_SQL, method="method", endpoint="endpoint", status="status")}
  UNION ALL {_histogram_samples(metrics.GRPC_DURATION, GRPC_SQL, service="service", method="method", status="status")}
  UNION ALL SELECT '{metrics.HIT_RATE}', '', (count(*) FILTER (cache_status = 'hit') / count(*))::DECIMAL(38, 6)::VARCHAR FROM labelled_log
  UNION ALL SELECT '{metrics.MEMORY}', 'node="shard_' || (similarity_cluster % 6) || '"', sum(4 * len(v))::DECIMAL(38, 6)::VARCHAR FROM store GROUP BY 2
  UNION ALL SELECT '{metrics.QUEUE}', '', count(*)::DECIMAL(38, 6)::VARCHAR FROM needs WHERE should_precompute),
families AS (SELECT * FROM (VALUES {FAMILIES_SQL}) AS t(family, kind, description)),
there AS (SELECT DISTINCT family, kind, description FROM families JOIN samples
  ON CASE WHEN kind = 'histogram' THEN regexp_replace(name, '_(bucket|sum|count)$', '') ELSE name END = family)
SELECT name || CASE WHEN labels = '' THEN '' ELSE '{{' || labels || '}}' END || ' ' || value AS line FROM samples
UNION ALL SELECT '# HELP ' || family || ' ' || description FROM there
UNION ALL SELECT '# TYPE ' || family || ' ' || kind FROM there""")
def export_metrics_text(spark, folder):
    """All families, written as text with their HELP and TYPE lines and read back."""
    stats = metrics.cache_stats(views.request_log(spark, folder))
    memory = views.store(spark, folder).groupBy(F.concat(
        F.lit("shard_"), (F.col("similarity_cluster") % views.SHARDS).cast("string")).alias("node")).agg(
            F.sum(vector_bytes("embedding")).alias("bytes"))
    queue = needs(spark, folder).agg(F.count_if("should_precompute").alias("queue"))
    parts = [
        metrics.counter_samples(counters(spark, folder)),
        metrics.histogram_samples(latency_histogram(spark, folder), metrics.LATENCY, ["operation"]),
        metrics.histogram_samples(similarity_histogram(spark, folder), metrics.SCORES, []),
        metrics.histogram_samples(_durations(spark, folder, HTTP_LABELS), metrics.HTTP_DURATION, list(HTTP_LABELS)),
        metrics.histogram_samples(_durations(spark, folder, GRPC_LABELS), metrics.GRPC_DURATION, list(GRPC_LABELS)),
        metrics.gauge_samples(stats, {metrics.HIT_RATE: "hit_rate"}), metrics.labelled_gauges(memory, metrics.MEMORY, ["node"], "bytes"),
        metrics.gauge_samples(queue, {metrics.QUEUE: "queue"})]
    samples = cut_lineage(reduce(DataFrame.unionByName, parts))  # read for the lines and for their families
    path = new_folder(spark, "metrics-text")
    metrics.write_metrics_text(samples, path, metrics.FAMILIES)
    return spark.read.text(path).withColumnRenamed("value", "line")


SNAPSHOT = """
WITH waiting AS (
  SELECT unnest(generate_series(a, b)) AS w FROM (
    SELECT epoch_us(ts) // {us} AS a, (epoch_us(ts) + floor(latency_ms * 1000)::BIGINT - 1) // {us} - 1 AS b FROM request_log
    WHERE NOT cache_hit AND latency_ms IS NOT NULL) WHERE b >= a),
queued AS (SELECT w * {us} AS window_us, count(*) AS queue_size FROM waiting GROUP BY 1)
SELECT s.*, coalesce(queue_size, 0) AS queue_size FROM (
  SELECT epoch_us(ts) // {us} * {us} AS window_us,
         count(*) FILTER (cache_hit) AS cache_hits, count(*) FILTER (NOT cache_hit) AS cache_misses,
         count(DISTINCT r.embedding_id) AS total_embeddings, round(coalesce(avg(similarity_score), 0) + 1e-9, 6) AS avg_similarity_score,
         count(DISTINCT r.embedding_id) * 256 AS memory_bytes, count(*) FILTER (NOT success) AS error_count,
         round(count(*) FILTER (cache_hit) / count(*) + 1e-9, 6) AS hit_rate FROM request_log r {where} GROUP BY 1) s
LEFT JOIN queued USING (window_us)"""
HOUR, DAY = 3_600_000_000, 86_400_000_000


def _sized_requests(spark, folder):
    sizes = views.key_columns(spark, folder).select("embedding_id", "vector_size")
    return views.request_log(spark, folder).join(sizes, "embedding_id")


def _snapshot_rows(snapshots: DataFrame) -> DataFrame:
    rows = snapshots.withColumn("window_us", F.unix_micros("window_start")).drop("window_start")
    return rounded(rows, 6, "avg_similarity_score", "hit_rate")


@query("metric_snapshot", SNAPSHOT.format(us=30_000_000, where=""))
def metric_snapshot(spark, folder):
    return _snapshot_rows(metrics.metric_snapshot(_sized_requests(spark, folder)))


def _stored_history(spark, folder):
    """Hourly snapshots on disk: those up to noon of the 30th first, then the rest, and once more a day that is there."""
    snapshots = cut_lineage(metrics.mergeable_snapshot(_sized_requests(spark, folder), 3600))
    path, cut = new_folder(spark, "history"), timestamp("2024-01-30 12:00:00")
    metrics.append_history(snapshots.filter(F.col("window_start") <= cut), path)
    metrics.append_history(snapshots.filter(F.col("window_start") > cut), path)
    metrics.append_history(snapshots.filter(F.to_date("window_start") == F.to_date(cut)), path)
    return path


@query("metrics_history", SNAPSHOT.format(us=HOUR, where="""
WHERE epoch_us(ts) // 3600000000 * 3600000000 > epoch_us(TIMESTAMP '2024-01-24')"""))
def metrics_history(spark, folder):
    """The stored history within its retention."""
    path = _stored_history(spark, folder)
    return _snapshot_rows(metrics.read_snapshot(metrics.read_history(spark, path, views.as_of())))


@query("metrics_rollup", f"""
WITH hours AS ({SNAPSHOT.format(us=HOUR, where="")}),
days AS (SELECT epoch_us(ts) // {DAY} * {DAY} AS window_us, count(DISTINCT embedding_id) AS keys FROM request_log GROUP BY 1)
SELECT days.window_us, sum(cache_hits)::BIGINT AS cache_hits, sum(cache_misses)::BIGINT AS cache_misses, sum(error_count)::BIGINT AS error_count,
       max(queue_size) AS queue_size, count(*) AS windows, max(keys) AS exact_keys, true AS estimate_close
FROM hours JOIN days ON hours.window_us // {DAY} * {DAY} = days.window_us GROUP BY 1""")
def metrics_rollup(spark, folder):
    """Days rolled up from the stored hours, beside the distinct keys of the log and whether the estimate is within 2 %."""
    days = metrics.roll_up(spark.read.parquet(_stored_history(spark, folder)), 86400)
    exact = views.access_log(spark, folder).groupBy(F.window("ts", "1 day")["start"].alias("window_start")).agg(
        F.countDistinct("embedding_id").alias("exact_keys"))
    close = F.abs(F.hll_sketch_estimate("keys") - F.col("exact_keys")) <= 0.02 * F.col("exact_keys")
    return days.join(exact, "window_start").select(
        F.unix_micros("window_start").alias("window_us"), "cache_hits", "cache_misses", "error_count", "queue_size", "windows",
        "exact_keys", close.alias("estimate_close"))


@query("batch_summary", """
SELECT event_id // 250 AS batch_id, count(*) AS total, count(*) FILTER (cache_hit) AS hits, count(*) FILTER (NOT cache_hit) AS misses,
       count(*) FILTER (success) AS successes, count(*) FILTER (NOT success) AS failures,
       round(count(*) FILTER (cache_hit) / count(*) + 1e-9, 6) AS hit_rate FROM request_log GROUP BY 1""")
def batch_summary(spark, folder):
    requests = views.request_log(spark, folder).withColumn("batch_id", F.floor(F.col("event_id") / 250))
    return rounded(metrics.batch_summary(requests), 6, "hit_rate")


WINDOW_RATE = """
SELECT epoch_us(time_bucket(INTERVAL {width}, ts, TIMESTAMP '2024-01-01')) AS window_us, count(*) FILTER (cache_hit) AS hits,
       count(*) AS requests, round(count(*) FILTER (cache_hit) / count(*) + 1e-9, 6) AS hit_rate FROM request_log GROUP BY 1 {having}"""


@query("hit_rate_window", WINDOW_RATE.format(width="30 SECOND", having=""))
def hit_rate_window(spark, folder):
    rates = metrics.hit_rate_window(views.request_log(spark, folder), 30)
    return rounded(rates.withColumn("window_us", F.unix_micros("window_start")).drop("window_start"), 6, "hit_rate")


@query("alert_breaches", """
WITH means AS (
  SELECT embedding_id % 6 AS shard, epoch_us(ts) // 3600000000 AS slot, avg(latency_ms) AS mean FROM access_log GROUP BY 1, 2),
islands AS (
  SELECT *, slot - row_number() OVER (PARTITION BY shard ORDER BY slot) AS island FROM means WHERE mean > 40)
SELECT shard, min(slot) * 3600000000 AS start_us, (max(slot) + 1) * 3600000000 AS end_us, count(*) AS windows,
       round(max(mean) + 1e-9, 6) AS peak FROM islands GROUP BY shard, island HAVING count(*) >= 3""")
def alert_breaches(spark, folder):
    samples = views.access_log(spark, folder).withColumn("shard", F.col("embedding_id") % views.SHARDS)
    found = metrics.alert_breaches(samples, "shard", "latency_ms", 40.0, 3600, 3)
    return found.select("shard", F.unix_micros("breach_start").alias("start_us"),
                        F.unix_micros("breach_end").alias("end_us"), "windows", nudged("peak", 6).alias("peak"))
