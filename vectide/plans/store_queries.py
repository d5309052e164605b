"""Registered queries: store upkeep, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectide.functions import keys, numbers
from vectide.functions.vectors import cosine, distance_to_similarity, dot, l2_norm, vector_bytes
from vectide.operators import clusters, store
from vectide.plans import views
from vectide.plans.registry import query
from vectide.plans.rounding import nudged
from vectide.session import new_folder
from vectide.sources import blobs, commitlog, storefiles
from vectide.sources.tables import load_store as only_dim

LOADED = """SELECT write_id, embedding_id, len(v)::INTEGER AS dims FROM incoming WHERE len(v) = 64"""


@query("load_store", LOADED)
def load_store(spark, folder):
    loaded = only_dim(views.incoming(spark, folder), views.DIM)
    return loaded.select("write_id", "embedding_id", F.size("embedding").alias("dims"))


def _weighted(vector: str):
    return dot(vector, F.sequence(F.lit(1), F.size(vector)))


@query("decode_vectors", """
SELECT vec_id, len(v)::INTEGER AS dims, round(sqrt(list_dot_product(v, v)) + 1e-9, 6) AS norm,
       round(list_dot_product(v, range(1, 65)::DOUBLE[]) + 1e-9, 6) AS weighted FROM vectors""")
def decode_vectors(spark, folder):
    encoded = blobs.encode_vectors(views.embeddings(spark, folder))
    decoded, _ = blobs.decode_vectors(encoded)
    return decoded.select("vec_id", F.size("embedding").alias("dims"), nudged(l2_norm("embedding"), 6).alias("norm"),
                          nudged(_weighted("embedding"), 6).alias("weighted"))


UPSERTED = """
SELECT embedding_id, model_name, similarity_cluster, epoch_us(created_at) AS created_us, ttl_seconds,
       1 AS access_count, round(list_dot_product(v, range(1, 65)::DOUBLE[]) + 1e-9, 6) AS weighted FROM upserted"""


def _entry(table):
    return table.select(
        "embedding_id", "model_name", "similarity_cluster", F.unix_micros("created_at").alias("created_us"),
        "ttl_seconds", "access_count", nudged(_weighted("embedding"), 6).alias("weighted"))


def _logged_store(spark, folder, name):
    """The store on disk, in shards by cluster, with its commit log."""
    log = commitlog.StoreLog(spark, new_folder(spark, name), tie="write_id")
    log.write(sharded(views.store(spark, folder)))
    return log


def sharded(rows):
    return rows.withColumn("shard", clusters.assign_shard("similarity_cluster", views.SHARDS))


@query("upsert_store", UPSERTED)
def upsert_store(spark, folder):
    log = _logged_store(spark, folder, "store")
    log.upsert(sharded(store.accepted_writes(views.incoming(spark, folder), views.DIM, views.store(spark, folder).columns)))
    return _entry(log.read())


@query("store_versions", """
SELECT 1 AS version, count(*) AS entries, count(DISTINCT label % 6) AS shards FROM vectors UNION ALL
SELECT 2, count(*), count(DISTINCT similarity_cluster % 6) FROM upserted""")
def store_versions(spark, folder):
    """Entries and shards of each version of the store; the writes come as two deltas, folded in at the end."""
    log = _logged_store(spark, folder, "versions")
    first = log.state().version
    writes = sharded(store.accepted_writes(views.incoming(spark, folder), views.DIM, views.store(spark, folder).columns))
    for batch, part in enumerate((F.col("write_id") % 2 == 0, F.col("write_id") % 2 == 1)):
        log.append(writes.filter(part), "log", batch)
    last = log.fold()
    kept = [log.read(v).select(F.lit(n).alias("version"), "shard") for n, v in ((1, first), (2, last))]
    return kept[0].union(kept[1]).groupBy("version").agg(
        F.count(F.lit(1)).alias("entries"), F.countDistinct("shard").alias("shards"))


@query("bulk_store", """
SELECT doc_id, key, len(text) > 0 AS success, 0.85::DOUBLE AS similarity_threshold, 7200 AS ttl_seconds, 0 AS access_count
FROM text_keys""")
def bulk_store(spark, folder):
    entries = views.documents(spark, folder).withColumn("embedding", text_embedding("text"))
    stored = store.bulk_store(entries, 8, views.as_of(), 7200)
    return stored.select("doc_id", "key", "success", "similarity_threshold", "ttl_seconds", "access_count")


@query("bulk_store_stored", """
SELECT key, doc_id, access_count, dims, (SELECT count(*) FROM text_keys WHERE len(text) > 0) AS stored FROM (
  SELECT key, max(doc_id) AS doc_id, 0 AS access_count, 8 AS dims FROM text_keys WHERE len(text) > 0 GROUP BY key
  UNION ALL
  SELECT key, stored_doc, 1, 0 FROM text_store WHERE key NOT IN (SELECT key FROM text_keys WHERE len(text) > 0))""")
def bulk_store_stored(spark, folder):
    """The text store, written and read back, after a bulk write of all documents, and how many were stored."""
    cached = views.text_store(spark, folder).select(
        "key", F.col("stored_doc").alias("doc_id"), F.array().cast("array<float>").alias("embedding"),
        F.timestamp_micros(F.lit(views.STORE_START_US)).alias("created_at"), F.lit(1).alias("access_count"))
    entries = views.documents(spark, folder).withColumn("embedding", text_embedding("text"))
    after, stored = store.store_bulk(cached, store.bulk_store(entries, 8, views.as_of()), "doc_id")
    sharded = after.withColumn("shard", numbers.hash_bucket("key", views.SHARDS))
    path = storefiles.write_store(sharded, new_folder(spark, "texts"), 1)
    return storefiles.read_store(spark, path).select(
        "key", "doc_id", "access_count", F.size("embedding").alias("dims")).crossJoin(F.broadcast(stored))


def text_embedding(text: str):
    """A stand-in embedding of eight hash digits, so that texts have vectors to store; empty for no text."""
    digits = F.transform(F.sequence(F.lit(1), F.lit(8)),
                         lambda i: F.conv(F.substring(F.sha2(text, 256), i, F.lit(1)), 16, 10).cast("float"))
    return F.when(F.length(text) > 0, digits).otherwise(F.array().cast("array<float>"))


@query("metadata_json", """
SELECT embedding_id, '"' || model_name || '"' AS model_name_json, access_count::VARCHAR AS access_count_json,
       coalesce(ttl_seconds::VARCHAR, 'null') AS ttl_seconds_json, model_name, access_count,
       coalesce(ttl_seconds, 3600) AS ttl_seconds FROM store""")
def metadata_json(spark, folder):
    names = ["model_name", "access_count", "ttl_seconds"]
    encoded = store.metadata_json(views.store(spark, folder), names).drop(*names)
    decoded = store.metadata_from_json(
        encoded, {"model_name": "string", "access_count": "int", "ttl_seconds": "int"},
        {"model_name": F.lit("unknown"), "access_count": F.lit(1), "ttl_seconds": F.lit(store.DEFAULT_TTL_SECONDS)})
    return decoded.select("embedding_id", *[f"{n}_json" for n in names], *names)


@query("validate_vectors", "SELECT write_id, embedding_id, error FROM checked_incoming")
def validate_vectors(spark, folder):
    return store.validate_vectors(views.incoming(spark, folder), views.DIM).select("write_id", "embedding_id", "error")


def _search_requests(spark, folder):
    log = views.access_log(spark, folder)
    vectors = views.embeddings(spark, folder).select(F.col("vec_id").alias("embedding_id"), "embedding")
    return log.join(vectors, "embedding_id").select(
        "event_id", F.when(F.col("success"), F.col("embedding")).otherwise(F.slice("embedding", 1, 0)).alias("query_vec"),
        (F.floor(F.col("latency_ms") * 10) - 5).cast("int").alias("top_k"),
        (F.col("latency_ms") / 500.0 - 0.1).alias("threshold"))


@query("validate_requests", """
SELECT event_id,
       CASE WHEN NOT success THEN 'empty query' WHEN floor(latency_ms * 10) - 5 <= 0 THEN 'top_k must be positive'
            WHEN floor(latency_ms * 10) - 5 > 1000 THEN 'top_k too large' END AS error,
       round(CASE WHEN latency_ms / 500.0 - 0.1 > 0 THEN latency_ms / 500.0 - 0.1 ELSE 0.85 END + 1e-9, 6) AS threshold_used
FROM access_log""")
def validate_requests(spark, folder):
    checked = store.validate_requests(_search_requests(spark, folder))
    return checked.select("event_id", "error", nudged("threshold_used", 6).alias("threshold_used"))


@query("validate_batches", """
SELECT op || '-' || (event_id // 5000) AS batch_id, count(*) AS batch_size, count(*) BETWEEN 1 AND 1000 AS accepted
FROM access_log GROUP BY 1""")
def validate_batches(spark, folder):
    batch = F.concat("op", F.lit("-"), F.floor(F.col("event_id") / 5000).cast("string"))
    return store.validate_batches(views.access_log(spark, folder).withColumn("batch_id", batch))


@query("cache_key", "SELECT doc_id, key FROM text_keys")
def cache_key(spark, folder):
    return views.documents(spark, folder).select("doc_id", keys.cache_key("model_version", "text").alias("key"))


@query("content_hash", """
SELECT vec_id, min(vec_id) OVER (PARTITION BY v) AS same_as FROM vectors""")
def content_hash(spark, folder):
    """Each vector with the smallest id of the same hash; DuckDB compares the vectors themselves."""
    hashed = views.embeddings(spark, folder).select("vec_id", keys.content_hash("embedding").alias("content"))
    first = hashed.groupBy("content").agg(F.min("vec_id").alias("same_as"))
    return hashed.join(first, "content").select("vec_id", "same_as")


@query("parse_key", """
SELECT doc_id, 'index_embedding:' || key AS index_key,
       regexp_replace('index_embedding:' || key, '^[^:]*:', '') AS id FROM text_keys""")
def parse_key(spark, folder):
    keyed = views.documents(spark, folder).select("doc_id", keys.cache_key("model_version", "text").alias("key"))
    named = keyed.select("doc_id", keys.prefixed(keys.INDEX_PREFIX, "key").alias("index_key"))
    return named.withColumn("id", keys.strip_namespace("index_key"))


@query("expired_entries", """
SELECT embedding_id, epoch_us(created_at) AS created_us, ttl_seconds FROM store
WHERE embedding_id NOT IN (SELECT embedding_id FROM live_store)""")
def expired_entries(spark, folder):
    return store.expired_entries(views.store(spark, folder), views.as_of()).select(
        "embedding_id", F.unix_micros("created_at").alias("created_us"), "ttl_seconds")


@query("live_entries", "SELECT embedding_id, epoch_us(created_at) AS created_us, ttl_seconds FROM live_store")
def live_entries(spark, folder):
    return views.live_store(spark, folder).select(
        "embedding_id", F.unix_micros("created_at").alias("created_us"), "ttl_seconds")


@query("evict_by_pattern", """
SELECT key GLOB 'embedding:[ef]?:*a?' AS evicted, count(*) AS keys FROM (SELECT DISTINCT key FROM text_keys) GROUP BY 1""")
def evict_by_pattern(spark, folder):
    entries = views.documents(spark, folder).select(keys.cache_key("model_version", "text").alias("key")).distinct()
    kept, evicted = store.evict_by_pattern(entries, "key", "embedding:[ef]?:*a?")
    both = kept.withColumn("evicted", F.lit(False)).unionByName(evicted.withColumn("evicted", F.lit(True)))
    return both.groupBy("evicted").agg(F.count(F.lit(1)).alias("keys"))


def _invalid_keys(spark, folder):
    """Keys to remove: those of failed accesses, and ids of signups, which the store does not have."""
    log = views.access_log(spark, folder)
    failed = log.filter(~F.col("success")).select("embedding_id")
    return failed.unionByName(log.filter(F.col("op") == "signup").select(
        (F.col("user_id") + views.NEW_IDS).alias("embedding_id")))


ASKED = """(SELECT embedding_id FROM access_log WHERE NOT success
            UNION SELECT 1000000 + user_id FROM access_log WHERE op = 'signup')"""


@query("invalidate_keys", f"""
SELECT embedding_id, embedding_id IN (SELECT embedding_id FROM store) AS invalidated FROM {ASKED}""")
def invalidate_keys(spark, folder):
    return store.invalidate_keys(views.store(spark, folder), _invalid_keys(spark, folder))[1]


@query("invalidate_remaining", f"""
SELECT embedding_id, model_name FROM store WHERE embedding_id NOT IN {ASKED}""")
def invalidate_remaining(spark, folder):
    remaining = store.invalidate_keys(views.store(spark, folder), _invalid_keys(spark, folder))[0]
    return remaining.select("embedding_id", "model_name")


def touched(spark, folder):
    entries = views.store(spark, folder).withColumn("last_accessed", F.col("created_at"))
    return store.touch_metadata(entries, views.access_log(spark, folder))


@query("touch_metadata", "SELECT embedding_id, access_count, epoch_us(last_accessed) AS last_us FROM touched")
def touch_metadata(spark, folder):
    return touched(spark, folder).select(
        "embedding_id", "access_count", F.unix_micros("last_accessed").alias("last_us"))


@query("should_precompute", """
SELECT embedding_id, access_count >= 5 OR epoch_us(TIMESTAMP '2024-01-30 12:30:00') - epoch_us(last_accessed) < 300000000
         AS should_precompute FROM touched""")
def should_precompute(spark, folder):
    at = numbers.timestamp("2024-01-30 12:30:00")
    return touched(spark, folder).select("embedding_id", store.hot_entry(at).alias("should_precompute"))


@query("merge_shards", """
SELECT embedding_id, model_name, epoch_us(created_at) AS created_us FROM (
  SELECT *, row_number() OVER (PARTITION BY embedding_id ORDER BY created_at DESC, write_id DESC) AS rn FROM (
    SELECT embedding_id, model_name, created_at, -1 AS write_id FROM store UNION ALL
    SELECT embedding_id, model_name, created_at, write_id FROM incoming WHERE len(v) = 64)) WHERE rn = 1""")
def merge_shards(spark, folder):
    columns = ["embedding_id", "model_name", "created_at"]
    good, _ = store.split_valid(views.incoming(spark, folder), views.DIM)
    stored = views.store(spark, folder).select(*columns, F.lit(-1).cast("long").alias("write_id"))
    merged = store.merge_shards([stored, good.select(*columns, "write_id")], tie="write_id")
    return merged.select("embedding_id", "model_name", F.unix_micros("created_at").alias("created_us"))


@query("key_diff", """
SELECT embedding_id, CASE WHEN a AND b THEN 'common' WHEN b THEN 'added' ELSE 'removed' END AS change FROM (
  SELECT embedding_id, bool_or(side = 1) AS a, bool_or(side = 2) AS b FROM (
    SELECT embedding_id, 1 AS side FROM store WHERE created_at <= TIMESTAMP '2024-01-25' UNION ALL
    SELECT embedding_id, 2 FROM live_store) GROUP BY 1)""")
def key_diff(spark, folder):
    """Entries written by the 25th against those live at the end of the month."""
    before = views.store(spark, folder).filter(F.col("created_at") <= numbers.timestamp("2024-01-25 00:00:00"))
    return store.key_diff(before, views.live_store(spark, folder))


@query("content_groups", """
SELECT doc_id, h AS content, min(doc_id) OVER (PARTITION BY h) AS representative, count(*) OVER (PARTITION BY h) AS group_size
FROM (SELECT doc_id, substr(sha256(text), 1, 16) AS h FROM documents)""")
def content_groups(spark, folder):
    hashed = views.documents(spark, folder).select("doc_id", keys.text_hash("text").alias("content"))
    return store.content_groups(hashed, "content", "doc_id")


@query("vector_content_groups", """
SELECT key, min(key) OVER (PARTITION BY v) AS representative, count(*) OVER (PARTITION BY v) AS group_size FROM (
  SELECT embedding_id::VARCHAR AS key, v FROM store UNION ALL SELECT 'write:' || write_id, v FROM incoming)""")
def vector_content_groups(spark, folder):
    """Entries and writes that share their vector."""
    entries = views.store(spark, folder).select(F.col("embedding_id").cast("string").alias("key"), "embedding")
    writes = views.incoming(spark, folder).select(
        F.concat(F.lit("write:"), F.col("write_id").cast("string")).alias("key"), "embedding")
    hashed = entries.unionByName(writes).select("key", keys.content_hash("embedding").alias("content"))
    return store.content_groups(hashed, "content", "key").drop("content")


@query("index_stats", """
SELECT i.*, t.*, round(t.cache_hits / greatest(t.total_requests, 1) + 1e-9, 6) AS hit_ratio,
       CASE WHEN i.embedding_count > 0 THEN 'healthy' ELSE 'degraded' END AS status
FROM (SELECT count(*) AS embedding_count, max(len(v))::INTEGER AS embedding_dimensions,
             sum(4 * len(v))::BIGINT AS index_size_bytes FROM store) i,
     (SELECT count(*) AS total_requests, count(*) FILTER (cache_hit) AS cache_hits FROM request_log) t""")
def index_stats(spark, folder):
    stats = store.index_stats(views.store(spark, folder), views.request_log(spark, folder))
    return stats.withColumn("hit_ratio", nudged("hit_ratio", 6))


@query("scalar_suite", """
SELECT embedding_id, round(list_cosine_similarity(v, centroid) + 1e-9, 6) AS cosine, round(sqrt(list_dot_product(v, v)) + 1e-9, 6) AS norm,
       round(1 - (1 - list_cosine_similarity(v, centroid)) + 1e-9, 6) AS from_distance, round(ln(1 + similarity_cluster) + 1e-9, 6) AS log1p,
       round(least(1.0, similarity_cluster / 10.0) + 1e-9, 6) AS confidence, coalesce(ttl_seconds, 0) AS ttl_or_zero,
       4 * len(v) AS bytes, substr(sha256(model_name), 1, 16) AS model_hash,
       round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(created_at)) / 1e6 + 1e-9, 6) AS age_seconds,
       round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(created_at)) / 3.6e9 + 1e-9, 6) AS age_hours,
       CASE WHEN similarity_cluster = 0 THEN NULL ELSE round(1 - abs(similarity_cluster - 5) / greatest(similarity_cluster, 5) + 1e-9, 6)
         END AS closeness,
       round(coalesce(similarity_cluster / nullif(ttl_seconds, 0), 0) + 1e-12, 9) AS ratio,
       split_part(model_name, '_', 2) AS model_number, ends_with(model_name, '1') AS is_first,
       replace(model_name, 'model_', 'm') AS short_name, substr(model_name, 1, 3) AS start
FROM store JOIN centroids ON label = similarity_cluster""")
def scalar_suite(spark, folder):
    entries = views.store(spark, folder)
    means = clusters.group_means(entries, "similarity_cluster")
    near = cosine("embedding", "centroid")
    x = F.col("similarity_cluster")
    return entries.join(means, "similarity_cluster").select(
        "embedding_id", nudged(near, 6).alias("cosine"), nudged(l2_norm("embedding"), 6).alias("norm"),
        nudged(distance_to_similarity(F.lit(1.0) - near), 6).alias("from_distance"), nudged(F.log1p(x), 6).alias("log1p"),
        nudged(F.least(F.lit(1.0), x / 10.0), 6).alias("confidence"), F.coalesce("ttl_seconds", F.lit(0)).alias("ttl_or_zero"),
        vector_bytes("embedding").alias("bytes"), keys.text_hash("model_name").alias("model_hash"),
        nudged(numbers.age_seconds(views.as_of(), F.col("created_at")), 6).alias("age_seconds"),
        nudged(numbers.age_hours(views.as_of(), F.col("created_at")), 6).alias("age_hours"),
        F.when(x != 0, nudged(numbers.closeness(x, F.lit(5)), 6)).alias("closeness"),
        nudged(numbers.ratio(x, "ttl_seconds"), 9).alias("ratio"),
        F.split_part("model_name", F.lit("_"), F.lit(2)).alias("model_number"),
        F.endswith("model_name", F.lit("1")).alias("is_first"),
        F.regexp_replace("model_name", "model_", "m").alias("short_name"), F.substring("model_name", 1, 3).alias("start"))


@query("hash_buckets", """
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS same_as, true AS in_range FROM documents""")
def hash_buckets(spark, folder):
    """Each text with the smallest id of the same text and buckets; equal texts must share their buckets."""
    placed = views.documents(spark, folder).select(
        "doc_id", keys.text_hash("text").alias("content"), numbers.hash_bucket("text", 1000).alias("of_1000"),
        numbers.hash_bucket("text", 6).alias("of_6"))
    same = ["content", "of_1000", "of_6"]
    return placed.join(placed.groupBy(*same).agg(F.min("doc_id").alias("same_as")), same).select(
        "doc_id", "same_as", (F.col("of_1000").between(0, 999) & F.col("of_6").between(0, 5)).alias("in_range"))
