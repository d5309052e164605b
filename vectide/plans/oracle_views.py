"""The derived views of `views` as DuckDB SQL over the raw tables.

embeddings is always used through `vectors`, whose vectors are DOUBLE[].
"""

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

VIEWS = {
    "vectors": "SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings",
    "store": f"""
        SELECT vec_id AS embedding_id, v, 'model_' || (vec_id % 3) AS model_name, label AS similarity_cluster,
               TIMESTAMP '2024-01-20' + to_minutes(30 * (vec_id % 500)) AS created_at,
               CASE WHEN vec_id % 5 = 0 THEN NULL ELSE 604800 END AS ttl_seconds, 1 AS access_count
        FROM vectors""",
    "live_store": f"""
        SELECT * FROM store
        WHERE ttl_seconds IS NULL OR epoch_us({AS_OF}) - epoch_us(created_at) <= ttl_seconds::BIGINT * 1000000""",
    "access_log": """
        SELECT event_id, ts, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS embedding_id,
               event_type AS op, value AS latency_ms, event_type <> 'error' AS success,
               CASE WHEN event_type <> 'error' THEN least(1.0, value / 500.0) END AS similarity_score
        FROM events""",
    "keyed_log": """
        SELECT l.*, s.similarity_cluster AS cluster_id, len(s.v) AS vector_size, s.model_name
        FROM access_log l JOIN store s USING (embedding_id)""",
    "loads": """
        SELECT embedding_id, min(ts) AS ts FROM access_log GROUP BY 1
        UNION ALL
        SELECT l.embedding_id, min(l.ts) FROM loads e JOIN access_log l
          ON l.embedding_id = e.embedding_id AND epoch_us(l.ts) - epoch_us(e.ts) > 3600000000
        GROUP BY l.embedding_id""",
    "miss_events": """
        SELECT min(l.event_id) AS event_id FROM loads e JOIN access_log l
          ON l.embedding_id = e.embedding_id AND l.ts = e.ts GROUP BY e.embedding_id, e.ts""",
    "request_log": """
        SELECT l.*, l.event_id NOT IN (SELECT event_id FROM miss_events) AS cache_hit FROM access_log l""",
    "query_vectors": """
        SELECT vec_id AS query_id, v AS query_vec, label FROM vectors
        WHERE vec_id IN (SELECT embedding_id FROM access_log)""",
    "all_pairs": """
        SELECT q.query_id, s.embedding_id, list_cosine_similarity(q.query_vec, s.v) AS similarity
        FROM query_vectors q, store s""",
    "text_requests": "SELECT doc_id, text, lang AS model_version FROM documents",
    "text_keys": """
        SELECT doc_id, lang AS model_version,
               'embedding:' || lang || ':' || substr(sha256(text), 1, 16) AS key, text FROM documents""",
    "text_store": """
        SELECT key, min(doc_id) AS stored_doc FROM text_keys
        WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY key""",
    "incoming": """
        SELECT CASE WHEN e.op = 'signup' THEN 1000000 + e.user_id ELSE e.embedding_id END AS embedding_id,
               CASE WHEN e.op = 'error' THEN v.v[1:e.user_id % 4] ELSE v.v END AS v,
               'model_new' AS model_name, v.label AS similarity_cluster, e.ts AS created_at, e.event_id AS write_id
        FROM access_log e JOIN vectors v ON v.vec_id = e.embedding_id
        WHERE e.op IN ('purchase', 'signup', 'error')""",
    "checked_incoming": """
        SELECT *, CASE WHEN embedding_id IS NULL THEN 'empty key' WHEN len(v) = 0 THEN 'empty vector'
                       WHEN len(v) <> 64 THEN 'wrong dimension' END AS error FROM incoming""",
    "upserted": """
        SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY embedding_id ORDER BY created_at DESC, write_id DESC) AS rn FROM (
            SELECT embedding_id, v, model_name, similarity_cluster, created_at, -1 AS write_id, ttl_seconds FROM store
            UNION ALL
            SELECT embedding_id, v, model_name, similarity_cluster, created_at, write_id, NULL FROM checked_incoming
            WHERE error IS NULL)) WHERE rn = 1""",
    "centroid_elements": """
        SELECT label, i, avg(x) AS x FROM (
          SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors) GROUP BY label, i""",
    "centroids": "SELECT label, list(x ORDER BY i) AS centroid FROM centroid_elements GROUP BY label",
    "routed": """
        SELECT embedding_id, cluster, similarity_cluster, v FROM (
          SELECT s.embedding_id, s.v, s.similarity_cluster, c.label AS cluster,
                 row_number() OVER (PARTITION BY s.embedding_id
                   ORDER BY round(list_cosine_similarity(s.v, c.centroid), 12) DESC, c.label) AS rn
          FROM store s, centroids c) WHERE rn = 1""",
    "patterns": """
        SELECT *, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 0.0) AS time_since_last_access,
               row_number() OVER w AS access_frequency
        FROM keyed_log WINDOW w AS (PARTITION BY embedding_id ORDER BY ts, event_id)""",
    "key_stats": """
        SELECT c.*, coalesce(s.avg_similarity, 0.0) AS avg_similarity FROM (
          SELECT embedding_id, count(*) AS access_count, max(ts) AS last_access,
                 CASE WHEN count(*) > 1 THEN avg(CASE WHEN access_frequency > 1 THEN time_since_last_access END) END
                   AS average_interval
          FROM patterns GROUP BY embedding_id) c
        LEFT JOIN (
          SELECT embedding_id, avg(similarity_score) AS avg_similarity FROM (
            SELECT embedding_id, similarity_score,
                   row_number() OVER (PARTITION BY embedding_id ORDER BY ts DESC, event_id DESC) AS rn
            FROM access_log WHERE similarity_score IS NOT NULL) WHERE rn <= 100 GROUP BY 1) s USING (embedding_id)""",
    "usage": f"""
        SELECT c.embedding_id, c.access_count, last_access,
               (epoch_us({AS_OF}) - epoch_us(last_access)) / 1e6 / 3600.0 AS hours_since_access,
               c.access_count / 720.0 AS access_frequency, sqrt(list_dot_product(s.v, s.v)) AS vector_norm,
               len(s.v) AS dimension, s.similarity_cluster AS similarity_group,
               least(c.access_count / 720.0, 1.0) AS label
        FROM (SELECT embedding_id, count(*) AS access_count, max(ts) AS last_access FROM access_log GROUP BY 1) c
        JOIN store s USING (embedding_id)""",
    "needs": """
        SELECT k.embedding_id, k.access_count, u.label AS prediction, least(1.0, k.access_count / 10.0) AS confidence,
               u.label * least(1.0, k.access_count / 10.0) * ln(1 + k.access_count) AS priority_score,
               u.label > 0.12 AND least(1.0, k.access_count / 10.0) > 0.5 AND k.access_count > 2 AS should_precompute
        FROM key_stats k JOIN usage u USING (embedding_id)""",
    "touched": """
        SELECT s.embedding_id, s.access_count + coalesce(n, 0) AS access_count,
               greatest(s.created_at, coalesce(last, s.created_at)) AS last_accessed, s.ttl_seconds, s.created_at
        FROM store s LEFT JOIN (
          SELECT embedding_id, count(*) AS n, max(ts) AS last FROM access_log GROUP BY 1) l USING (embedding_id)""",
    "user_steps": """
        SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap_us, lag(embedding_id) OVER w AS before_key
        FROM access_log WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "session_rows": """
        SELECT *, CASE WHEN new_session THEN NULL ELSE before_key END AS previous_key,
               max(CASE WHEN new_session THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id
                 ROWS UNBOUNDED PRECEDING) AS session_start
        FROM (SELECT *, gap_us IS NULL OR gap_us > 21600000000 AS new_session FROM user_steps)""",
}
