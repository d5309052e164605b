"""Registered queries: similarity search, lookup and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vectide.operators import cellindex, clusters, lookup, neighbours, similarity
from vectide.operators.store import accepted_writes
from vectide.plans import views
from vectide.plans.registry import query
from vectide.session import cut_lineage, new_folder

THRESHOLD = 0.2  # the test vectors are random, so the defaults of 0.7 and more match nothing but a vector itself


TOPK_SQL = """
SELECT query_id, embedding_id, round(similarity, 9) AS similarity, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, embedding_id) AS rank
  FROM all_pairs WHERE similarity >= {threshold} {where}) WHERE rank <= {limit}"""


@query("similar_topk", TOPK_SQL.format(threshold=0.2, where="", limit=10))
def similar_topk(spark, folder):
    found = similarity.similar_topk(views.store(spark, folder), views.query_vectors(spark, folder), 10, THRESHOLD, dim=views.DIM)
    return found


@query("similar_topk_cells", TOPK_SQL.format(threshold=0.2, where="", limit=10))
def similar_topk_cells(spark, folder):
    """The same search in the form for a query side of any size."""
    return similarity.similar_topk(
        views.store(spark, folder), views.query_vectors(spark, folder), 10, THRESHOLD, dim=views.DIM, max_queries=0)


@query("search_requests", """
SELECT query_id, embedding_id, round(similarity, 9) AS similarity, rank::INTEGER AS rank, NULL::VARCHAR AS error FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, embedding_id) AS rank
  FROM all_pairs WHERE similarity >= CASE WHEN query_id % 4 = 0 THEN 0.85 ELSE 0.1 + 0.05 * (query_id % 4) END)
WHERE rank <= query_id % 9 UNION ALL
SELECT query_id, NULL, NULL, NULL, 'top_k must be positive' FROM query_vectors WHERE query_id % 9 = 0""")
def search_requests(spark, folder):
    """Each request with its own top_k and threshold; no threshold means the default, no top_k is an error."""
    asked = views.query_vectors(spark, folder).select(
        "query_id", "query_vec", (F.col("query_id") % 9).alias("top_k"),
        F.when(F.col("query_id") % 4 != 0, 0.1 + 0.05 * (F.col("query_id") % 4)).alias("threshold"))
    answers, rejected = similarity.search_requests(views.store(spark, folder), asked, views.DIM)
    return answers.withColumn("error", F.lit(None).cast("string")).unionByName(
        rejected.select("query_id", "error"), allowMissingColumns=True)


@query("knn_then_threshold", """
SELECT query_id, embedding_id, round(similarity, 9) AS similarity, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, embedding_id) AS rank
  FROM all_pairs) WHERE rank <= 50 AND similarity >= 0.25""")
def knn_then_threshold(spark, folder):
    found = similarity.knn_then_threshold(
        views.store(spark, folder), views.query_vectors(spark, folder), threshold=0.25, dim=views.DIM)
    return found


@query("route_projection", """
SELECT query_id, rank::INTEGER AS rank, embedding_id, round(similarity, 9) AS similarity_score,
       'embedding:' || embedding_id AS cache_key, model_name, similarity_cluster, epoch_us(created_at) AS created_us FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, embedding_id) AS rank
  FROM all_pairs WHERE similarity >= 0.2) JOIN store USING (embedding_id) WHERE rank <= 50""")
def route_projection(spark, folder):
    store = views.store(spark, folder)
    found = similarity.knn_then_threshold(store, kept_queries(spark, folder), threshold=THRESHOLD, dim=views.DIM)
    records = similarity.route_projection(found, store, ("model_name", "similarity_cluster", "created_at"))
    return records.withColumn("created_us", F.unix_micros("created_at")).drop("created_at")


@query("find_similar_fetch", """
SELECT query_id, embedding_id, round(similarity, 9) AS similarity, rank::INTEGER AS rank, l.model_name,
       epoch_us(l.created_at) AS created_us, round(sqrt(list_dot_product(l.v, l.v)), 6) AS norm FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, embedding_id) AS rank
  FROM all_pairs WHERE similarity >= 0.2) JOIN live_store l USING (embedding_id) WHERE rank <= 20""")
def find_similar_fetch(spark, folder):
    from vectide.functions.vectors import l2_norm

    found = similarity.find_similar_fetch(
        views.store(spark, folder), views.live_store(spark, folder), views.query_vectors(spark, folder), 20, THRESHOLD,
        dim=views.DIM)
    return found.select(
        "query_id", "embedding_id", "similarity", "rank", "model_name",
        F.unix_micros("created_at").alias("created_us"), F.round(l2_norm("embedding"), 6).alias("norm"))


@query("filtered_search", """
SELECT query_id, embedding_id, round(similarity, 9) AS similarity, rank::INTEGER AS rank FROM (
  SELECT p.*, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, embedding_id) AS rank
  FROM all_pairs p JOIN store USING (embedding_id)
  WHERE similarity >= 0.2 AND model_name = 'model_1' AND similarity_cluster = 3) WHERE rank <= 10""")
def filtered_search(spark, folder):
    found = similarity.filtered_search(
        views.store(spark, folder), views.query_vectors(spark, folder),
        {"model_name": "model_1", "similarity_cluster": 3}, 10, THRESHOLD, dim=views.DIM)
    return found


@query("global_topk", """
SELECT embedding_id, round(list_cosine_similarity(v, m.mean), 9) AS similarity FROM store, (
  SELECT list(x ORDER BY i) AS mean FROM (
    SELECT i, avg(x) AS x FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vectors) GROUP BY i)) m
ORDER BY round(list_cosine_similarity(v, m.mean), 9) DESC, embedding_id LIMIT 10""")
def global_topk(spark, folder):
    store = views.store(spark, folder)
    mean = clusters.group_means(store.withColumn("query_id", F.lit(0)), "query_id").withColumnRenamed(
        "centroid", "query_vec")
    return similarity.global_topk(store, mean, 10, dim=views.DIM).select("embedding_id", "similarity")


NEIGHBOURS_SQL = """
SELECT a AS embedding_id, string_agg(b, ',' ORDER BY rank) AS neighbors FROM (
  SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS rank FROM (
    SELECT x.vec_id AS a, y.vec_id AS b, list_cosine_similarity(x.v, y.v) AS sim
    FROM vectors x, vectors y WHERE x.vec_id <> y.vec_id) WHERE sim >= 0.25) WHERE rank <= 10 GROUP BY a"""


@query("precompute_neighbors", NEIGHBOURS_SQL)
def precompute_neighbors(spark, folder):
    found = similarity.precompute_neighbors(views.store(spark, folder), 10, 0.25, dim=views.DIM)
    return found.select("embedding_id", F.array_join(
        F.col("precomputed_neighbors").cast("array<string>"), ",").alias("neighbors"))


@query("precompute_neighbors_cells", NEIGHBOURS_SQL)
def precompute_neighbors_cells(spark, folder):
    """The same lists in the form for a store of any size."""
    found = similarity.precompute_neighbors(views.store(spark, folder), 10, 0.25, dim=views.DIM, max_queries=0)
    return found.select("embedding_id", F.array_join(
        F.col("precomputed_neighbors").cast("array<string>"), ",").alias("neighbors"))


@query("neighbors_after_writes", """
SELECT a AS embedding_id, string_agg(b, ',' ORDER BY rank) AS neighbors FROM (
  SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b) AS rank FROM (
    SELECT x.embedding_id AS a, y.embedding_id AS b, list_cosine_similarity(x.v, y.v) AS sim
    FROM upserted x, upserted y WHERE x.embedding_id <> y.embedding_id) WHERE sim >= 0.25) WHERE rank <= 10 GROUP BY a""")
def neighbors_after_writes(spark, folder):
    """Lists kept with the index, after the log's writes in two batches."""
    kept = _clustered_index(spark, folder)
    lists = neighbours.NeighbourLists(spark, new_folder(spark, "neighbours"), kept, 10, 0.25)
    lists.build()
    writes = cut_lineage(accepted_writes(views.incoming(spark, folder), views.DIM, views.store(spark, folder).columns))
    for batch, part in enumerate((F.col("write_id") % 2 == 0, F.col("write_id") % 2 == 1)):
        lists.update(writes.filter(part), "log", batch)
    return lists.read().filter(F.size("neighbors") > 0).select("embedding_id", F.array_join(
        F.col("neighbors.embedding_id").cast("array<string>"), ",").alias("neighbors"))


def _recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """The approximate matches, each marked by whether the exact list has it."""
    known = exact.select("query_id", "embedding_id", F.lit(True).alias("_exact"))
    return approximate.join(known, ["query_id", "embedding_id"], "left").withColumn(
        "in_exact", F.coalesce("_exact", F.lit(False))).drop("_exact")


def _planes_sql() -> str:
    """The hyperplanes as rows (bit, plane)."""
    planes = similarity.hyperplanes(views.DIM, 6, 42)
    return " UNION ALL ".join(f"SELECT {bit} AS bit, {plane.tolist()}::DOUBLE[] AS plane" for bit, plane in enumerate(planes))


EXACT_MARK = """EXISTS (SELECT 1 FROM (
  SELECT query_id, embedding_id, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, embedding_id) AS rank
  FROM all_pairs WHERE similarity >= 0.2) x
  WHERE x.rank <= 10 AND x.query_id = f.query_id AND x.embedding_id = f.embedding_id) AS in_exact"""


@query("approx_similar_join", f"""
WITH planes AS ({_planes_sql()}),
signatures AS (
  SELECT vec_id, sum(CASE WHEN list_dot_product(v, plane) > 0 THEN 1 << bit ELSE 0 END)::INTEGER AS signature
  FROM vectors, planes GROUP BY vec_id),
found AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, embedding_id) AS rank
  FROM all_pairs p JOIN signatures a ON a.vec_id = p.query_id JOIN signatures b ON b.vec_id = p.embedding_id
  WHERE similarity >= 0.2 AND bit_count(xor(a.signature, b.signature)) <= 2)
SELECT query_id, embedding_id, round(similarity, 9) AS similarity, rank::INTEGER AS rank, {EXACT_MARK} FROM found f WHERE rank <= 10""")
def approx_similar_join(spark, folder):
    """Signatures kept as folders of an index: the search reads those within two bits of a query's own."""
    asked = kept_queries(spark, folder)
    kept = cellindex.CellIndex(spark, new_folder(spark, "signatures"), views.DIM, planes=True)
    kept.build(views.store(spark, folder), bits=6)
    found = kept.probe(asked, 3, 10, THRESHOLD)
    return _recall(similarity.similar_topk(views.store(spark, folder), asked, 10, THRESHOLD, dim=views.DIM), found)


@query("cluster_pruned_search", f"""
WITH probed AS (
  SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY near DESC, label) AS nth FROM (
    SELECT q.query_id, c.label, round(list_cosine_similarity(q.query_vec, c.centroid), 12) AS near
    FROM query_vectors q, centroids c)),
found AS (
  SELECT p.*, row_number() OVER (PARTITION BY p.query_id ORDER BY round(similarity, 9) DESC, p.embedding_id) AS rank
  FROM all_pairs p JOIN routed r USING (embedding_id)
  JOIN probed b ON b.query_id = p.query_id AND b.label = r.cluster AND b.nth <= 4 WHERE similarity >= 0.2)
SELECT query_id, embedding_id, round(similarity, 9) AS similarity, rank::INTEGER AS rank, {EXACT_MARK} FROM found f WHERE rank <= 10""")
def cluster_pruned_search(spark, folder):
    """Clusters kept as folders of an index: the search reads the four nearest to each query."""
    asked = kept_queries(spark, folder)
    kept = _clustered_index(spark, folder)
    return _recall(kept.search(asked, 10, THRESHOLD), kept.probe(asked, 4, 10, THRESHOLD))


def kept_queries(spark, folder):
    """The query side, computed once: it is read for its size, for its rows and by the search for comparison."""
    return cut_lineage(views.query_vectors(spark, folder))


def _clustered_index(spark, folder):
    store = views.store(spark, folder)
    _, centres = clusters.centroid_matrix(
        clusters.group_means(store, "similarity_cluster"), "similarity_cluster")
    kept = cellindex.CellIndex(spark, new_folder(spark, "cells"), views.DIM, tie="write_id")
    kept.build(store, centres)
    return kept


@query("indexed_search", TOPK_SQL.format(threshold=0.2, where="", limit=10))
def indexed_search(spark, folder):
    """The exact search from an index kept with the store."""
    kept = cellindex.CellIndex(spark, new_folder(spark, "cells"), views.DIM)
    kept.build(views.store(spark, folder))
    return kept.search(kept_queries(spark, folder), 10, THRESHOLD)


@query("indexed_search_after_writes", """
SELECT query_id, embedding_id, round(similarity, 9) AS similarity, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity, 9) DESC, embedding_id) AS rank FROM (
    SELECT q.query_id, u.embedding_id, list_cosine_similarity(q.query_vec, u.v) AS similarity
    FROM query_vectors q, upserted u) WHERE similarity >= 0.2) WHERE rank <= 10""")
def indexed_search_after_writes(spark, folder):
    """The exact search after the log's writes went into the cells they belong to."""
    kept = _clustered_index(spark, folder)
    writes = accepted_writes(views.incoming(spark, folder), views.DIM, views.store(spark, folder).columns)
    kept.upsert(writes, "log", 0)
    return kept.search(kept_queries(spark, folder), 10, THRESHOLD)


@query("threshold_sweep", """
SELECT t.threshold::DOUBLE AS threshold, count(*) FILTER (round(similarity, 9) >= t.threshold) AS pairs,
       count(*) FILTER (round(similarity, 9) >= t.threshold AND p.label = s.similarity_cluster) AS agreeing,
       round(coalesce(count(*) FILTER (round(similarity, 9) >= t.threshold AND p.label = s.similarity_cluster)
         / nullif(count(*) FILTER (round(similarity, 9) >= t.threshold), 0), 0), 6) AS agreement
FROM (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5]) AS threshold) t,
     (SELECT q.query_id, q.label, s.embedding_id, list_cosine_similarity(q.query_vec, s.v) AS similarity
      FROM query_vectors q, store s WHERE q.query_id <> s.embedding_id) p JOIN store s USING (embedding_id)
GROUP BY t.threshold""")
def threshold_sweep(spark, folder):
    store = views.store(spark, folder).withColumnRenamed("similarity_cluster", "label")
    swept = similarity.threshold_sweep(store, views.query_vectors(spark, folder), [0.1, 0.2, 0.3, 0.4, 0.5], dim=views.DIM)
    return swept.withColumn("agreement", F.round("agreement", 6))


@query("exact_lookup", """
SELECT doc_id, key, stored_doc FROM text_keys JOIN text_store USING (key)""")
def exact_lookup(spark, folder):
    found = lookup.text_lookup(views.documents(spark, folder), views.text_store(spark, folder))
    return found.select("doc_id", "key", "stored_doc")


@query("batch_lookup", """
SELECT event_id AS pos, l.embedding_id, s.embedding_id IS NOT NULL AS found, s.model_name, len(s.v)::INTEGER AS dims
FROM access_log l LEFT JOIN live_store s USING (embedding_id)""")
def batch_lookup(spark, folder):
    requests = views.access_log(spark, folder).select(F.col("event_id").alias("pos"), "embedding_id")
    answers = lookup.batch_lookup(requests, views.live_store(spark, folder))
    return answers.select("pos", "embedding_id", "found", "model_name", F.when(
        F.col("found"), F.size("embedding")).alias("dims"))


FALLBACK_SQL = """
SELECT r.event_id AS {id}, r.embedding_id,
       CASE WHEN l.embedding_id IS NOT NULL THEN l.embedding_id ELSE m.matched END AS matched_key,
       round(CASE WHEN l.embedding_id IS NULL THEN m.similarity END, 9) AS similarity_score,
       l.embedding_id IS NOT NULL OR m.matched IS NOT NULL AS found,
       l.embedding_id IS NULL AND m.matched IS NOT NULL AS similarity_match
FROM access_log r LEFT JOIN live_store l USING (embedding_id)
LEFT JOIN (
  SELECT query_id, matched, similarity FROM (
    SELECT p.query_id, p.embedding_id AS matched, p.similarity,
           row_number() OVER (PARTITION BY p.query_id ORDER BY round(p.similarity, 9) DESC, p.embedding_id) AS rank
    FROM all_pairs p JOIN live_store USING (embedding_id) WHERE p.similarity >= 0.28) WHERE rank = 1
) m ON m.query_id = r.embedding_id"""


@query("lookup_with_fallback", FALLBACK_SQL.format(id="pos"))
def lookup_with_fallback(spark, folder):
    requests = views.access_log(spark, folder).select(F.col("event_id").alias("pos"), "embedding_id")
    vectors = views.embeddings(spark, folder).select(F.col("vec_id").alias("embedding_id"), "embedding")
    answers = lookup.lookup_with_fallback(requests, views.live_store(spark, folder), vectors, 0.28, dim=views.DIM)
    return answers


@query("lookup_per_request", """
SELECT event_id AS pos, embedding_id, CASE WHEN hit THEN embedding_id WHEN good THEN matched END AS matched_key,
       round(CASE WHEN good THEN similarity END, 9) AS similarity_score, hit OR good AS found, good AS similarity_match
FROM (
  SELECT r.event_id, r.embedding_id, l.embedding_id IS NOT NULL AS hit, m.matched, m.similarity,
         l.embedding_id IS NULL AND r.user_id % 4 <> 0 AND coalesce(
           round(m.similarity, 9) >= CASE WHEN r.user_id % 3 = 0 THEN 0.35 ELSE 0.28 END, false) AS good
  FROM access_log r LEFT JOIN live_store l USING (embedding_id)
  LEFT JOIN (
    SELECT query_id, matched, similarity FROM (
      SELECT p.query_id, p.embedding_id AS matched, p.similarity,
             row_number() OVER (PARTITION BY p.query_id ORDER BY round(p.similarity, 9) DESC, p.embedding_id) AS rank
      FROM all_pairs p JOIN live_store USING (embedding_id)) WHERE rank = 1) m ON m.query_id = r.embedding_id)""")
def lookup_per_request(spark, folder):
    """Requests with a threshold of their own, and some that turn the fallback off."""
    requests = views.access_log(spark, folder).select(
        F.col("event_id").alias("pos"), "embedding_id", F.when(F.col("user_id") % 3 == 0, 0.35).alias("threshold"),
        (F.col("user_id") % 4 != 0).alias("enable_fallback"))
    vectors = views.embeddings(spark, folder).select(F.col("vec_id").alias("embedding_id"), "embedding")
    answers = lookup.lookup_with_fallback(requests, views.live_store(spark, folder), vectors, 0.28, dim=views.DIM)
    return answers.drop("threshold", "enable_fallback")


@query("orphan_index_entries", """
SELECT embedding_id, model_name FROM store WHERE embedding_id NOT IN (SELECT embedding_id FROM live_store)""")
def orphan_index_entries(spark, folder):
    found = lookup.orphan_index_entries(views.store(spark, folder), views.live_store(spark, folder))
    return found.select("embedding_id", "model_name")


@query("warm_candidates", """
SELECT key, min(doc_id) AS doc_id FROM text_keys
WHERE key NOT IN (SELECT key FROM text_store) GROUP BY key""")
def warm_candidates(spark, folder):
    found = lookup.warm_candidates(views.documents(spark, folder), views.text_store(spark, folder))
    return found.select("key", "doc_id")


def _centroids(spark, folder):
    return clusters.centroid_matrix(
        clusters.group_means(views.store(spark, folder), "similarity_cluster"), "similarity_cluster")


@query("route_to_cluster", "SELECT embedding_id, similarity_cluster, cluster FROM routed")
def route_to_cluster(spark, folder):
    routed = clusters.route_to_cluster(views.store(spark, folder), *_centroids(spark, folder))
    return routed.select("embedding_id", "similarity_cluster", "cluster")


@query("hash_route", """
SELECT vec_id AS embedding_id, min(vec_id) OVER (PARTITION BY v) AS same_as, true AS in_range FROM vectors""")
def hash_route(spark, folder):
    """Each entry with the smallest id of the same vector and cluster; equal vectors must share their cluster."""
    placed = views.store(spark, folder).select(
        "embedding_id", "embedding", clusters.hash_route("embedding").alias("cluster"))
    same = ["embedding", "cluster"]
    return placed.join(placed.groupBy(*same).agg(F.min("embedding_id").alias("same_as")), same).select(
        "embedding_id", "same_as", F.col("cluster").between(0, clusters.CLUSTERS - 1).alias("in_range"))


@query("assign_shard", "SELECT embedding_id, cluster, CAST(cluster % 6 AS INTEGER) AS shard FROM routed")
def assign_shard(spark, folder):
    routed = clusters.route_to_cluster(views.store(spark, folder), *_centroids(spark, folder))
    return routed.select("embedding_id", "cluster", clusters.assign_shard("cluster", views.SHARDS).alias("shard"))


@query("shard_memory", """
SELECT cluster % 6 AS shard, sum(4 * len(v))::BIGINT AS bytes, count(*) AS entries FROM routed
GROUP BY ROLLUP (cluster % 6)""")
def shard_memory(spark, folder):
    from vectide.operators.store import shard_memory as by_shard

    routed = clusters.route_to_cluster(views.store(spark, folder), *_centroids(spark, folder))
    return by_shard(routed.withColumn("shard", clusters.assign_shard("cluster", views.SHARDS)))


@query("kmeans_clusters", """
SELECT vec_id AS embedding_id, true AS nearest, 16 AS clusters FROM vectors""")
def kmeans_clusters(spark, folder):
    """Per entry whether the cluster it was given has the centre nearest to it, and the number of centres."""
    store = views.store(spark, folder)
    labelled, centres = clusters.kmeans_clusters(store)
    own = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])

    def distance(centre):
        return F.aggregate(F.zip_with("embedding", centre, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)

    ranges = F.transform(own, distance)
    return labelled.join(store.select("embedding_id", "embedding"), "embedding_id").select(
        "embedding_id", (F.element_at(ranges, F.col("cluster") + 1) <= F.array_min(ranges) + 1e-9).alias("nearest"),
        F.lit(len(centres)).alias("clusters"))
