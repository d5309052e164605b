"""Similarity search against NumPy, in both physical forms, with edge vectors and a hot cell."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectide.operators import clusters, lookup, similarity


@pytest.fixture(scope="module")
def data(spark):
    """600 vectors around 12 centres, 40 % of them copies near one centre."""
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    group = np.where(rng.random(600) < 0.4, 0, rng.integers(1, 12, 600))
    matrix = (centres[group] + 0.35 * rng.standard_normal((600, 16))).astype(np.float32)
    matrix[500:520] = matrix[10]
    rows = [(i, [float(x) for x in v], int(g)) for i, (v, g) in enumerate(zip(matrix, group))]
    frame = spark.createDataFrame(rows, "embedding_id long, embedding array<float>, label int").repartition(5).cache()
    queries = frame.select(F.col("embedding_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    unit = matrix.astype(float) / np.linalg.norm(matrix.astype(float), axis=1, keepdims=True)
    return frame, queries, unit @ unit.T


def _best(scores, k, threshold, skip_self=False):
    out = {}
    for q, row in enumerate(np.round(scores, 9)):
        order = sorted((-s, i) for i, s in enumerate(row) if s >= threshold and not (skip_self and i == q))
        out[q] = [i for _, i in order[:k]]
    return {q: ids for q, ids in out.items() if ids}


def _lists(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["embedding_id"])
    return out


@pytest.mark.parametrize("how", [{}, {"max_queries": 0, "n_pivots": 20, "block_rows": 64}])
@pytest.mark.parametrize("threshold", [0.2, 0.9])
def test_topk_is_exact_in_both_forms(data, how, threshold):
    frame, queries, scores = data
    assert _lists(similarity.similar_topk(frame, queries, 7, threshold, **how)) == _best(scores, 7, threshold)


@pytest.mark.parametrize("how", [{}, {"max_queries": 0, "n_pivots": 20, "block_rows": 100}])
def test_neighbours_leave_out_the_entry_itself(data, how):
    frame, _, scores = data
    got = {r["embedding_id"]: r["precomputed_neighbors"]
           for r in similarity.precompute_neighbors(frame, 5, 0.8, **how).collect()}
    assert got == _best(scores, 5, 0.8, skip_self=True)


def test_ids_that_end_alike(spark):
    rows = [("1", [1.0, 0.0]), ("11", [1.0, 0.0]), ("a:1", [0.0, 1.0])]
    store = spark.createDataFrame(rows, "embedding_id string, embedding array<float>")
    got = {r[0]: r[1] for r in similarity.precompute_neighbors(store).collect()}
    assert got == {"1": ["11"], "11": ["1"]}


def test_edge_vectors_match_nothing(spark):
    rows = [(1, [0.0, 0.0]), (2, [float("nan"), 1.0]), (3, [1.0]), (4, []), (5, None), (6, [3.0, 0.0])]
    store = spark.createDataFrame(rows, "embedding_id long, embedding array<float>")
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0])], "query_id long, query_vec array<float>")
    for how in ({}, {"max_queries": 0, "n_pivots": 3}):
        got = similarity.similar_topk(store, queries, 10, -1.0, **how).collect()
        assert [(r["query_id"], r["embedding_id"], r["similarity"]) for r in got] == [(0, 6, 1.0)]


def test_empty_store_and_large_k(spark, data):
    frame, queries, _ = data
    assert similarity.similar_topk(frame.limit(0), queries, 5, 0.0).count() == 0
    one = queries.filter("query_id = 3")
    assert similarity.similar_topk(frame, one, 5000, -1.0).count() == 600
    assert similarity.knn_then_threshold(frame, one, 0, -1.0).count() == similarity.ROUTER_CANDIDATES


def test_similarity_is_symmetric_and_one_to_itself(data):
    frame, queries, _ = data
    pairs = {(r[0], r[1]): round(r[2], 9) for r in similarity.scored_pairs(frame, queries, 0.5).collect()}
    assert all(pairs[(b, a)] == s for (a, b), s in pairs.items())
    assert all(pairs[(i, i)] == 1.0 for i in range(600))


@pytest.mark.parametrize("how", [{}, {"max_queries": 0, "block_rows": 50}])
def test_approximate_search_is_a_subset_with_high_recall(data, how):
    frame, queries, scores = data
    want = {(q, i) for q, ids in _best(scores, 600, 0.9).items() for i in ids}
    for flips, recall in ((2, 0.9), (6, 1.0)):
        got = {(r["query_id"], r["embedding_id"]) for r in similarity.approx_similar_join(
            frame, queries, 0.9, 600, bits=6, flips=flips, **how).collect()}
        assert got <= want and len(got) >= recall * len(want)


@pytest.mark.parametrize("how", [{}, {"max_queries": 0, "block_rows": 70}])
def test_cluster_pruned_search(data, how):
    frame, queries, scores = data
    _, centres = clusters.centroid_matrix(clusters.group_means(frame, "label"), "label")
    want = {(q, i) for q, ids in _best(scores, 5, 0.85).items() for i in ids}
    for probes, recall in ((2, 0.9), (12, 1.0)):
        got = {(r["query_id"], r["embedding_id"]) for r in similarity.cluster_pruned_search(
            frame, queries, centres, probes, 5, 0.85, **how).collect()}
        assert len(got & want) >= recall * len(want)


def test_kmeans_needs_as_many_entries_as_clusters(data):
    frame, _, _ = data
    assert clusters.kmeans_clusters(frame.limit(10)) is None
    labelled, centres = clusters.kmeans_clusters(frame, 12)
    assert centres.shape == (12, 16) and labelled.count() == 600
    again = clusters.kmeans_clusters(frame, 12)[1]
    assert np.allclose(centres, again)


@pytest.mark.parametrize("how", [{}, {"max_queries": 100}, {"max_queries": 100, "n_pivots": 9, "block_rows": 50}])
def test_sweep_in_both_forms(data, how):
    frame, _, scores = data
    queries = frame.select(F.col("embedding_id").alias("query_id"), F.col("embedding").alias("query_vec"), "label")
    counts = {r["threshold"]: r["pairs"] for r in similarity.threshold_sweep(frame, queries, [0.3, 0.8], **how).collect()}
    off = np.round(scores, 9)[~np.eye(600, dtype=bool)]
    assert counts == {0.3: int((off >= 0.3).sum()), 0.8: int((off >= 0.8).sum())}


def test_fallback_and_batch_lookup(spark):
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "embedding_id long, embedding array<float>")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (7, [1.0, 0.1]), (8, [-1.0, -1.0])], "embedding_id long, embedding array<float>")
    requests = spark.createDataFrame([(0, 1), (1, 7), (2, 8), (3, 1), (4, 99)], "pos long, embedding_id long")
    got = {r["pos"]: (r["matched_key"], r["found"], r["similarity_match"]) for r in
           lookup.lookup_with_fallback(requests, store, vectors, 0.9).collect()}
    assert got == {0: (1, True, False), 1: (1, True, True), 2: (None, False, False), 3: (1, True, False), 4: (None, False, False)}
    found = lookup.batch_lookup(requests, store).orderBy("pos").collect()
    assert [r["found"] for r in found] == [True, False, False, True, False]


def test_both_forms_of_pruned_search_agree(data):
    frame, queries, _ = data
    forms = [similarity.approx_similar_join(frame, queries, 0.5, 9, bits=5, flips=1, **how)
             for how in ({}, {"max_queries": 0, "block_rows": 40})]
    assert sorted(forms[0].collect()) == sorted(forms[1].collect())


def test_bound_of_the_kth_best_leaves_out_most_cells(spark, monkeypatch):
    """On clustered data a query is scored against a small part of the store, also with a low threshold."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 16))
    matrix = np.repeat(centres, 50, axis=0) + 0.05 * rng.standard_normal((2000, 16))
    frame = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in enumerate(matrix)], "embedding_id long, embedding array<float>").cache()
    queries = frame.select(F.col("embedding_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    scored, real = [], similarity._score_cells

    def counted(store, asked, sizes, *rest):
        visits = asked.select(F.explode("cells").alias("cell")).groupBy("cell").count().collect()
        scored.append(sum(r["count"] * sizes[r["cell"]] for r in visits))
        return real(store, asked, sizes, *rest)

    monkeypatch.setattr(similarity, "_score_cells", counted)
    got = _lists(similarity.similar_topk(frame, queries, 5, 0.2, max_queries=0, n_pivots=80))
    assert got == _lists(similarity.similar_topk(frame, queries, 5, 0.2))
    assert len(scored) == 2 and sum(scored) < 0.25 * 2000 * 2000


@pytest.mark.parametrize("how", [{}, {"max_queries": 0}])
def test_empty_store_and_queries_of_several_lengths(spark, data, how):
    frame, queries, _ = data
    assert similarity.similar_topk(frame.limit(0), queries, 5, 0.0, **how).count() == 0
    assert similarity.similar_topk(frame, queries.limit(0), 5, 0.0, dim=16, **how).count() == 0
    store = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0, 0.0])], "embedding_id long, embedding array<float>")
    mixed = spark.createDataFrame([(7, [0.0, 1.0, 0.0]), (8, [1.0, 0.0]), (9, None), (10, [1.0, None])],
                                  "query_id long, query_vec array<float>")
    for dim, pair in ((2, (8, 1)), (3, (7, 2))):
        got = similarity.similar_topk(store, mixed, 5, 0.5, dim=dim, **how).collect()
        assert [(r["query_id"], r["embedding_id"]) for r in got] == [pair]
    assert sorted(r["query_id"] for r in similarity.set_aside(mixed, 2).collect()) == [7, 9, 10]


@pytest.mark.parametrize("how", [{}, {"max_queries": 0, "n_pivots": 20, "block_rows": 64}])
def test_requests_with_their_own_limit_and_threshold(spark, data, how):
    frame, queries, scores = data
    asked = queries.filter("query_id < 40").withColumn("top_k", (F.col("query_id") % 7).cast("int")).withColumn(
        "threshold", F.when(F.col("query_id") % 3 != 0, F.col("query_id") / 50))
    bad = spark.createDataFrame([(900, [1.0], 3, 0.5), (901, [], 3, 0.5), (902, None, 1001, 0.5)],
                                "query_id long, query_vec array<float>, top_k int, threshold double")
    answers, rejected = similarity.search_requests(frame, asked.unionByName(bad), 16, **how)
    want = {q: _best(scores[q:q + 1], q % 7, 0.85 if q % 3 == 0 else q / 50)[0] for q in range(40) if q % 7}
    assert _lists(answers) == want
    assert {r["query_id"]: r["error"] for r in rejected.collect()} == {
        **{q: "top_k must be positive" for q in range(0, 40, 7)}, 900: "wrong dimension", 901: "empty query", 902: "empty query"}


def test_entries_and_queries_need_one_id_type(spark, data):
    frame, queries, _ = data
    with pytest.raises(ValueError):
        similarity.scored_pairs(frame, queries.withColumn("query_id", F.col("query_id").cast("string")), 0.5, skip_self=True)


def test_a_query_is_sent_once_to_a_block_of_cells(spark):
    """Where all cells are visited, rows and queries are copied per block, not per cell."""
    store = spark.range(2000).select(
        F.col("id").alias("embedding_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"), (F.col("id") % 64).cast("int").alias("cell"))
    asked = store.select(F.col("embedding_id").alias("query_id"), F.col("embedding").alias("query_vec"), F.lit(0.0).alias("bar"),
                         F.when(F.col("cell") < 60, F.sequence(F.lit(0), F.lit(63))).otherwise(F.array("cell")).alias("cells"))

    def count(stored, queries):
        return pa.table({"rows": [stored.num_rows + queries.num_rows], "pairs": [sum(
            stored.num_rows if cells is None else sum(c in cells for c in stored.column("cell").to_pylist())
            for cells in queries.column("cells").to_pylist())]})

    sizes = {r["cell"]: r["count"] for r in store.groupBy("cell").count().collect()}
    found = similarity._score_cells(store, asked, sizes, "rows long, pairs long", count, similarity.BLOCK_ROWS)
    sent, met = found.agg(F.sum("rows"), F.sum("pairs")).first()
    each = asked.select(F.explode("cells").alias("cell")).collect()
    assert sent <= 4 * 4 * 2000 and met == sum(sizes[r["cell"]] for r in each)


def test_copies_of_a_vector_leave_a_block_by_the_limit():
    n = 1500
    stored = pa.table({"embedding_id": pa.array(range(n), pa.int64()), "embedding": [[1.0, 2.0]] * n, "cell": pa.array([0] * n, pa.int32())})
    asked = pa.table({"query_id": pa.array(range(n), pa.int64()), "query_vec": [[1.0, 2.0]] * n, "bar": [0.5] * n,
                      "cells": pa.array([None] * n, pa.list_(pa.int32()))})
    found = similarity._match_blocks(3, True)(stored, asked).to_pydict()
    got = {}
    for q, i in zip(found["query_id"], found["embedding_id"]):
        got.setdefault(q, set()).add(i)
    assert len(found["query_id"]) == 3 * n and got[0] == {1, 2, 3} and got[2] == {0, 1, 3} and got[900] == {0, 1, 2}
