"""Inputs at the edges: huge values in a frame, ragged vectors, key patterns, shapes, one computation per key."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vectide.functions.keys import glob_to_regex
from vectide.functions.vectors import dense
from vectide.operators import groups, lookup
from vectide.sources.blobs import shape_length


@pytest.mark.parametrize("huge", [float("inf"), 1e17])
def test_trailing_mean_forgets_what_left_the_frame(spark, huge):
    values = [1.0, huge, 1.0, 1.0, 1.0, float("nan"), 1.0]
    df = spark.createDataFrame([("a", i + 1, v) for i, v in enumerate(values)], "k string, position long, v double")
    got = {r["position"]: r["m"] for r in groups.trailing_mean(df, "k", "position", "v", 2, "m", block_rows=3).collect()}
    assert [got[i] for i in (1, 4, 5, 6, 7)] == [1.0, 1.0, 1.0, 1.0, 1.0]
    assert got[2] == (1.0 + huge) / 2


def test_ragged_vectors_are_refused():
    with pytest.raises(ValueError):
        dense(pa.array([[1.0, 2.0], [1.0, 2.0, 3.0], [1.0]]))
    assert dense(pa.array([[1.0, 2.0], [3.0, 4.0]])).tolist() == [[1.0, 2.0], [3.0, 4.0]]
    assert dense(pa.array([], pa.list_(pa.float64()))).shape == (0, 0)


@pytest.mark.parametrize("pattern, key, hit", [
    ("emb:1", "emb:1", True), ("emb:1", "emb:1\n", False), (r"a[\]]b", "a]b", True), ("a[^b]c", "abc", False),
    ("[ab]*", "bx\ny", True), ("[x", "[x", True), (r"a\*", "a*", True), (r"a\*", "ab", False)])
def test_key_patterns(spark, pattern, key, hit):
    row = spark.createDataFrame([(key,)], "k string").select(F.col("k").rlike(glob_to_regex(pattern))).first()
    assert row[0] is hit


def test_shape_too_large_for_a_long(spark):
    df = spark.createDataFrame([([100_000, 100_000],), ([(1 << 31) - 1] * 4,), ([2, 3],)], "s array<int>")
    assert [r[0] for r in df.select(shape_length(F.col("s"))).collect()] == [10_000_000_000, -1, 6]


def test_compute_runs_once_for_both_outputs(spark):
    calls = spark.sparkContext.accumulator(0)

    def compute(rows):
        def run(batches):
            for batch in batches:
                calls.add(batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([[1.0]] * batch.num_rows, pa.list_(pa.float32()))],
                    names=[*batch.schema.names, "embedding"])
        return rows.mapInArrow(run, rows.schema.simpleString()[7:-1].replace(":", " ") + ", embedding array<float>")

    requests = spark.createDataFrame([(1, "m", "a"), (2, "m", "b"), (3, "m", "a")], "doc_id long, model_version string, text string")
    cached = spark.createDataFrame([], "key string, embedding array<float>")
    answers, fresh = lookup.get_or_compute(requests, cached, compute, F.lit("2024-01-31").cast("timestamp"))
    assert answers.count() == 3 and fresh.count() == 2
    assert calls.value == 2


def _timed(spark, rows, schema="event_id long, embedding_id long, at string"):
    return spark.createDataFrame(rows, schema).withColumn("ts", F.col("at").cast("timestamp")).drop("at")


@pytest.mark.parametrize("rows_per_key", [1_000_000, 1])
def test_ttl_labels_without_key_or_time_and_with_repeated_ids(spark, rows_per_key):
    from vectide.operators.ttl import ttl_hits

    log = _timed(spark, [
        (1, None, "2024-01-01 00:00:00"), (2, None, "2024-01-01 00:10:00"),
        (1, 7, "2024-01-01 00:00:00"), (2, 7, "2024-01-01 02:00:00"), (3, 7, "2024-01-01 02:30:00"),
        (4, 7, None), (1, 8, "2024-01-01 00:05:00"), (9, 9, None)])
    got = ttl_hits(log, rows_per_key=rows_per_key, kept_per_span=2, max_spans=2)
    assert got.columns == ["event_id", "embedding_id", "ts", "cache_hit"]
    assert sorted(((r["embedding_id"] or 0, r["event_id"]), r["cache_hit"]) for r in got.collect()) == [
        ((0, 1), False), ((0, 2), True), ((7, 1), False), ((7, 2), False), ((7, 3), True), ((7, 4), False),
        ((8, 1), False), ((9, 9), False)]


def test_previous_rows_without_key_or_time(spark):
    log = _timed(spark, [
        (1, None, "2024-01-01 00:00:00"), (2, None, "2024-01-01 05:00:00"), (3, 7, None), (4, 7, "2024-01-01 00:00:00")])
    rows = groups.with_previous(log, "embedding_id", "ts", "event_id", ["event_id"], 600).collect()
    assert sorted((r["event_id"], r["position"], r["previous"] and r["previous"]["event_id"]) for r in rows) == [
        (1, 1, None), (2, 2, 1), (3, 1, None), (4, 2, 3)]


def test_merged_shards_do_not_depend_on_their_order(spark):
    from vectide.operators.store import merge_shards

    a, b = (_timed(spark, [(n, 1, "2024-01-01 00:00:00")]).withColumnRenamed("ts", "created_at") for n in (1, 2))
    assert merge_shards([a, b]).collect() == merge_shards([b, a]).collect()
    for shards in ([a, b], [b, a]):
        assert [r["event_id"] for r in merge_shards(shards, tie="event_id").collect()] == [2]


def test_neighbour_lists_that_are_empty(spark):
    from vectide.operators.similarity import precompute_neighbors

    store = spark.createDataFrame(
        [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None)], "embedding_id long, embedding array<float>")
    got = {r[0]: r[1] for r in precompute_neighbors(store, with_empty=True).collect()}
    assert got == {1: [2], 2: [1], 3: [], 4: []}


def test_routing_falls_back_to_hashes(spark):
    from vectide.operators import clusters

    rows = [(1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [float("nan"), 1.0]), (6, [0.1, 1.0]), (7, [float("inf"), 0.0])]
    store = spark.createDataFrame(rows, "embedding_id long, embedding array<float>")
    centroids = np.array([[1.0, 0.0], [0.0, 1.0]])
    got = {r["embedding_id"]: r["cluster"] for r in clusters.route_to_cluster(store, [7, 9], centroids).collect()}
    assert (got[1], got[6]) == (7, 9) and all(0 <= got[i] < clusters.CLUSTERS for i in (2, 3, 4, 5, 7))
    plain = {r["embedding_id"]: r["cluster"] for r in clusters.route_to_cluster(store, [], None).collect()}
    assert all(plain[i] == got[i] for i in (2, 3, 4, 5, 7))
    placed = spark.createDataFrame([(1, 8), (2, None)], "k long, c int").select(
        clusters.assign_shard("c", 6).alias("a"), clusters.assign_shard("c", 6, "k").alias("b")).collect()
    assert tuple(placed[0]) == (2, 2) and placed[1]["a"] is None and 0 <= placed[1]["b"] < 6


def test_bytes_of_vectors_row_by_row(spark):
    from vectide.functions.vectors import float32_bytes
    from vectide.sources import blobs

    vectors = [[1.0, 2.5], None, [], [0.1] * 5, [-3.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i int, embedding array<float>").coalesce(1)
    got = [r[0] for r in df.orderBy("i").select(float32_bytes("embedding")).collect()]
    assert [None if g is None else bytes(g) for g in got] == [None if v is None else np.array(v, "<f4").tobytes() for v in vectors]
    raw = [(0, np.array([1.5, 2.0], "<f4").tobytes(), "float32", [2]), (1, np.array([1.5, 2.0, 3.0], "<f8").tobytes(), "float64", [3]),
           (2, b"123", "float32", [1]), (3, b"", "float32", [0]), (4, None, "float32", [1]), (5, b"1234", "int8", [1]),
           (6, np.array([9.0], "<f4").tobytes(), "float32", [1, 1]), (7, b"1234", None, [1]), (8, b"1234", "float32", None)]
    table = spark.createDataFrame(raw, "i int, blob binary, element_type string, shape array<int>").coalesce(1)
    good, bad = blobs.decode_vectors(table)
    assert {r["i"]: list(r["embedding"]) for r in good.collect()} == {0: [1.5, 2.0], 1: [1.5, 2.0, 3.0], 3: [], 6: [9.0]}
    assert {r["i"] for r in bad.collect()} == {2, 4, 5, 7, 8}


def test_working_folders_can_be_removed(spark, monkeypatch):
    import os

    from vectide import session

    monkeypatch.setattr(session, "_FOLDERS", [])  # those of other tests stay
    path = session.new_folder(spark, "gone")
    spark.range(3).write.parquet(path)
    session.new_folder(spark, "never-written")
    local = path.removeprefix("file:")
    assert os.path.exists(local) and session.remove_working_folders(spark) == 1
    assert not os.path.exists(local) and session.remove_working_folders(spark) == 0
