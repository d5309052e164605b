"""Store upkeep, sources and sinks on small hand-made frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.functions import keys
from vectide.functions.numbers import timestamp
from vectide.operators import predict, store
from vectide.sources import blobs, models, storefiles
from vectide.sources.tables import load_store


def _entries(spark, rows):
    frame = spark.createDataFrame(rows, "embedding_id long, embedding array<float>, at string, ttl_seconds int")
    return frame.withColumn("created_at", F.col("at").cast("timestamp")).drop("at")


def test_ttl_boundary_stays_live(spark):
    rows = [(1, [1.0], "2024-01-01 00:00:00", 60), (2, [1.0], "2023-12-31 23:59:59.999999", 60), (3, [1.0], "2020-01-01", None)]
    entries = _entries(spark, rows)
    now = timestamp("2024-01-01 00:01:00")
    assert sorted(r[0] for r in store.live_entries(entries, now).collect()) == [1, 3]
    assert [r[0] for r in store.expired_entries(entries, now).collect()] == [2]
    assert sorted(r[0] for r in store.expired_entries(entries, now, 3600).collect()) == [2, 3]


def test_upsert_keeps_the_newest_valid_write(spark):
    base = _entries(spark, [(1, [1.0, 1.0], "2024-01-02", None), (2, [2.0, 2.0], "2024-01-02", None)])
    writes = _entries(spark, [(1, [5.0, 5.0], "2024-01-03", 9), (1, [4.0, 4.0], "2024-01-02", None), (2, [3.0, 3.0], "2024-01-01", None),
                              (3, [1.0], "2024-01-03", None), (4, [7.0, 7.0], "2024-01-03", None), (2, [], "2024-01-09", None)])
    merged = {r["embedding_id"]: r["embedding"] for r in store.upsert_store(base, writes, 2).collect()}
    assert merged == {1: [5.0, 5.0], 2: [2.0, 2.0], 4: [7.0, 7.0]}
    again = store.upsert_store(store.upsert_store(base, writes, 2), writes, 2)
    assert {r["embedding_id"]: r["embedding"] for r in again.collect()} == merged


def test_validation_names_the_rule(spark):
    rows = spark.createDataFrame([("", [1.0, 2.0]), ("a", []), ("b", [1.0]), ("c", [1.0, 2.0]), (None, None)],
                                 "embedding_id string, embedding array<float>")
    got = [r["error"] for r in store.validate_vectors(rows, 2).collect()]
    assert got == ["empty key", "empty vector", "wrong dimension", None, "empty key"]
    assert load_store(rows, 2).count() == 2


@pytest.mark.parametrize("pattern, hits", [
    ("emb:*", ["emb:1", "emb:11", "emb:a:b"]), ("*1", ["emb:1", "emb:11", "meta:1"]), ("emb:?", ["emb:1"]),
    ("[em]*:1", ["emb:1", "meta:1"]), ("emb:[^1]*", ["emb:a:b"]), ("emb:1", ["emb:1"]), ("x.z", ["x.z"]), ("emb:\\*", [])])
def test_evict_by_pattern(spark, pattern, hits):
    rows = spark.createDataFrame([(k,) for k in ("emb:1", "emb:11", "emb:a:b", "meta:1", "x.z", "xyz")], "key string")
    kept, evicted = store.evict_by_pattern(rows, "key", pattern)
    assert sorted(r[0] for r in evicted.collect()) == sorted(hits)
    assert kept.count() + evicted.count() == 6


def test_namespace_is_cut_at_the_first_colon(spark):
    row = spark.createDataFrame([("emb:a:b",)], "k string").select(keys.strip_namespace("k")).first()
    assert row[0] == "a:b"


def test_vectors_round_trip_and_bad_blobs_are_set_aside(spark):
    frame = spark.createDataFrame([(1, [0.5, -1.25, 3.0]), (2, []), (3, None)], "id long, embedding array<float>")
    encoded = blobs.encode_vectors(frame)
    broken = encoded.withColumn("blob", F.when(F.col("id") == 2, F.lit(b"abc")).otherwise(F.col("blob")))
    good, bad = blobs.decode_vectors(broken)
    assert [(r["id"], r["embedding"]) for r in good.collect()] == [(1, [0.5, -1.25, 3.0])]
    assert sorted(r["id"] for r in bad.collect()) == [2, 3]


def test_content_hash_is_of_the_float32_bytes(spark):
    import hashlib

    frame = spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0]), (3, [0.5])], "id long, embedding array<float>")
    got = [r[0] for r in frame.select(keys.content_hash("embedding")).collect()]
    want = ["similarity:" + hashlib.sha256(np.array(v, np.float32).tobytes()).hexdigest()[:16] for v in ([0.5, 2.0], [0.5, 2.0], [0.5])]
    assert got == want


def test_metadata_round_trip(spark):
    frame = spark.createDataFrame([(1, 'a "q"\n', None, [1, 2]), (2, None, 5, None)], "id long, name string, n int, l array<int>")
    encoded = store.metadata_json(frame, ["name", "n", "l"]).drop("name", "n", "l")
    back = store.metadata_from_json(encoded, {"name": "string", "n": "int", "l": "array<int>"}, {"n": F.lit(9)})
    assert [(r["name"], r["n"], r["l"]) for r in back.orderBy("id").collect()] == [('a "q"\n', 9, [1, 2]), (None, 5, None)]


def test_versions_do_not_touch_each_other(spark, tmp_path):
    base = str(tmp_path)
    frame = _entries(spark, [(i, [1.0], "2024-01-01", None) for i in range(100)]).withColumn("shard", F.lit(0))
    first = storefiles.write_store(frame, base, 1)
    storefiles.write_store(frame.limit(3).withColumn("shard", F.lit(1)), base, 2)
    assert storefiles.read_store(spark, first).count() == 100
    assert storefiles.read_store(spark, f"{base}/version=2", [0]).count() == 0


def test_empty_index_is_degraded(spark):
    frame = _entries(spark, [(1, [1.0], "2024-01-01", None)])
    requests = spark.createDataFrame([], "cache_hit boolean")
    row = store.index_stats(frame.limit(0), requests).first()
    assert (row["status"], row["hit_ratio"], row["index_size_bytes"]) == ("degraded", 0.0, 0)


def test_scaling(spark):
    frame = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r) for r in predict.scale_features(frame, ["a", "b"]).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]
    assert predict.scale_features(frame.limit(1), ["a"]).first()["a"] == 1.0


def test_soft_labels_and_model_store(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, c, float(rng.random()), c / 40.0, 1.0, 64, i % 4, min(c / 40.0, 1.0))
            for i, c in enumerate(rng.integers(1, 40, 300).tolist())]
    usage = spark.createDataFrame(
        rows, "embedding_id long, access_count long, hours_since_access double, access_frequency double, vector_norm double, "
              "dimension int, similarity_group int, label double")
    assert models.model_info(spark, str(tmp_path / "none"))[0] == "no_model"
    model, held_out = predict.fit_precompute_classifier(usage)
    assert 30 < held_out.count() < 90
    scored = predict.predict_precompute(model, held_out)
    chances = predict.model_evaluation(scored, "label", "access_probability", True).first()
    assert chances["mae"] < 0.1 and chances["log_loss"] < 0.7
    training = spark.createDataFrame([(300,)], "training_patterns long")
    with pytest.raises(ValueError):
        models.save_model(model, training.union(training), str(tmp_path / "two"))
    models.save_model(model, training, str(tmp_path / "m"))
    status, info = models.model_info(spark, str(tmp_path / "m"))
    assert status == "ready" and info.first()[0] == 300
    copy = predict.predict_precompute(models.load_model(spark, str(tmp_path / "m")), held_out)
    assert scored.orderBy("embedding_id").collect() == copy.orderBy("embedding_id").collect()
    training.write.parquet(str(tmp_path / "broken" / "training"))
    assert models.model_info(spark, str(tmp_path / "broken"))[0] == "error"


def test_needs(spark):
    stats = spark.createDataFrame([(1, 20), (2, 6), (3, 2)], "embedding_id long, access_count long")
    scores = spark.createDataFrame([(1, 0.8), (2, 0.6), (3, 0.9)], "embedding_id long, prediction double")
    wanted = spark.createDataFrame([(1,), (2,), (3,), (3,), (9,)], "embedding_id long")
    got = predict.ranked_predictions(predict.predict_access_needs(wanted, stats, scores)).collect()
    assert [(r["embedding_id"], r["confidence"], r["should_precompute"]) for r in got] == [(1, 1.0, True), (2, 0.6, False), (3, 0.2, False)]
    assert got[0]["priority_score"] == pytest.approx(0.8 * np.log1p(20))


def test_upsert_moves_only_written_keys(spark):
    """Stored rows of other ids pass without an exchange, and an older write loses."""
    made = "embedding_id long, embedding array<float>, created_at timestamp, access_count int"
    rows = [(i, [1.0, float(i)], i) for i in range(200)]
    stored = spark.createDataFrame(rows, "embedding_id long, embedding array<float>, at long").select(
        "embedding_id", "embedding", F.timestamp_seconds("at").alias("created_at"), F.lit(7).alias("access_count"))
    writes = spark.createDataFrame([(3, [9.0, 9.0], 500, 1), (3, [8.0, 8.0], 400, 2), (5, [9.0, 9.0], 1, 3), (900, [9.0, 9.0], 1, 4),
                                    (6, [9.0], 900, 5), (None, [9.0, 9.0], 900, 6), (7, [9.0, 9.0], 7, 7)],
                                   "embedding_id long, embedding array<float>, at long, write_id long").select(
        "embedding_id", "embedding", F.timestamp_seconds("at").alias("created_at"), "write_id")
    after = store.upsert_store(stored, writes, 2)
    assert after.schema.simpleString() == spark.createDataFrame([], made).schema.simpleString()
    got = {r["embedding_id"]: (r["embedding"], r["access_count"]) for r in after.collect()}
    assert len(got) == 201 and got[3] == ([9.0, 9.0], 1) and got[5] == ([1.0, 5.0], 7) and got[900] == ([9.0, 9.0], 1)
    assert got[6] == ([1.0, 6.0], 7) and got[7] == ([9.0, 9.0], 1)
    plan = after._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "SortMergeJoin" not in plan


def test_bulk_store_keeps_one_row_per_key(spark):
    cached = spark.createDataFrame([("old", 1, [0.0] * 2, 0)], "key string, doc_id long, embedding array<float>, access_count int").withColumn(
        "created_at", F.timestamp_seconds(F.lit(0)))
    entries = spark.createDataFrame([(1, "a", "m", [1.0, 1.0]), (2, "a", "m", [2.0, 2.0]), (3, "b", "m", [1.0])],
                                    "doc_id long, text string, model_version string, embedding array<float>")
    outcome = store.bulk_store(entries, 2, F.timestamp_seconds(F.lit(10)))
    after, stored = store.store_bulk(cached, outcome, "doc_id")
    assert sorted((r["doc_id"], r["embedding"]) for r in after.collect()) == [(1, [0.0, 0.0]), (2, [2.0, 2.0])]
    assert stored.first()["stored"] == 2
