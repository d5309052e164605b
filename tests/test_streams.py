"""Streams in several micro-batches against their batch twins."""

import pytest
from pyspark.sql import functions as F

from vectide.operators import access
from vectide.plans import views
from vectide.sources import commitlog
from vectide.streaming import jobs

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def log_files(spark, tmp_path_factory):
    """The access log as five files in time order, one micro-batch each."""
    base = str(tmp_path_factory.mktemp("log"))
    log = views.access_log(spark, FOLDER)
    for i in range(5):
        log.filter(F.floor(F.col("event_id") / 200) == i).coalesce(1).write.mode("append").parquet(base)
    return base, log


def _stream(spark, log_files):
    base, log = log_files
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(base)


def _rows(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@pytest.mark.parametrize("parts", [1, 4])
def test_access_stats_over_batches(spark, log_files, tmp_path, rocksdb, parts):
    base = str(tmp_path)
    jobs.stream_access_stats(_stream(spark, log_files), f"{base}/o", f"{base}/c", parts=parts).awaitTermination()
    assert _rows(jobs.access_stats_after(spark, f"{base}/o")) == _rows(access.key_access_stats(log_files[1]))


def _unordered_stream(spark, base):
    """Three micro-batches of (key, minute, event) with accesses that come a batch late."""
    schema = "embedding_id long, ts timestamp, event_id long, similarity_score double"
    parts = [[(1, 30, 1), (1, 10, 2), (2, 20, 3)], [(1, 20, 4), (2, 5, 5), (1, 60, 6), (None, 40, 7)],
             [(1, 50, 8), (None, 30, 9), (2, 300, 10)]]
    log = None
    for part in parts:
        rows = spark.createDataFrame(part, "embedding_id long, minute long, event_id long").select(
            "embedding_id", F.timestamp_seconds(1704067200 + F.col("minute") * 60).alias("ts"), "event_id",
            F.when(F.col("event_id") % 3 != 0, F.col("event_id") / 10.0).alias("similarity_score"))
        rows.coalesce(1).write.mode("append").parquet(f"{base}/in")
        log = rows if log is None else log.unionByName(rows)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in"), log


def test_unordered_accesses_give_the_stats_of_the_batch(spark, tmp_path, rocksdb):
    base = str(tmp_path)
    stream, log = _unordered_stream(spark, base)
    jobs.stream_access_stats(stream, f"{base}/o", f"{base}/c", scores=2).awaitTermination()
    got = jobs.access_stats_after(spark, f"{base}/o", 2).filter("embedding_id IS NOT NULL")
    assert _rows(got) == _rows(access.key_access_stats(log.filter("embedding_id IS NOT NULL"), 2))
    assert jobs.access_stats_after(spark, f"{base}/o", 2).filter("embedding_id IS NULL").first()["access_count"] == 2


def test_late_accesses_are_numbered_in_their_place(spark, tmp_path, rocksdb):
    base = str(tmp_path)
    stream, log = _unordered_stream(spark, base)
    jobs.stream_access_patterns(stream, f"{base}/o", f"{base}/c").awaitTermination()
    columns = ["event_id", "embedding_id", "access_frequency", "time_since_last_access"]
    want = access.access_patterns(log).filter("event_id <> 10").select(columns)
    got = spark.read.parquet(f"{base}/o").select(columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_patterns_over_batches_are_those_of_the_batch(spark, log_files, tmp_path, rocksdb):
    base = str(tmp_path)
    jobs.stream_access_patterns(_stream(spark, log_files), f"{base}/o", f"{base}/c").awaitTermination()
    columns = ["event_id", "embedding_id", "access_frequency", "time_since_last_access"]
    last = log_files[1].agg(F.max("ts")).first()[0]
    want = access.access_patterns(log_files[1]).filter(F.col("ts") + F.expr("INTERVAL 1 HOUR") <= F.lit(last)).select(columns)
    assert _rows(spark.read.parquet(f"{base}/o").select(columns)) == _rows(want)


def test_upsert_over_batches(spark, log_files, tmp_path):
    from vectide.operators.store import upsert_store

    base = str(tmp_path)
    store = views.store(spark, FOLDER)
    log = commitlog.StoreLog(spark, f"{base}/d", tie="write_id")
    log.write(store.withColumn("shard", F.col("embedding_id") % 5))
    writes = views.writes_of(_stream(spark, log_files), views.embeddings(spark, FOLDER))
    place = lambda rows: rows.withColumn("shard", F.col("embedding_id") % 5)
    jobs.stream_upsert(writes, log, place, f"{base}/c", views.DIM, fold_after=2).awaitTermination()
    want = upsert_store(store, views.incoming(spark, FOLDER), views.DIM)
    columns = ["embedding_id", "model_name", "created_at", "ttl_seconds"]
    assert log.state().version > 2 and len(log.state().deltas) < 2
    assert sorted(map(str, log.read().select(columns).collect())) == sorted(map(str, want.select(columns).collect()))


def test_lookup_with_fallback_over_batches(spark, log_files, tmp_path):
    from vectide.operators.lookup import lookup_with_fallback

    base = str(tmp_path)
    store = views.live_store(spark, FOLDER)
    vectors = views.embeddings(spark, FOLDER).select(F.col("vec_id").alias("embedding_id"), "embedding")
    requests = _stream(spark, log_files).select("event_id", "embedding_id")
    jobs.stream_lookup(requests, store, f"{base}/o", f"{base}/c", vectors, 0.28).awaitTermination()
    want = lookup_with_fallback(log_files[1].select("event_id", "embedding_id"), store, vectors, 0.28)
    got = jobs.read_batches(spark, f"{base}/o").drop("batch").select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_hit_rate_closes_windows(spark, log_files, tmp_path):
    base = str(tmp_path)
    requests = _stream(spark, log_files).select("ts", F.col("success").alias("cache_hit"))
    jobs.stream_hit_rate(requests, f"{base}/o", f"{base}/c", seconds=3600).awaitTermination()
    from vectide.operators.metrics import hit_rate_window

    whole = hit_rate_window(log_files[1].withColumn("cache_hit", F.col("success")), 3600)
    last = log_files[1].agg(F.max("ts")).first()[0]
    closed = whole.filter(F.col("window_start") + F.expr("INTERVAL 2 HOURS") <= F.lit(last))
    got = spark.read.parquet(f"{base}/o").select("window_start", "hits", "requests", "hit_rate")
    assert sorted(map(str, got.collect())) == sorted(map(str, closed.collect()))


def test_entry_lives_on_when_written_again(spark, tmp_path):
    base = str(tmp_path)
    rows = [[(1, "2024-01-01 00:00:00", 60), (2, "2024-01-01 00:00:00", None)], [(1, "2024-01-01 00:00:50", 60), (3, "2024-01-01 00:00:55", 10)],
            [(4, "2024-01-01 00:01:30", 600)], [(5, "2024-01-01 00:03:00", 600)]]
    schema = "embedding_id long, created_at timestamp, ttl_seconds int"
    for part in rows:
        spark.createDataFrame(part, "embedding_id long, at string, ttl_seconds int").select(
            "embedding_id", F.col("at").cast("timestamp").alias("created_at"), "ttl_seconds").coalesce(1).write.mode("append").parquet(f"{base}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        jobs.stream_ttl_store(stream, f"{base}/out", f"{base}/c", late_seconds=0).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r["embedding_id"], r["expired_ms"]) for r in spark.read.parquet(f"{base}/out").collect())
    start = 1704067200000
    assert got == [(1, start + 110_001), (3, start + 65_001)]


def test_refresh_builds_what_is_stale(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(len(built)).toDF("n")

    path = f"{tmp_path}/table"
    assert [jobs.refresh_if_stale(spark, path, now, 300, build).count() for now in (1000, 1300, 1301, 1400)] == [1, 1, 2, 2]


def test_late_write_is_stored(spark, tmp_path):
    base = str(tmp_path)
    for row in [(1, "2024-01-01 00:00:00", 60), (9, "2024-01-01 00:20:00", 60), (2, "2024-01-01 00:09:59", 60),
                (3, "2024-01-01 03:00:00", None)]:
        spark.createDataFrame([row], "embedding_id long, at string, ttl_seconds int").select(
            "embedding_id", F.col("at").cast("timestamp").alias("created_at"), "ttl_seconds").coalesce(1).write.mode("append").parquet(f"{base}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.ROCKSDB)
    try:
        stream = spark.readStream.schema("embedding_id long, created_at timestamp, ttl_seconds int").option(
            "maxFilesPerTrigger", 1).parquet(f"{base}/in")
        jobs.stream_ttl_store(stream, f"{base}/out", f"{base}/c").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(r["embedding_id"] for r in spark.read.parquet(f"{base}/out").collect()) == [1, 2, 9]


def test_bad_vectors_are_not_routed(spark, tmp_path):
    import numpy as np

    base = str(tmp_path)
    spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [0.0, 2.0]), (5, [1.0, 2.0, 3.0])],
                          "embedding_id long, embedding array<float>").coalesce(1).write.parquet(f"{base}/in")
    stream = spark.readStream.schema("embedding_id long, embedding array<float>").parquet(f"{base}/in")
    jobs.stream_route(stream, [10, 20], np.eye(2), f"{base}/out", f"{base}/c").awaitTermination()
    assert sorted((r[0], r[1]) for r in spark.read.parquet(f"{base}/out").collect()) == [(1, 10), (4, 20)]


def test_lookup_reads_the_store_for_each_batch(spark, tmp_path):
    base, reads = str(tmp_path), []
    for n in (1, 2):
        spark.createDataFrame([(n, 5)], "event_id long, embedding_id long").coalesce(1).write.mode("append").parquet(f"{base}/in")

    def store(session):
        reads.append(1)
        return session.createDataFrame([(5, "m")] if len(reads) > 1 else [], "embedding_id long, model_name string")

    stream = spark.readStream.schema("event_id long, embedding_id long").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    jobs.stream_lookup(stream, store, f"{base}/out", f"{base}/c").awaitTermination()
    assert sorted(r["found"] for r in jobs.read_batches(spark, f"{base}/out").collect()) == [False, True]


@pytest.mark.parametrize("files", [1, 3])
def test_streamed_tables_may_be_folders(spark, tmp_path, files):
    """A table is one file or a folder of part files; the stream reads all its rows, and no other table's."""
    from vectide.plans.registry import QUERIES
    from vectide.plans import stream_queries  # noqa: F401  (registers the queries)

    vectors = spark.createDataFrame([(i, [1.0, float(i % 2)], i % 2) for i in range(60)], "vec_id long, embedding array<float>, label long")
    wide = vectors.withColumn("embedding", F.concat("embedding", F.array_repeat(F.lit(0.0).cast("float"), 62)))
    events = spark.createDataFrame([(i, "2024-01-01 00:00:00", i, "view", 1.0, '{"k": 1}') for i in range(60)],
                                   "event_id long, at string, user_id long, event_type string, value double, props string")
    events = events.withColumn("ts", F.col("at").cast("timestamp")).drop("at")
    for name, table in (("embeddings", wide), ("events", events)):
        table.repartition(files).write.parquet(f"{tmp_path}/{name}.parquet")
        table.repartition(files).write.parquet(f"{tmp_path}/{name}.parquet.old")
    routed = QUERIES["stream_route"](spark, str(tmp_path))
    assert _rows(routed) == [(i, i % 2) for i in range(60)]
    copied = views.event_stream(spark, str(tmp_path)).writeStream.format("parquet").option("path", f"{tmp_path}/o").option(
        "checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    copied.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/o").count() == 60
