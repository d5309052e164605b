"""Blocked windows and order statistics against brute force, with one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vectide.operators import access, groups, metrics, ttl


@pytest.fixture(scope="module")
def log(spark):
    """4,000 accesses of 40 keys; key 0 has more than a third, in bursts and with equal timestamps."""
    rng = np.random.default_rng(5)
    n = 4000
    keys = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 40, n))
    seconds = np.sort(np.where(rng.random(n) < 0.3, rng.integers(0, 900, n), rng.integers(0, 50_000, n)))
    scores = np.where(rng.random(n) < 0.2, np.nan, rng.random(n).round(3))
    pdf = pd.DataFrame({
        "event_id": np.arange(n), "embedding_id": keys, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(seconds, "s"),
        "latency_ms": rng.exponential(50, n).round(2), "similarity_score": scores, "user_id": keys % 3,
        "vector_size": 64, "cluster_id": keys % 5}).sample(frac=1, random_state=1)
    frame = spark.createDataFrame(pdf).repartition(7)
    frame = frame.withColumn("similarity_score", F.when(~F.isnan("similarity_score"), F.col("similarity_score")))
    return frame, pdf.sort_values(["ts", "event_id"]).reset_index(drop=True)


def _by_event(df):
    return df.toPandas().sort_values("event_id").reset_index(drop=True)


def test_access_patterns(log):
    frame, pdf = log
    got = _by_event(access.access_patterns(frame, block_seconds=600))
    grouped = pdf.groupby("embedding_id")
    pdf = pdf.assign(n=grouped.cumcount() + 1, gap=grouped["ts"].diff().dt.total_seconds().fillna(0.0)).sort_values("event_id")
    assert got["access_frequency"].tolist() == pdf["n"].tolist()
    assert np.allclose(got["time_since_last_access"], pdf["gap"])


def test_running_avg_interval(log):
    frame, pdf = log
    got = _by_event(access.running_avg_interval(frame, block_seconds=600))
    gaps = pdf.groupby("embedding_id")["ts"].diff().dt.total_seconds()
    mean = gaps.groupby(pdf["embedding_id"]).expanding().mean().reset_index(0, drop=True)
    want = pdf.assign(mean=mean).sort_values("event_id")["mean"]
    assert np.allclose(got["average_interval"].astype(float), want, equal_nan=True)


@pytest.mark.parametrize("block_rows", [100, 250, 100_000])
def test_trailing_mean(log, block_rows):
    frame, pdf = log
    scored = frame.filter(F.col("similarity_score").isNotNull())
    rows = groups.with_previous(scored, "embedding_id", "ts", "event_id", ["ts"], 600)
    got = _by_event(groups.trailing_mean(rows, "embedding_id", "position", "similarity_score", 100, "m", block_rows))
    kept = pdf.dropna(subset=["similarity_score"])
    mean = kept.groupby("embedding_id")["similarity_score"].rolling(100, min_periods=1).mean().reset_index(0, drop=True)
    want = kept.assign(mean=mean).sort_values("event_id")["mean"]
    assert np.allclose(got["m"].astype(float), want)


@pytest.mark.parametrize("gap, block", [(5, 60), (40, 7), (900, 60), (900, 100_000)])
def test_session_steps(log, gap, block):
    from vectide.operators.sessions import session_steps

    frame, pdf = log
    got = _by_event(session_steps(frame, gap, block_seconds=block))
    users = pdf.groupby("user_id")
    new = users["ts"].diff().dt.total_seconds().isna() | (users["ts"].diff().dt.total_seconds() > gap)
    start = pdf["ts"].where(new).groupby(pdf["user_id"]).ffill()
    before = users["embedding_id"].shift().where(~new)
    want = pdf.assign(start=start, before=before).sort_values("event_id")
    assert got["session_start"].tolist() == want["start"].tolist()
    assert got["previous_key"].fillna(-1).tolist() == want["before"].fillna(-1).tolist()


@pytest.mark.parametrize("spread", [1, 8])
def test_top_per_group(log, spread):
    frame, pdf = log
    got = groups.top_per_group(frame, ["embedding_id"], [F.col("latency_ms").desc(), F.col("event_id")], 3, spread=spread)
    want = pdf.sort_values(["latency_ms", "event_id"], ascending=[False, True]).groupby("embedding_id").head(3)
    assert sorted(r["event_id"] for r in got.collect()) == sorted(want["event_id"])


@pytest.mark.parametrize("n", [1, 10, 777, 10_000])
def test_newest(log, n):
    frame, pdf = log
    got = {r["event_id"] for r in groups.newest(frame, "ts", "event_id", n, 600).collect()}
    assert got == set(pdf["event_id"].tail(n))


@pytest.mark.parametrize("list_rows", [0, 3, 100_000])
def test_order_statistics(log, list_rows):
    frame, pdf = log
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p99": 0.99, "p100": 1.0}
    got = groups.order_statistics(frame, "latency_ms", shares, ["embedding_id"], list_rows=list_rows)
    for row in got.collect():
        values = np.sort(pdf[pdf["embedding_id"] == row["embedding_id"]]["latency_ms"])
        for name, share in shares.items():
            assert row[name] == values[min(int(share * len(values)), len(values) - 1)], (row["embedding_id"], name)


def test_order_statistics_of_one_repeated_value(spark):
    frame = spark.range(1000).select(F.lit(0).alias("g"), F.when(F.col("id") < 990, 7.0).otherwise(9.0).alias("v"))
    for list_rows in (0, 100, 10_000):
        assert groups.order_statistics(frame, "v", {"a": 0.95, "b": 0.99}, ["g"], list_rows=list_rows).first()[1:] == (7.0, 9.0)


def test_order_statistics_of_all_kinds_of_numbers(spark):
    """Signs, zeros, infinities, subnormal and close values, in one group of all rows and in groups with null."""
    rnd = np.random.default_rng(1)
    values = np.concatenate([rnd.standard_normal(500) * 10.0 ** rnd.integers(-300, 300, 500), [0.0, -0.0, np.inf, -np.inf, 5e-324],
                             1.0 + np.arange(300) * 2.0 ** -52, np.full(400, -3.5)]).tolist() + [None, float("nan")]
    frame = spark.createDataFrame([(i % 2 or None, v) for i, v in enumerate(values)], "g int, v double")
    shares = {f"p{i}": i / 20 for i in range(21)}

    def want(part):
        part = sorted(v for v in part if v is not None and v == v)
        return [part[min(int(s * len(part)), len(part) - 1)] for s in shares.values()]

    for list_rows in (0, 50, 10_000):
        got = groups.order_statistics(frame, "v", shares, [], list_rows=list_rows, extra=[F.count("*").alias("n")]).collect()
        assert list(got[0])[:-1] == want(values) and got[0]["n"] == len(values) - 2 and len(got) == 1
        got = {r["g"]: list(r)[1:] for r in groups.order_statistics(frame, "v", shares, ["g"], list_rows=list_rows).collect()}
        assert got == {g: want(values[1 - (g is None)::2]) for g in (1, None)}
    empty = groups.order_statistics(frame.limit(0), "v", {"a": 0.5}, [])
    assert empty.collect()[0]["a"] is None and groups.order_statistics(frame.limit(0), "v", {"a": 0.5}, ["g"]).count() == 0


def _hits(pdf, ttl_seconds):
    labels = {}
    for _, rows in pdf.groupby("embedding_id"):
        load = None
        for event, ts in zip(rows["event_id"], rows["ts"]):
            hit = load is not None and (ts - load).total_seconds() <= ttl_seconds
            labels[event] = hit
            load = load if hit else ts
    return labels


@pytest.mark.parametrize("ttl_seconds", [120, 3600])
@pytest.mark.parametrize("rows, kept, spans", [(10_000, 1, 1), (100, 6, 1000), (100, 30, 800)])
def test_ttl_hits(log, ttl_seconds, rows, kept, spans):
    frame, pdf = log
    got = ttl.ttl_hits(frame.select("event_id", "embedding_id", "ts"), ttl_seconds=ttl_seconds, rows_per_key=rows,
                       kept_per_span=kept, max_spans=spans)
    assert {r["event_id"]: r["cache_hit"] for r in got.collect()} == _hits(pdf, ttl_seconds)


def test_ttl_hits_a_few_spans_at_a_time(log):
    frame, pdf = log
    got = ttl.ttl_hits(frame.select("event_id", "embedding_id", "ts"), rows_per_key=100, kept_per_span=20, max_spans=4)
    assert {r["event_id"]: r["cache_hit"] for r in got.collect()} == _hits(pdf, 3600)


def test_ttl_hits_over_long_gaps(spark):
    seconds = [0, 10, 20, 50_000, 50_005, 900_000, 900_050, 900_070]
    pdf = pd.DataFrame({"event_id": range(8), "embedding_id": 1, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(seconds, "s")})
    got = ttl.ttl_hits(spark.createDataFrame(pdf), ttl_seconds=60, rows_per_key=3, kept_per_span=2, max_spans=2)
    assert {r["event_id"]: r["cache_hit"] for r in got.collect()} == _hits(pdf, 60)


def test_ttl_boundary(spark):
    rows = [(0, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 01:00:00"), (2, "a", "2024-01-01 01:00:00.000001")]
    frame = spark.createDataFrame(rows, "event_id long, embedding_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["event_id"]: r["cache_hit"] for r in ttl.ttl_hits(frame).collect()}
    assert got == {0: False, 1: True, 2: False}


def test_golden_hits(spark):
    from vectide.plans import views

    assert views.request_log(spark, "/root/testdata/sf0.01").filter("cache_hit").count() == 1213


def test_key_access_stats(log):
    frame, pdf = log
    for row in access.key_access_stats(frame).collect():
        rows = pdf[pdf["embedding_id"] == row["embedding_id"]]
        assert row["access_count"] == len(rows)
        assert row["average_interval"] == pytest.approx(rows["ts"].diff().dt.total_seconds().mean())
        assert row["avg_similarity"] == pytest.approx(rows["similarity_score"].dropna().tail(100).mean())


def test_one_access_per_key(spark):
    frame = spark.createDataFrame([(1, 5, None)], "event_id long, embedding_id long, similarity_score double").withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp"))
    row = access.key_access_stats(frame).first()
    assert (row["access_count"], row["average_interval"], row["avg_similarity"]) == (1, None, 0.0)
    assert access.running_avg_interval(frame).first()["average_interval"] is None
    assert access.access_patterns(frame).first()["time_since_last_access"] == 0.0


REQUESTS = "success boolean, latency_ms double, cache_hit boolean"


def test_load_metrics_of_four_requests(spark):
    rows = [(True, 10.0, True), (True, 20.0, False), (False, 15.0, False), (True, 5.0, True)]
    got = metrics.load_metrics(spark.createDataFrame(rows, REQUESTS), 2.0).first().asDict()
    assert got == {
        "total_requests": 4, "successful_requests": 3, "failed_requests": 1, "avg_latency_ms": 12.5,
        "p95_latency_ms": 20.0, "p99_latency_ms": 20.0, "max_latency_ms": 20.0, "requests_per_second": 2.0,
        "cache_hit_rate": 0.5, "error_rate": 0.25, "duration_seconds": 2.0}


def test_load_metrics_of_nothing(spark):
    got = metrics.load_metrics(spark.createDataFrame([], REQUESTS), 3.0).first().asDict()
    assert got.pop("duration_seconds") == 3.0
    assert set(got.values()) == {0}


def test_hits_are_faster(spark):
    rows = [(True, 1.0, True)] * 3 + [(True, 6.0, False)] * 2
    got = metrics.hit_miss_speedup(spark.createDataFrame(rows, REQUESTS)).first()
    assert (got["avg_hit_ms"], got["p95_miss_ms"], got["speedup"]) == (1.0, 6.0, 6.0)


def test_alert_needs_neighbouring_windows(spark):
    rows = [(m, 0.9) for m in (0, 1, 2, 3, 4, 7, 8)] + [(5, 0.1)]
    samples = spark.createDataFrame(rows, "m int, v double").select(
        F.lit("a").alias("node"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("m"))).alias("ts"), "v")
    got = metrics.alert_breaches(samples, "node", "v", 0.8, 60, 5).collect()
    assert [(r["windows"], str(r["breach_end"])) for r in got] == [(5, "2024-01-01 00:05:00")]


def test_exposition_text(spark):
    rows = spark.createDataFrame([("a,b", 'q"\\'), ("a,b", 'q"\\'), ("c", None)], "operation string, status string")
    counted = metrics.label_counters(rows, {"ops": (["operation", "status"], None), "up": ([], F.col("operation") == "c")})
    lines = sorted(r["line"] for r in metrics.export_metrics_text(metrics.counter_samples(counted)).collect())
    assert lines == ['ops{operation="a,b",status="q\\"\\\\"} 2', 'ops{operation="c",status=""} 1', "up 1"]


def test_histogram_lines(spark):
    rows = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("a", 0.7), ("a", None)], "op string, v double")
    samples = metrics.histogram_samples(metrics.histogram(rows, "v", [0.1, 0.5], ["op"]), "t", ["op"])
    assert sorted(r["line"] for r in metrics.export_metrics_text(samples).collect()) == [
        't_bucket{op="a",le="+Inf"} 3', 't_bucket{op="a",le="0.1"} 1', 't_bucket{op="a",le="0.5"} 2',
        't_count{op="a"} 3', 't_sum{op="a"} 1.000000']


def test_pattern_similarity_without_clusters(spark):
    rows = [(1, 64, 10, None), (2, 64, 5, None), (3, 64, 1, 2)]
    latest = spark.createDataFrame(rows, "embedding_id long, vector_size int, access_frequency long, cluster_id int")
    got = {r["embedding_id"]: r["similarity"] for r in access.pattern_similarity(latest, [1]).collect()}
    assert got == {2: 0.75, 3: 0.55}


@pytest.mark.parametrize("n", [1, 2, 5, 7])
@pytest.mark.parametrize("block_rows", [1, 10, 1000])
def test_trailing_mean_of_any_length(spark, n, block_rows):
    values = [1.0, None, float("inf"), 2.0, float("nan"), 1e17, 3.0, -5.0, None, None, None, 7.0, 1e-3, 4.0, 0.5] * 3
    df = spark.createDataFrame([("k", i + 1, v) for i, v in enumerate(values)] + [(None, 1, 9.0)], "k string, position long, v double")
    got = {(r["k"], r["position"]): r["m"] for r in groups.trailing_mean(df, "k", "position", "v", n, "m", block_rows).collect()}
    assert got.pop((None, 1)) == 9.0
    for i in range(len(values)):
        frame = [v for v in values[max(0, i - n + 1):i + 1] if v is not None and v == v]
        want = sum(frame) / len(frame) if frame else None
        assert got["k", i + 1] == (want if want is None else pytest.approx(want))


def test_history_written_twice_is_one_set_of_rows(spark, tmp_path):
    from vectide.operators import metrics

    rows = [(i, f"2024-01-0{1 + i % 3} {i % 24:02d}:00:0{i % 9}", i % 700, i % 3 > 0, i % 5 > 0, 64, 700.0 if i % 50 else 7_300_000.0) for i in range(6000)]
    log = spark.createDataFrame(rows, "event_id long, t string, embedding_id long, cache_hit boolean, success boolean, vector_size int, latency_ms double").withColumn(
        "ts", F.to_timestamp("t")).withColumn("similarity_score", F.lit(0.5))
    hours, path = metrics.mergeable_snapshot(log, 3600), str(tmp_path / "h")
    for part in (hours.filter("hour(window_start) < 13"), hours.filter("hour(window_start) >= 13"), hours, hours.limit(0)):
        metrics.append_history(part, path)
    stored = spark.read.parquet(path)
    assert stored.count() == hours.count() == 24
    days = {r["window_start"]: r for r in metrics.read_snapshot(metrics.roll_up(stored, 86400)).collect()}
    exact = {r["window_start"]: r["n"] for r in log.groupBy(F.window("ts", "1 day")["start"].alias("window_start")).agg(F.countDistinct("embedding_id").alias("n")).collect()}
    assert days.keys() == exact.keys()
    assert all(abs(days[d]["total_embeddings"] - n) <= 0.02 * n for d, n in exact.items())
    # a miss of more than two hours waits at the end of two or three windows, the others end in their own
    exact_queue = {r["window_start"]: r["queue_size"] for r in metrics.metric_snapshot(log, 3600).collect()}
    assert exact_queue == {r["window_start"]: r["queue_size"] for r in stored.collect()} and max(exact_queue.values()) > 0
    now = F.to_timestamp(F.lit("2024-01-03 00:00:00"))
    assert metrics.read_history(spark, path, now, 1).filter("window_start <= timestamp'2024-01-02 00:00:00'").count() == 0


def _walks(spark, seed, users, steps):
    """Sessions in which the next key depends on the two before, with some noise; a break of a day now and then."""
    rnd, rows, event = np.random.default_rng(seed), [], 0
    for user in range(users):
        a, b, t = 0, 1, 0
        for _ in range(steps):
            a, b = b, int((3 * a + 5 * b + 1) % 11) if rnd.random() < 0.8 else int(rnd.integers(0, 11))
            t += 86_400 * 3 if rnd.random() < 0.05 else 60
            rows.append((event, user, t, b))
            event += 1
    return spark.createDataFrame(rows, "event_id long, user_id long, t long, embedding_id long").withColumn("ts", F.timestamp_seconds("t")).drop("t")


def test_backoff_is_not_below_pairs_on_held_out_sessions(spark):
    from vectide.operators import sessions

    steps = sessions.context_steps(_walks(spark, 1, 30, 100), 3600, 3)
    held = sessions.context_steps(_walks(spark, 2, 10, 100), 3600, 3).cache()
    hits = {}
    for n in (1, 3):
        model = sessions.backoff_model(steps, n, top=1, least=3)
        found = sessions.predict_next(held, model, n, ["event_id"])
        hits[n] = found.join(held, "event_id").filter("next_key = embedding_id").count()
    assert hits[3] >= hits[1] and hits[3] > 0.5 * held.filter("size(context) > 0").count()
    # contexts end where a session begins
    rows = sorted(held.select("user_id", "ts", "event_id", "embedding_id", "context").collect(), key=lambda r: (r["user_id"], r["ts"], r["event_id"]))
    for i, r in enumerate(rows):
        want = []
        for j in range(i - 1, max(-1, i - 4), -1):
            if rows[j]["user_id"] != r["user_id"] or (rows[j + 1]["ts"] - rows[j]["ts"]).total_seconds() > 3600:
                break
            want.append(rows[j]["embedding_id"])
        assert list(r["context"]) == want
    held.unpersist()


def test_backoff_of_rare_and_unknown_contexts(spark):
    from vectide.operators import sessions

    steps = spark.createDataFrame([([1, 2], 5), ([1, 3], 6), ([1, 2], 5), ([9], 7), ([], 8)], "context array<long>, embedding_id long")
    model = sessions.backoff_model(steps, 2, top=2)
    got = {(tuple(r["context"]), r["next_key"]): (r["follows"], r["total"], r["share"]) for r in model.collect()}
    assert got == {((1,), 5): (2, 3, 0.5), ((1,), 6): (1, 3, 0.5 / 3), ((1, 2), 5): (2, 2, 0.75), ((9,), 7): (1, 1, 0.5)}
    asked = spark.createDataFrame([("a", [1, 2, 4]), ("b", [1, 3]), ("c", [4, 1]), ("d", [])], "id string, context array<long>")
    found = {(r["id"], r["context_length"], r["next_key"], r["rank"]) for r in sessions.predict_next(asked, model, 2, ["id"]).collect()}
    assert found == {("a", 2, 5, 1), ("b", 1, 5, 1), ("b", 1, 6, 2)}


def test_families_come_with_help_and_type_first(spark):
    from vectide.operators import metrics

    rows = spark.createDataFrame([("a", 0.2), ("b", 0.7)], "op string, v double")
    samples = metrics.histogram_samples(metrics.histogram(rows, "v", [0.5], ["op"]), metrics.LATENCY, ["op"]).unionByName(
        metrics.labelled_gauges(rows, metrics.MEMORY, ["op"], "v")).unionByName(
        metrics.labelled_gauges(rows.limit(1), "unknown_family", [], "v"))
    lines = [r["line"] for r in metrics.export_metrics_text(samples, metrics.FAMILIES).collect()]
    for name, kind in ((metrics.LATENCY, "histogram"), (metrics.MEMORY, "gauge")):
        at = lines.index(f"# HELP {name} {metrics.FAMILIES[name][1]}")
        assert lines[at + 1] == f"# TYPE {name} {kind}" and all(x.startswith(name) for x in lines[at + 2:at + 4])
    assert "unknown_family 0.200000" in lines and not any(x.startswith("#") and metrics.QUEUE in x for x in lines)
    assert len(lines) == 2 * 2 + 2 * 4 + 2 + 1
