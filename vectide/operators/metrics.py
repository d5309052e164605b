"""Metrics: totals, percentiles, histograms, counters, windows, alerts and their text form.

A request log has event_id, ts, latency_ms, success, cache_hit and label columns.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vectide.functions.numbers import ratio
from vectide.operators.groups import one_row, order_statistics
from vectide.session import cut_lineage

# Bucket bounds and periods of the metrics.
LATENCY_BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
SCORE_BOUNDS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
DEFAULT_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]
CACHE_OPERATIONS = "embedding_cache_operations_total"
EMBEDDING_OPERATIONS = "embedding_operations_total"
ERRORS = "system_errors_total"
REQUESTS = "grpc_requests_total"
SIMILARITY_REQUESTS = "similarity_router_requests_total"
HITS, MISSES, SEARCHES = "cache_hits_total", "cache_misses_total", "similarity_searches_total"
LATENCY = "embedding_cache_latency_seconds"
HIT_RATE = "embedding_cache_hit_rate"
SCORES = "embedding_similarity_scores"
HTTP_DURATION, GRPC_DURATION = "http_request_duration_seconds", "grpc_request_duration_seconds"
MEMORY, QUEUE = "redis_memory_usage_bytes", "embedding_precompute_queue_size"
# kind and description of each family
FAMILIES = {
    CACHE_OPERATIONS: ("counter", "Cache operations by kind and outcome"),
    EMBEDDING_OPERATIONS: ("counter", "Embedding operations by kind and model"),
    ERRORS: ("counter", "Errors by component and kind"),
    REQUESTS: ("counter", "Requests by method and outcome"),
    SIMILARITY_REQUESTS: ("counter", "Routed requests by cache status and method"),
    HITS: ("counter", "Cache hits"), MISSES: ("counter", "Cache misses"), SEARCHES: ("counter", "Similarity searches"),
    LATENCY: ("histogram", "Latency of cache operations"), SCORES: ("histogram", "Similarity scores"),
    HTTP_DURATION: ("histogram", "Duration of HTTP requests"), GRPC_DURATION: ("histogram", "Duration of remote calls"),
    HIT_RATE: ("gauge", "Share of hits"), MEMORY: ("gauge", "Bytes of vectors by node"), QUEUE: ("gauge", "Keys waiting to be computed"),
}
RETENTION_DAYS = 7
COLLECTION_SECONDS = 30


def cache_stats(requests: DataFrame) -> DataFrame:
    """Requests, hits, misses, hit rate and mean response time of lookups."""
    return requests.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if("cache_hit").alias("cache_hits"),
        F.count_if(~F.col("cache_hit")).alias("cache_misses"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_response_ms"),
    ).withColumn("hit_rate", ratio("cache_hits", "total_requests"))


def load_metrics(requests: DataFrame, duration_seconds: float, latencies: DataFrame | None = None) -> DataFrame:
    """Totals, latency mean, 95th and 99th percentile by index, maximum, throughput and rates.

    `latencies` may give latency_ms of the same requests from a cheaper plan than `requests`.

    The percentile is the value at 0-based index floor(p * n) of the sorted latencies. Empty input gives
    one row of zeros with the duration kept.
    """
    totals = requests.agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if("success").alias("successful_requests"),
        F.count_if(~F.col("success")).alias("failed_requests"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(F.max("latency_ms"), F.lit(0.0)).alias("max_latency_ms"),
        F.count_if("cache_hit").alias("_hits"),
    )
    ranked = order_statistics(
        requests if latencies is None else latencies, "latency_ms",
        {"p95_latency_ms": 0.95, "p99_latency_ms": 0.99}, [])
    return one_row(totals, ranked).select(
        "total_requests", "successful_requests", "failed_requests", "avg_latency_ms",
        F.coalesce("p95_latency_ms", F.lit(0.0)).alias("p95_latency_ms"),
        F.coalesce("p99_latency_ms", F.lit(0.0)).alias("p99_latency_ms"),
        "max_latency_ms",
        ratio("total_requests", F.lit(float(duration_seconds))).alias("requests_per_second"),
        ratio("_hits", "total_requests").alias("cache_hit_rate"),
        ratio("failed_requests", "total_requests").alias("error_rate"),
        F.lit(float(duration_seconds)).alias("duration_seconds"))


def hit_miss_speedup(requests: DataFrame) -> DataFrame:
    """Mean and 95th percentile latency of hits and of misses, and mean miss over mean hit."""
    sides = order_statistics(requests, "latency_ms", {"p95": 0.95}, ["cache_hit"],
                             [F.avg("latency_ms").alias("avg")])

    def side(hit: bool, name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("cache_hit") == hit, F.col(name))), F.lit(0.0))

    return sides.agg(
        side(True, "avg").alias("avg_hit_ms"), side(True, "p95").alias("p95_hit_ms"),
        side(False, "avg").alias("avg_miss_ms"), side(False, "p95").alias("p95_miss_ms"),
    ).withColumn("speedup", ratio("avg_miss_ms", "avg_hit_ms"))


def histogram(rows: DataFrame, value: str, bounds: list[float], by: list[str]) -> DataFrame:
    """Cumulative bucket counts (`le` as text, +Inf last) with the sum and count of each label set.

    All buckets come from one aggregate per label set; nothing is joined.
    """
    values = F.col(value)
    counted = rows.filter(values.isNotNull()).groupBy(*by).agg(
        *[F.count_if(values <= bound).alias(f"_b{i}") for i, bound in enumerate(bounds)],
        F.count(F.lit(1)).alias("total_count"), F.sum(values).alias("total_sum"))
    buckets = F.array(
        *[F.struct(F.lit(str(bound)).alias("le"), F.col(f"_b{i}").alias("n")) for i, bound in enumerate(bounds)],
        F.struct(F.lit("+Inf").alias("le"), F.col("total_count").alias("n")))
    return counted.withColumn("_bucket", F.explode(buckets)).select(
        *by, F.col("_bucket.le").alias("le"), F.col("_bucket.n").alias("bucket_count"), "total_sum", "total_count")


def label_text(names: list[str]) -> Column:
    """Labels as exposition text: name="value",... with backslash, quote and line end escaped."""
    def escaped(name: str) -> Column:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")):
            text = F.replace(text, F.lit(raw), F.lit(safe))
        return F.concat(F.lit(f'{name}="'), text, F.lit('"'))

    return F.concat_ws(",", *[escaped(name) for name in names])


def label_counters(rows: DataFrame, counters: dict[str, tuple[list[str], Column | None]]) -> DataFrame:
    """Counts per label set of several counters: (counter, labels, count).

    `counters` maps a name to its label columns and an optional row filter. The log is first reduced to
    one row per combination of all labels; the counters are read off that.
    """
    columns = list(dict.fromkeys(c for labels, _ in counters.values() for c in labels))
    flags = {name: f"_counts_{name}" for name, (_, wanted) in counters.items() if wanted is not None}
    flagged = rows
    for name, flag in flags.items():
        flagged = flagged.withColumn(flag, F.coalesce(counters[name][1], F.lit(False)))
    reduced = flagged.groupBy(*columns, *flags.values()).agg(F.count(F.lit(1)).alias("_n"))
    entries = F.array(*[
        F.struct(
            F.lit(name).alias("counter"),
            label_text(labels).alias("labels"),
            (F.col(flags[name]) if name in flags else F.lit(True)).alias("counts"))
        for name, (labels, _) in counters.items()
    ])
    return (
        reduced.withColumn("_entry", F.explode(entries)).filter("_entry.counts")
        .groupBy(F.col("_entry.counter").alias("counter"), F.col("_entry.labels").alias("labels"))
        .agg(F.sum("_n").alias("count"))
    )


# Registers of a distinct-key sketch, as a power of two: about 0.8 % of error.
SKETCH_BITS = 14


def _queued(requests: DataFrame, seconds: int) -> DataFrame:
    """(window_start, queue_size): misses that began before the end of the window and were not answered by then.

    A miss takes latency_ms. It counts in as many windows as end while it lasts, in most cases none or one.
    """
    width = seconds * 1_000_000
    started, done = F.unix_micros("ts"), F.unix_micros("ts") + F.floor(F.col("latency_ms") * 1000)
    first = F.floor(started / F.lit(width)).cast("long")
    last = F.floor((done - 1) / F.lit(width)).cast("long") - 1  # the last window that ends before the answer
    waiting = requests.filter(~F.col("cache_hit") & F.col("latency_ms").isNotNull()).select(first.alias("_a"), last.alias("_b"))
    each = waiting.filter(F.col("_b") >= F.col("_a")).select(F.explode(F.sequence("_a", "_b")).alias("_w"))
    return each.groupBy(F.timestamp_micros(F.col("_w") * width).alias("window_start")).agg(F.count(F.lit(1)).alias("queue_size"))


def mergeable_snapshot(requests: DataFrame, seconds: int = COLLECTION_SECONDS) -> DataFrame:
    """Per collection window what can be rolled up to any longer one: counts, sums and a sketch of the keys.

    Needs vector_size and latency_ms; rows without a time are in no window.
    """
    window = F.window("ts", f"{seconds} seconds")["start"].alias("window_start")
    counted = requests.groupBy(window).agg(
        F.count_if("cache_hit").alias("cache_hits"), F.count_if(~F.col("cache_hit")).alias("cache_misses"),
        F.sum("similarity_score").alias("score_sum"), F.count("similarity_score").alias("score_count"),
        F.count_if(~F.col("success")).alias("error_count"), F.sum("vector_size").alias("size_sum"),
        F.count("vector_size").alias("size_count"), F.hll_sketch_agg("embedding_id", SKETCH_BITS).alias("keys"))
    return counted.join(_queued(requests, seconds), "window_start", "left").withColumn(
        "queue_size", F.coalesce("queue_size", F.lit(0).cast("long")))


def roll_up(snapshots: DataFrame, seconds: int) -> DataFrame:
    """Mergeable snapshots over longer windows, without the log; the queue is the longest of the parts."""
    window = F.window("window_start", f"{seconds} seconds")["start"].alias("_start")
    sums = ["cache_hits", "cache_misses", "score_sum", "score_count", "error_count", "size_sum", "size_count"]
    return snapshots.groupBy(window).agg(
        *[F.sum(c).alias(c) for c in sums], F.hll_union_agg("keys").alias("keys"), F.max("queue_size").alias("queue_size"),
        F.count(F.lit(1)).alias("windows")).withColumnRenamed("_start", "window_start")


def read_snapshot(snapshots: DataFrame) -> DataFrame:
    """Mergeable snapshots as figures: hit rate, mean score, estimated distinct keys and their bytes."""
    keys = F.hll_sketch_estimate("keys")
    return snapshots.select(
        "window_start", "cache_hits", "cache_misses", keys.alias("total_embeddings"),
        F.coalesce(F.try_divide("score_sum", "score_count"), F.lit(0.0)).alias("avg_similarity_score"),
        (keys * F.coalesce(F.try_divide("size_sum", "size_count"), F.lit(0.0)) * 4).cast("long").alias("memory_bytes"),
        "error_count", "queue_size", ratio("cache_hits", F.col("cache_hits") + F.col("cache_misses")).alias("hit_rate"))


def append_history(snapshots: DataFrame, path: str, ts: str = "window_start") -> None:
    """Adds snapshots to the history below `path`, a folder per day; windows that are there already are replaced.

    Only the days of the new snapshots are written; the same snapshots a second time leave the same rows.
    """
    spark = snapshots.sparkSession
    fresh = cut_lineage(snapshots.withColumn("day", F.to_date(ts)))
    days = [row["day"] for row in fresh.select("day").distinct().collect()]  # as many as the snapshots span
    try:
        old = spark.read.schema(fresh.schema).parquet(path).filter(F.col("day").isin(days))
        # the folders that are read are written next
        fresh = fresh.unionByName(cut_lineage(old.join(fresh.select(ts), ts, "left_anti").select(fresh.columns)))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    fresh.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_history(spark: SparkSession, path: str, now: Column, days: int = RETENTION_DAYS, ts: str = "window_start") -> DataFrame:
    """The history that is newer than the retention; older days are not read."""
    oldest = now - F.make_dt_interval(days=F.lit(days))
    return spark.read.parquet(path).filter((F.col("day") >= F.to_date(oldest)) & (F.col(ts) > oldest)).drop("day")


def metric_snapshot(requests: DataFrame, seconds: int = COLLECTION_SECONDS) -> DataFrame:
    """Per collection window: hits, misses, hit rate, distinct keys, mean score, vector bytes, errors, queue size.

    Exact; see `mergeable_snapshot` for what is kept. Needs vector_size and latency_ms; bytes are those of the
    vectors that were asked for, each once.
    """
    window = F.window("ts", f"{seconds} seconds")["start"].alias("window_start")
    # one row per (window, key) first, so the distinct count is a plain count
    keys = requests.groupBy(window, "embedding_id").agg(
        F.count_if("cache_hit").alias("_hits"), F.count_if(~F.col("cache_hit")).alias("_misses"),
        F.sum("similarity_score").alias("_score"), F.count("similarity_score").alias("_scores"),
        F.count_if(~F.col("success")).alias("_errors"), F.max("vector_size").alias("_size"))
    counted = keys.groupBy("window_start").agg(
        F.sum("_hits").alias("cache_hits"), F.sum("_misses").alias("cache_misses"),
        F.count(F.lit(1)).alias("total_embeddings"),
        F.coalesce(F.try_divide(F.sum("_score"), F.sum("_scores")), F.lit(0.0)).alias("avg_similarity_score"),
        (F.sum("_size") * 4).cast("long").alias("memory_bytes"),
        F.sum("_errors").alias("error_count"),
    ).withColumn("hit_rate", ratio("cache_hits", F.col("cache_hits") + F.col("cache_misses")))
    return counted.join(_queued(requests, seconds), "window_start", "left").withColumn(
        "queue_size", F.coalesce("queue_size", F.lit(0).cast("long")))


def hit_rate_window(requests: DataFrame, seconds: int) -> DataFrame:
    """Hits, requests and hit rate per time window."""
    window = F.window("ts", f"{seconds} seconds")["start"].alias("window_start")
    return requests.groupBy(window).agg(
        F.count_if("cache_hit").alias("hits"), F.count(F.lit(1)).alias("requests"),
    ).withColumn("hit_rate", ratio("hits", "requests"))


def batch_summary(requests: DataFrame, batch: str = "batch_id") -> DataFrame:
    return requests.groupBy(batch).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("cache_hit").alias("hits"),
        F.count_if(~F.col("cache_hit")).alias("misses"), F.count_if("success").alias("successes"),
        F.count_if(~F.col("success")).alias("failures"),
    ).withColumn("hit_rate", ratio("hits", "total"))


def alert_breaches(samples: DataFrame, series: str, value: str, threshold: float, align_seconds: int,
                   hold_windows: int) -> DataFrame:
    """Stretches of at least `hold_windows` neighbouring windows whose mean is above the threshold.

    `samples` has ts, the series label and the value. The windows run over aligned means, one row per
    series and window, not over samples.
    """
    width = align_seconds * 1_000_000
    slot = F.floor(F.unix_micros("ts") / F.lit(width)).cast("long").alias("_slot")
    means = samples.groupBy(series, slot).agg(F.avg(value).alias("_mean"))
    above = means.filter(F.col("_mean") > threshold)
    order = Window.partitionBy(series).orderBy("_slot")
    islands = above.withColumn("_island", F.col("_slot") - F.row_number().over(order))
    return (
        islands.groupBy(series, "_island").agg(
            F.count(F.lit(1)).alias("windows"), F.min("_slot").alias("_from"), F.max("_slot").alias("_to"),
            F.max("_mean").alias("peak"))
        .filter(F.col("windows") >= hold_windows)
        .select(series, F.timestamp_micros(F.col("_from") * width).alias("breach_start"),
                F.timestamp_micros((F.col("_to") + 1) * width).alias("breach_end"), "windows", "peak")
    )


def counter_samples(counters: DataFrame) -> DataFrame:
    """Counter rows as metric rows (name, labels, value as text)."""
    return counters.select(F.col("counter").alias("name"), "labels", F.col("count").cast("string").alias("value"))


def histogram_samples(buckets: DataFrame, name: str, by: list[str]) -> DataFrame:
    """Rows of `histogram` as metric rows: a line per bucket, and sum and count per label set."""
    labels, with_bound = label_text(by), label_text([*by, "le"])

    def sample(suffix: str, text: Column, value: Column) -> Column:
        return F.struct(F.lit(name + suffix).alias("name"), text.alias("labels"), value.cast("string").alias("value"))

    bucket = sample("_bucket", with_bound, F.col("bucket_count"))
    total = sample("_sum", labels, F.col("total_sum").cast("decimal(38,6)"))
    count = sample("_count", labels, F.col("total_count"))
    lines = F.when(F.col("le") == "+Inf", F.array(bucket, total, count)).otherwise(F.array(bucket))
    return buckets.select(F.explode(lines).alias("_line")).select("_line.*")


def gauge_samples(row: DataFrame, gauges: dict[str, str]) -> DataFrame:
    """Columns of a one-row table as metric rows; `gauges` maps a metric name to its column."""
    lines = F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit("").alias("labels"),
                 F.col(column).cast("decimal(38,6)").cast("string").alias("value"))
        for name, column in gauges.items()
    ])
    return row.select(F.explode(lines).alias("_line")).select("_line.*")


def labelled_gauges(rows: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """A gauge per row as metric rows."""
    return rows.select(F.lit(name).alias("name"), label_text(labels).alias("labels"),
                       F.col(value).cast("decimal(38,6)").cast("string").alias("value"))


def family_lines(samples: DataFrame, families: dict[str, tuple[str, str]] = FAMILIES) -> DataFrame:
    """(family, line) of the samples, and of the HELP and TYPE lines of the families that have some."""
    # an entry per sample name, as many as the table has lines
    known = {name + suffix: name for name, (kind, _) in families.items()
             for suffix in (("_bucket", "_sum", "_count") if kind == "histogram" else ("",))}
    of = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    texts = F.create_map(*[x for name, (kind, text) in families.items() for x in (
        F.lit(name), F.array(F.lit(f"# HELP {name} {text}"), F.lit(f"# TYPE {name} {kind}")))])
    lines = samples.select(F.coalesce(of[F.col("name")], F.col("name")).alias("family"), _line().alias("line"))
    there = lines.select("family").distinct().filter(F.col("family").isin(list(families)))
    return there.select("family", F.explode(texts[F.col("family")]).alias("line")).unionByName(lines)


def _line() -> Column:
    named = F.when(F.col("labels") == "", F.col("name")).otherwise(F.concat("name", F.lit("{"), "labels", F.lit("}")))
    return F.concat(named, F.lit(" "), F.col("value").cast("string"))


def export_metrics_text(samples: DataFrame, families: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Metric rows (name, labels as exposition text, value) as text lines; with `families` in order, a family's HELP and
    TYPE before its samples."""
    if families is None:
        return samples.select(_line().alias("line"))
    return family_lines(samples, families).orderBy("family", ~F.col("line").startswith("#"), "line").select("line")


def write_metrics_text(samples: DataFrame, path: str, families: dict[str, tuple[str, str]] | None = None) -> None:
    """Text lines as files below `path`."""
    export_metrics_text(samples, families).write.mode("overwrite").text(path)
