"""Access-log statistics per key.

A log has embedding_id, ts, event_id (unique), and where an operator needs them vector_size, cluster_id
and similarity_score. One key may hold a large share of the log: everything here is either an aggregate
that is combined before the shuffle or a blocked window (see `groups`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vectide.functions.numbers import age_hours, closeness
from vectide.functions.vectors import l2_norm
from vectide.operators.groups import BLOCK_SECONDS, newest, top_per_group, trailing_mean, with_previous

# Sizes and thresholds of the access statistics.
SCORE_MEMORY = 100
LATENCY_MEMORY = 1000
PATTERN_MEMORY = 10_000
PATTERN_THRESHOLD = 0.3
TRAINING_HOURS = 24
TRAINING_MINIMUM = 50


def _seconds(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)


def access_patterns(log: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Per access: running count of its key and seconds since the access before (0 on the first)."""
    rows = with_previous(log, "embedding_id", "ts", "event_id", ["ts"], block_seconds,
                         position="access_frequency")
    gap = _seconds(F.col("ts"), F.col("previous.ts"))
    return rows.withColumn("time_since_last_access", F.coalesce(gap, F.lit(0.0))).drop("previous")


def running_avg_interval(log: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Per access the mean gap so far; null on the first access of a key.

    The gaps up to a row add up to its distance from the key's first access, so no running sum is needed.
    """
    rows = with_previous(log, "embedding_id", "ts", "event_id", ["ts"], block_seconds,
                         position="access_frequency", first="_first_ts")
    mean = F.try_divide(_seconds(F.col("ts"), F.col("_first_ts")), F.col("access_frequency") - 1)
    return rows.withColumn("average_interval", mean).drop("previous", "_first_ts")


def rolling_score(log: DataFrame, n: int = SCORE_MEMORY, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Per scored access the mean of the last n scores of its key."""
    scored = log.filter(F.col("similarity_score").isNotNull())
    rows = with_previous(scored, "embedding_id", "ts", "event_id", ["ts"], block_seconds).drop("previous")
    return trailing_mean(rows, "embedding_id", "position", "similarity_score", n, "rolling_score")


def rolling_latency(log: DataFrame, by: str, n: int = LATENCY_MEMORY, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Per request the mean latency of the last n requests of its service or shard."""
    rows = with_previous(log, by, "ts", "event_id", ["ts"], block_seconds).drop("previous")
    return trailing_mean(rows, by, "position", "latency_ms", n, "rolling_latency_ms")


def key_access_stats(log: DataFrame, scores: int = SCORE_MEMORY) -> DataFrame:
    """Per key: accesses, last access, mean gap (null for one access), mean of the last `scores` scores.

    The gaps of a key add up to last - first, so the mean gap is a plain aggregate.
    """
    counts = log.groupBy("embedding_id").agg(
        F.count(F.lit(1)).alias("access_count"), F.min("ts").alias("_first"), F.max("ts").alias("last_access"))
    lean = log.filter(F.col("similarity_score").isNotNull()).select(
        "embedding_id", "ts", "event_id", "similarity_score")
    recent = top_per_group(lean, ["embedding_id"], [F.col("ts").desc(), F.col("event_id").desc()], scores)
    means = recent.groupBy("embedding_id").agg(F.avg("similarity_score").alias("_score"))
    return counts.join(means, "embedding_id", "left").select(
        "embedding_id", "access_count", "last_access",
        F.try_divide(_seconds(F.col("last_access"), F.col("_first")), F.col("access_count") - 1).alias("average_interval"),
        F.coalesce("_score", F.lit(0.0)).alias("avg_similarity"))


def latest_pattern(patterns: DataFrame) -> DataFrame:
    """The newest access pattern of each key; one candidate row per key and task is shuffled."""
    others = [c for c in patterns.columns if c != "embedding_id"]
    last = patterns.groupBy("embedding_id").agg(
        F.max_by(F.struct(*others), F.struct("ts", "event_id")).alias("_row"))
    return last.select("embedding_id", "_row.*")


def latest_access(log: DataFrame) -> DataFrame:
    """The newest pattern of each key straight from the log: the running count of a key's last access is
    its total, so no window over the log is needed."""
    last = log.groupBy("embedding_id").agg(
        F.max("ts").alias("ts"), F.count(F.lit(1)).alias("access_frequency"),
        F.max_by(F.struct("vector_size", "cluster_id"), F.struct("ts", "event_id")).alias("_row"))
    return last.select("embedding_id", "ts", "access_frequency", "_row.*")


def sample_per_shard(store: DataFrame, n: int, shard: str = "shard") -> DataFrame:
    """The first n entries of each shard by id. Ranks ids only, then fetches the rows."""
    ids = top_per_group(store.select(shard, "embedding_id"), [shard], [F.col("embedding_id")], n)
    return store.join(ids.select("embedding_id", "rank"), "embedding_id")


def bounded_history(log: DataFrame, n: int = PATTERN_MEMORY) -> DataFrame:
    """The newest n accesses."""
    return newest(log, "ts", "event_id", n)


def training_window(log: DataFrame, as_of: Column, hours: int = TRAINING_HOURS,
                    minimum: int = TRAINING_MINIMUM) -> DataFrame:
    """Accesses newer than `as_of` - hours, or none when there are fewer than `minimum` of them."""
    recent = log.filter(F.col("ts") > as_of - F.make_dt_interval(hours=F.lit(hours)))
    enough = recent.limit(minimum).count() >= minimum
    return recent if enough else recent.filter(F.lit(False))


def usage_patterns(log: DataFrame, store: DataFrame, as_of: Column, window_hours: float) -> DataFrame:
    """Per key the features of the precompute model and its soft label min(accesses per hour, 1).

    Rows that break a bound (negative count, frequency or norm, dimension below 1) are left out.
    """
    counts = log.groupBy("embedding_id").agg(
        F.count(F.lit(1)).alias("access_count"), F.max("ts").alias("last_access"))
    vectors = store.select(
        "embedding_id", l2_norm("embedding").alias("vector_norm"), F.size("embedding").alias("dimension"),
        F.col("similarity_cluster").alias("similarity_group"))
    rows = counts.join(vectors, "embedding_id").withColumn(
        "access_frequency", F.col("access_count") / F.lit(float(window_hours)))
    return rows.filter(
        (F.col("access_count") >= 0) & (F.col("access_frequency") >= 0) & (F.col("similarity_group") >= 0)
        & (F.col("vector_norm") >= 0) & ~F.isnan("vector_norm") & (F.col("dimension") >= 1)
    ).select(
        "embedding_id", "access_count", "last_access",
        age_hours(as_of, F.col("last_access")).alias("hours_since_access"),
        "access_frequency", "vector_norm", "dimension", "similarity_group",
        F.least("access_frequency", F.lit(1.0)).alias("label"))


def top_accessed(log: DataFrame, n: int = 10) -> DataFrame:
    counts = log.groupBy("embedding_id").agg(F.count(F.lit(1)).alias("access_count"))
    return counts.orderBy(F.col("access_count").desc(), F.col("embedding_id")).limit(n)


def predictor_summary(log: DataFrame, model_trained: bool, last_training: Column, exact: bool = True) -> DataFrame:
    """Patterns, distinct keys and model state; `exact=False` counts keys by a sketch."""
    keys = F.count_distinct("embedding_id") if exact else F.approx_count_distinct("embedding_id")
    return log.agg(F.count(F.lit(1)).alias("total_patterns"), keys.alias("tracked_embeddings")).select(
        "*", F.lit(model_trained).alias("model_trained"), last_training.alias("last_training_time"))


def pattern_similarity(latest: DataFrame, reference_keys: list[int], limit: int = 10,
                       threshold: float = PATTERN_THRESHOLD) -> DataFrame:
    """For each reference key the other keys with the most similar latest pattern.

    Mean of size closeness, frequency closeness and, where both have a cluster, 2 for the same cluster and
    0 for another; 0 where a denominator is 0. Reference keys are a short list of the caller; their
    patterns travel as literals, so every key is scored in the scan and only matches are ranked.
    """
    if len(reference_keys) > 1000:
        raise ValueError("ask for at most 1000 reference keys at a time")
    rows = latest.filter(F.col("embedding_id").isin(reference_keys)).select(
        "embedding_id", "vector_size", "access_frequency", "cluster_id").collect()
    if not rows:
        return latest.select(
            F.col("embedding_id").alias("reference_key"), "embedding_id", F.lit(0.0).alias("similarity"),
            F.lit(0).alias("rank")).filter(F.lit(False))
    key_type = latest.schema["embedding_id"].dataType
    references = F.array(*[
        F.struct(F.lit(r["embedding_id"]).cast(key_type).alias("key"), F.lit(r["vector_size"]).alias("size"),
                 F.lit(r["access_frequency"]).alias("frequency"),
                 F.lit(r["cluster_id"]).cast("string").alias("cluster"))
        for r in rows
    ])
    scored = latest.withColumn("_ref", F.explode(references)).filter(F.col("_ref.key") != F.col("embedding_id"))
    size = closeness("vector_size", "_ref.size")
    frequency = closeness("access_frequency", "_ref.frequency")
    own = F.col("cluster_id").cast("string")
    both = own.isNotNull() & (own != "") & F.col("_ref.cluster").isNotNull() & (F.col("_ref.cluster") != "")
    same = F.when(own == F.col("_ref.cluster"), F.lit(2.0)).otherwise(F.lit(0.0))
    mean = F.when(both, (size + frequency + same) / 3).otherwise((size + frequency) / 2)
    scored = scored.select(
        F.col("_ref.key").alias("reference_key"), "embedding_id",
        F.round(F.coalesce(mean, F.lit(0.0)), 9).alias("similarity")).filter(F.col("similarity") > threshold)
    return top_per_group(scored, ["reference_key"], [F.col("similarity").desc(), F.col("embedding_id")], limit)
