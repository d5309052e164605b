"""Features, models and scores that rank which keys to compute ahead of a request."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from vectide.functions.numbers import age_seconds
from vectide.operators import trainer
from vectide.operators.access import access_patterns
from vectide.operators.groups import BLOCK_SECONDS, with_previous
from vectide.operators.store import hot_entry

# Thresholds of the prediction.
PREDICTION_THRESHOLD = 0.7
CONFIDENT_ACCESSES = 10
CONFIDENCE_THRESHOLD = 0.5
MINIMUM_ACCESSES = 2
PROBABILITY_THRESHOLD = 0.5

ACCESS_FEATURES = ["vector_size", "score", "access_frequency", "time_since_last_access", "cluster_code", "age"]
USAGE_FEATURES = ["access_count", "hours_since_access", "access_frequency", "vector_norm", "dimension",
                  "similarity_group"]


def access_features(log: DataFrame, keys: DataFrame, as_of: Column,
                    block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Six features per access; a null score counts as 0, the cluster number is its own code.

    `keys` has vector_size and cluster_id per key; it is joined once the windows are done.
    """
    patterns = access_patterns(log, block_seconds).join(keys, "embedding_id")
    return patterns.select(
        "event_id", "embedding_id", "ts",
        F.col("vector_size").cast("double").alias("vector_size"),
        F.coalesce("similarity_score", F.lit(0.0)).alias("score"),
        F.col("access_frequency").cast("double").alias("access_frequency"),
        "time_since_last_access",
        F.pmod(F.coalesce("cluster_id", F.lit(0)), F.lit(1000)).cast("double").alias("cluster_code"),
        age_seconds(as_of, F.col("ts")).alias("age"))


def scale_features(features: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as (x - mean) / population deviation, 0 without spread; unchanged for a table of one row."""
    stats = features.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.avg(c).alias(f"_mean_{c}") for c in columns],
        *[F.stddev_pop(c).alias(f"_dev_{c}") for c in columns]).first()
    if stats["_n"] <= 1:
        return features
    out = features
    for c in columns:
        mean, dev = stats[f"_mean_{c}"], stats[f"_dev_{c}"]
        # a deviation that is only rounding noise is no spread
        flat = dev is None or dev <= 1e-9 * max(1.0, abs(mean))
        out = out.withColumn(c, F.lit(0.0) if flat else (F.col(c) - F.lit(mean)) / F.lit(dev))
    return out


def next_gap_examples(features: DataFrame, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Features of an access with the seconds until the next access of its key as `next_gap`.

    The later access of each pair carries the earlier one's features.
    """
    pairs = with_previous(features, "embedding_id", "ts", "event_id", ["event_id", *ACCESS_FEATURES], block_seconds)
    return pairs.filter(F.col("previous").isNotNull()).select(
        "embedding_id", "previous.*", F.col("time_since_last_access").alias("next_gap"))


def fit_access_regressor(examples: DataFrame, seed: int = 42, trees: int = 10, depth: int = 5) -> PipelineModel:
    """Forecast of the next gap of a key from the six access features.

    The label is the gap, in seconds; `gap_score` turns a forecast into a score between 0 and 1. The trees
    of a forest grow together, so the number of passes over the data is the depth, not depth x trees.
    """
    pipeline = Pipeline(stages=[
        VectorAssembler(inputCols=ACCESS_FEATURES, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="features", withMean=True),
        RandomForestRegressor(labelCol="next_gap", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed),
    ])
    return _fit(pipeline, examples)


def _fit(pipeline: Pipeline, examples: DataFrame) -> PipelineModel:
    """Fits on a persisted copy, since every stage reads the examples again; lost parts are recomputed."""
    examples = examples.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return pipeline.fit(examples)
    finally:
        examples.unpersist()


def gap_score(gap: Column, horizon_seconds: float = 4 * 3600.0) -> Column:
    """exp(-gap / horizon): near 1 for an access expected soon, near 0 for one far off."""
    return F.exp(-F.greatest(gap, F.lit(0.0)) / F.lit(horizon_seconds))


def fit_precompute_classifier(usage: DataFrame, seed: int = 42, validation: float = trainer.HELD_OUT,
                              **how) -> tuple[trainer.Network, DataFrame]:
    """(model of the access probability, held-out rows). The held-out loss steers the fit: its best weights are
    kept. Rows are split by the hash of their key, so a recomputed partition falls on the same side."""
    net = trainer.fit(usage, USAGE_FEATURES, "label", "embedding_id", share=validation, seed=seed, **how)
    return net, usage.filter(trainer.held_out("embedding_id", validation))


def refit_precompute_classifier(usage: DataFrame, last_trained_us: int | None, as_of_us: int, **how) -> trainer.Network | None:
    """A new model, or None where the last one is not old enough or the examples are too few."""
    few = usage.limit(trainer.MINIMUM_EXAMPLES).count()
    return fit_precompute_classifier(usage, **how)[0] if trainer.training_due(last_trained_us, as_of_us, few) else None


def predict_precompute(model: trainer.Network, usage: DataFrame, threshold: float = PROBABILITY_THRESHOLD) -> DataFrame:
    scored = model.predict(usage, "access_probability")
    return scored.select(*usage.columns, "access_probability", (F.col("access_probability") > threshold).alias("precompute"))


def model_evaluation(scored: DataFrame, truth: str, predicted: str, probability: bool) -> DataFrame:
    """Mean squared and absolute error, and the cross-entropy where the prediction is a probability."""
    error = F.col(predicted) - F.col(truth)
    measures = [F.count(F.lit(1)).alias("rows"), F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae")]
    if probability:
        p = F.least(F.greatest(F.col(predicted), F.lit(1e-12)), F.lit(1 - 1e-12))
        loss = -(F.col(truth) * F.log(p) + (1 - F.col(truth)) * F.log(1 - p))
        measures.append(F.avg(loss).alias("log_loss"))
    return scored.agg(*measures)


def predict_access_needs(keys: DataFrame, stats: DataFrame, scores: DataFrame,
                         threshold: float = PREDICTION_THRESHOLD) -> DataFrame:
    """Confidence, priority and the precompute decision per key; keys without statistics are skipped."""
    known = keys.select("embedding_id").distinct().join(stats, "embedding_id").join(scores, "embedding_id")
    n = F.col("access_count")
    confidence = F.least(F.lit(1.0), n / F.lit(float(CONFIDENT_ACCESSES)))
    return known.select(
        "embedding_id", "access_count", "prediction", confidence.alias("confidence"),
        (F.col("prediction") * confidence * F.log1p(n)).alias("priority_score"),
        ((F.col("prediction") > threshold) & (confidence > CONFIDENCE_THRESHOLD) & (n > MINIMUM_ACCESSES))
        .alias("should_precompute"))


def ranked_predictions(predictions: DataFrame, limit: int | None = None) -> DataFrame:
    """Predictions by falling priority, ids break ties; a distributed sort without `limit`."""
    ordered = predictions.orderBy(F.col("priority_score").desc(), F.col("embedding_id"))
    return ordered if limit is None else ordered.limit(limit)


def precompute_queue(predictions: DataFrame, store: DataFrame, live: DataFrame, as_of: Column) -> DataFrame:
    """Keys worth computing now: recommended ones and hot entries, without those that are live.

    Each key comes once, with its priority (0 without a prediction) and why it is queued.
    """
    recommended = predictions.filter("should_precompute").select(
        "embedding_id", "priority_score", F.lit(True).alias("_recommended"), F.lit(False).alias("_hot"))
    hot = store.filter(hot_entry(as_of)).select(
        "embedding_id", F.lit(0.0).alias("priority_score"), F.lit(False).alias("_recommended"), F.lit(True).alias("_hot"))
    merged = recommended.unionByName(hot).groupBy("embedding_id").agg(
        F.max("priority_score").alias("priority_score"),
        F.bool_or("_recommended").alias("recommended"), F.bool_or("_hot").alias("hot"))
    return merged.join(live.select("embedding_id"), "embedding_id", "left_anti").orderBy(
        F.col("priority_score").desc(), F.col("embedding_id"))
