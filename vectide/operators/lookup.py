"""Exact lookup, batch lookup, lookup with similarity fallback, warm-up and compute on miss.

Requests may ask for one key very often. The store is joined to the distinct keys first, which have one
row each, and only the outcome is joined back to the requests. A batch that is small next to the store
is then broadcast in both joins, also for the left join, and the store is never shuffled; in a large one
the hot key is split by Spark (AQE skew join).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from vectide.functions.keys import cache_key
from vectide.operators.similarity import RANK_DIGITS, similar_topk
from vectide.operators.store import effective_threshold
from vectide.session import cut_lineage


def _found(requests: DataFrame, store: DataFrame, key: str) -> DataFrame:
    asked = requests.select(key).distinct()
    return asked.join(store, key)


def exact_lookup(requests: DataFrame, store: DataFrame, key: str = "embedding_id") -> DataFrame:
    """Requests whose key is stored, with the stored columns."""
    return requests.join(_found(requests, store, key), key)


def text_lookup(requests: DataFrame, store: DataFrame) -> DataFrame:
    """Lookup by (text, model_version): the key is derived from the whole text."""
    keyed = requests.withColumn("key", cache_key("model_version", "text"))
    return exact_lookup(keyed, store, "key")


def batch_lookup(requests: DataFrame, store: DataFrame, key: str = "embedding_id") -> DataFrame:
    """Each request, repeats included, with `found` and the stored columns (null when missing).

    `pos` of the request is kept; sort by it for the order of the request list.
    """
    hits = _found(requests, store, key).withColumn("_hit", F.lit(True))
    return (
        requests.join(hits, key, "left")
        .withColumn("found", F.coalesce("_hit", F.lit(False)))
        .drop("_hit")
    )


def lookup_with_fallback(requests: DataFrame, store: DataFrame, vectors: DataFrame, threshold: float,
                         key: str = "embedding_id", own_threshold: str = "threshold", flag: str = "enable_fallback",
                         **how) -> DataFrame:
    """Exact hit, else the most similar stored entry at or above the threshold, else not found.

    A request may bring its own threshold (null or not above zero: the default) and a flag that turns the
    fallback off (null: on), in columns of these names. `vectors` gives the query vector per key. The search runs
    once per distinct missing key, at the lowest threshold asked for it, in one pass over the store; its best
    match answers each request whose threshold it reaches, as rounded to nine digits.
    """
    bar = effective_threshold(F.col(own_threshold), threshold) if own_threshold in requests.columns else F.lit(threshold)
    wanted = F.coalesce(F.col(flag), F.lit(True)) if flag in requests.columns else F.lit(True)
    # read for the hits, for the misses and, by the search, for its size
    asked = cut_lineage(requests.groupBy(key).agg(F.min(F.when(wanted, bar)).alias("_least")))
    stored = store.select(key, F.lit(True).alias("_hit"))
    missing = asked.filter(F.col("_least").isNotNull()).join(stored, key, "left_anti")
    queries = missing.join(vectors.select(key, "embedding"), key).select(
        F.col(key).alias("query_id"), F.col("embedding").alias("query_vec"), F.col("_least").alias("threshold"))
    nearest = similar_topk(store, queries, 1, None, **how).select(
        F.col("query_id").alias(key), F.col(key).alias("_matched"), F.col("similarity").alias("_score"))
    exact = asked.join(stored, key, "left_semi").select(
        key, F.col(key).alias("_matched"), F.lit(None).cast("double").alias("_score"))
    answers = exact.unionByName(nearest)
    good = F.col("_score").isNull() | (F.col("_wanted") & (F.col("_score") >= F.round(F.col("_bar"), RANK_DIGITS)))
    joined = requests.withColumns({"_bar": bar, "_wanted": wanted}).join(answers, key, "left")
    return joined.select(
        *requests.columns, F.when(good, F.col("_matched")).alias("matched_key"),
        F.when(good, F.col("_score")).alias("similarity_score"),
        (good & F.col("_matched").isNotNull()).alias("found"), (good & F.col("_score").isNotNull()).alias("similarity_match"))


def orphan_index_entries(index: DataFrame, store: DataFrame, key: str = "embedding_id") -> DataFrame:
    """Index entries that are no longer in the store."""
    return index.join(store.select(key), key, "left_anti")


def warm_candidates(requests: DataFrame, cached: DataFrame) -> DataFrame:
    """Requested (text, model_version) that are not cached, once each, with key and first request.

    The first request of a key is picked on ids; texts are fetched for the picked ones only.
    """
    keyed = requests.select("doc_id", cache_key("model_version", "text").alias("key"))
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    missing = first.join(cached.select("key"), "key", "left_anti")
    return missing.join(requests.select("doc_id", "text", "model_version"), "doc_id")


def get_or_compute(requests: DataFrame, cached: DataFrame, compute: Callable[[DataFrame], DataFrame],
                   as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(answers, new entries): cached entries as they are, missing texts through `compute`, once per key.

    `compute` maps rows with (key, text, model_version) to the same rows plus `embedding`.
    """
    keyed = requests.withColumn("key", cache_key("model_version", "text"))
    missing = warm_candidates(requests, cached).select("key", "text", "model_version")
    # both outputs use it: the function must run once per key, and both must see the same vectors
    computed = cut_lineage(compute(missing).select("key", "model_version", "embedding"))
    fresh = computed.select("key", "model_version", "embedding", as_of.alias("created_at"), F.lit(0).alias("access_count"))
    known = cached.select("key", "embedding", F.lit(True).alias("cached")).unionByName(
        computed.select("key", "embedding", F.lit(False).alias("cached")))
    return keyed.drop("text").join(known, "key"), fresh
