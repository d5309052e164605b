"""Store upkeep: validation, upsert, bulk store, expiry, eviction, invalidation and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vectide.functions.keys import cache_key, glob_to_regex
from vectide.functions.numbers import age_seconds, ratio
from vectide.operators.groups import one_row
from vectide.session import cut_lineage

# Defaults of the store operators.
DEFAULT_TTL_SECONDS = 3600
DEFAULT_SIMILARITY_THRESHOLD = 0.85
MAX_BATCH = 1000
MAX_TOP_K = 1000
HOT_ACCESS_COUNT = 5
HOT_WINDOW_SECONDS = 300

# written keys that are sent to all executors: some 100 MB of ids or text keys
BROADCAST_KEYS = 1_000_000


def validate_vectors(rows: DataFrame, dim: int, key: str = "embedding_id", vector: str = "embedding") -> DataFrame:
    """Adds `error`: null for a row that may be stored, else the first rule it breaks."""
    return rows.withColumn(
        "error",
        F.when(F.col(key).isNull() | (F.col(key).cast("string") == ""), "empty key")
        .when(F.col(vector).isNull() | (F.size(vector) == 0), "empty vector")
        .when(F.size(vector) != dim, "wrong dimension"),
    )


def split_valid(rows: DataFrame, dim: int, **names) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine) by `validate_vectors`."""
    checked = validate_vectors(rows, dim, **names)
    return checked.filter(F.col("error").isNull()).drop("error"), checked.filter(F.col("error").isNotNull())


def effective_threshold(threshold: Column, default: float = DEFAULT_SIMILARITY_THRESHOLD) -> Column:
    return F.when(threshold > 0, threshold).otherwise(F.lit(default))


def validate_requests(requests: DataFrame) -> DataFrame:
    """Search requests with `error` and the threshold in effect; needs query_vec, top_k and threshold."""
    return requests.withColumn(
        "error",
        F.when(F.col("query_vec").isNull() | (F.size("query_vec") == 0), "empty query")
        .when(F.col("top_k").isNull() | (F.col("top_k") <= 0), "top_k must be positive")
        .when(F.col("top_k") > MAX_TOP_K, "top_k too large"),
    ).withColumn("threshold_used", effective_threshold(F.col("threshold")))


def validate_batches(requests: DataFrame, batch: str = "batch_id", largest: int = MAX_BATCH) -> DataFrame:
    """One row per batch with its size and whether it is accepted."""
    sizes = requests.groupBy(batch).agg(F.count(F.lit(1)).alias("batch_size"))
    return sizes.withColumn("accepted", (F.col("batch_size") >= 1) & (F.col("batch_size") <= largest))


def latest_per_id(rows: DataFrame, key: str = "embedding_id", newest: str = "created_at",
                  tie: str | None = None) -> DataFrame:
    """One row per id, the newest. A max over a struct is combined before the shuffle, so an id that was
    written very often costs one row per task."""
    others = [c for c in rows.columns if c != key]
    order = [F.col(newest)] + ([F.col(tie)] if tie else [])
    picked = rows.groupBy(key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_row"))
    return picked.select(key, "_row.*").select(*rows.columns)


def few_keys(rows: DataFrame, key: str) -> DataFrame:
    """The keys of `rows`, marked for a broadcast if there are (counted) at most BROADCAST_KEYS."""
    keys = rows.select(key)
    return F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys


def settle(store: DataFrame, writes: DataFrame, key: str, tie: str | None) -> DataFrame:
    """The store after `writes` (one per key): only rows of written keys are compared, all others pass as they are.

    Up to BROADCAST_KEYS written keys (counted) are broadcast, so the store is not shuffled; beyond that the
    joins shuffle. The store has one row per key, as each writer here leaves it.
    """
    writes = cut_lineage(writes)  # read three times
    keys = few_keys(writes, key)
    old = store.join(keys, key, "left_semi").withColumn("_write", F.lit(0))
    both = old.unionByName(writes.withColumn("_write", F.lit(1)), allowMissingColumns=True)
    order = "_write"
    if tie and tie in both.columns:
        both = both.withColumn("_write", F.coalesce(F.col(tie), F.lit(-1)))
    settled = latest_per_id(both, key, tie=order).select(*store.columns)
    return store.join(keys, key, "left_anti").unionByName(settled)


def accepted_writes(incoming: DataFrame, dim: int, columns: list[str]) -> DataFrame:
    """The writes that break no rule; of the store's `columns` those the writer leaves out start at their defaults."""
    good, _ = split_valid(incoming, dim)
    defaults = {"access_count": F.lit(1), "last_accessed": F.col("created_at"),
                "ttl_seconds": F.lit(None).cast("int")}
    for name, value in defaults.items():
        if name in columns and name not in good.columns:
            good = good.withColumn(name, value)
    return good


def upsert_store(store: DataFrame, incoming: DataFrame, dim: int) -> DataFrame:
    """The store after writing `incoming`: rejected rows are left out, the newest write of an id wins and a
    write beats the stored row of equal age. See `sources.commitlog` for the same on a store on disk."""
    good = accepted_writes(incoming, dim, store.columns)
    tie = "write_id" if "write_id" in good.columns else None
    return settle(store, latest_per_id(good, tie=tie), "embedding_id", tie)


def bulk_store(entries: DataFrame, dim: int, as_of: Column, ttl_seconds: int | None = None,
               threshold: float = DEFAULT_SIMILARITY_THRESHOLD) -> DataFrame:
    """Text entries (text, embedding, model_version) with key, defaults and outcome per row.

    Rejected rows are reported, not fatal; `success` counts only what is stored.
    """
    keyed = entries.withColumn("key", cache_key("model_version", "text"))
    checked = validate_vectors(keyed, dim, key="key")
    return checked.select(
        *checked.columns, F.col("error").isNull().alias("success"),
        as_of.alias("created_at"), F.lit(0).alias("access_count"),
        F.lit(threshold).alias("similarity_threshold"), F.lit(ttl_seconds).cast("int").alias("ttl_seconds"))


def store_bulk(store: DataFrame, outcome: DataFrame, tie: str) -> tuple[DataFrame, DataFrame]:
    """(store after writing what `bulk_store` accepted, one row with the number of entries stored).

    A key that is written several times is stored once, the newest, then the highest `tie`; each accepted row
    counts as stored.
    """
    good = outcome.filter("success").drop("success", "error")
    stored = outcome.agg(F.count_if("success").alias("stored"))
    return settle(store, latest_per_id(good, "key", tie=tie), "key", None), stored


def metadata_json(store: DataFrame, fields: list[str]) -> DataFrame:
    """Each metadata field as a JSON text."""
    out = store
    for name in fields:
        out = out.withColumn(f"{name}_json", F.to_json(F.struct(F.col(name).alias("v"))))
        out = out.withColumn(f"{name}_json", F.regexp_extract(f"{name}_json", r'(?s)^\{"v":(.*)\}$', 1))
        out = out.withColumn(f"{name}_json", F.when(F.col(f"{name}_json") == "", "null").otherwise(F.col(f"{name}_json")))
    return out


def metadata_from_json(store: DataFrame, fields: dict[str, str], defaults: dict[str, Column]) -> DataFrame:
    """Decodes `<field>_json` by type; a missing or null field takes its default."""
    out = store
    for name, kind in fields.items():
        boxed = F.from_json(F.concat(F.lit('{"v":'), F.col(f"{name}_json"), F.lit("}")), f"v {kind}")["v"]
        out = out.withColumn(name, F.coalesce(boxed, defaults[name]) if name in defaults else boxed)
    return out


def _age(as_of: Column) -> Column:
    return age_seconds(as_of, F.col("created_at"))


def is_live(as_of: Column, default_ttl: int | None = None) -> Column:
    """No TTL, or an age of at most the TTL; with `default_ttl`, a row without one takes that."""
    ttl = F.col("ttl_seconds") if default_ttl is None else F.coalesce(F.col("ttl_seconds"), F.lit(default_ttl))
    return ttl.isNull() | (_age(as_of) <= ttl)


def live_entries(store: DataFrame, as_of: Column, default_ttl: int | None = None) -> DataFrame:
    return store.filter(is_live(as_of, default_ttl))


def expired_entries(store: DataFrame, as_of: Column, default_ttl: int | None = None) -> DataFrame:
    """Rows older than their TTL."""
    return store.filter(~is_live(as_of, default_ttl))


def evict_by_pattern(store: DataFrame, key: str, pattern: str) -> tuple[DataFrame, DataFrame]:
    """(kept, evicted) by a key glob over the whole key."""
    matches = F.col(key).rlike(glob_to_regex(pattern))
    return store.filter(~matches), store.filter(matches)


def invalidate_keys(store: DataFrame, keys: DataFrame, key: str = "embedding_id") -> tuple[DataFrame, DataFrame]:
    """(remaining store, per requested key whether it was there)."""
    asked = keys.select(key).distinct()
    remaining = store.join(asked, key, "left_anti")
    present = store.select(key, F.lit(True).alias("_there"))
    report = asked.join(present, key, "left").select(key, F.coalesce("_there", F.lit(False)).alias("invalidated"))
    return remaining, report


def hot_entry(as_of: Column, last_accessed: str = "last_accessed") -> Column:
    """True for an entry worth precomputing for: accessed often, or a moment ago."""
    return (F.col("access_count") >= HOT_ACCESS_COUNT) | (
        age_seconds(as_of, F.col(last_accessed)) < HOT_WINDOW_SECONDS)


def touch_metadata(store: DataFrame, log: DataFrame, key: str = "embedding_id") -> DataFrame:
    """Store with access_count and last_accessed advanced by the accesses of a log."""
    touched = log.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_last"))
    return (
        store.join(touched, key, "left")
        .withColumn("access_count", F.col("access_count") + F.coalesce("_n", F.lit(0)))
        .withColumn("last_accessed", F.greatest("last_accessed", "_last"))
        .drop("_n", "_last")
    )


def merge_shards(shards: list[DataFrame], key: str = "embedding_id", newest: str = "created_at",
                 tie: str | None = None) -> DataFrame:
    """Rows of several shards as one store; the newest row of an id wins, then the highest `tie`.

    What is left equal is decided by a hash of the row, so the order of the shards does not matter.
    """
    merged = shards[0]
    for shard in shards[1:]:
        merged = merged.unionByName(shard)
    ties = F.struct(*([F.col(tie)] if tie else []), F.xxhash64(*[F.col(c) for c in merged.columns]))
    return latest_per_id(merged.withColumn("_tie", ties), key, newest, "_tie").drop("_tie")


def key_diff(before: DataFrame, after: DataFrame, key: str = "embedding_id") -> DataFrame:
    """Each key of two snapshots as added, removed or common; one pass over the two key sets."""
    sides = before.select(key, F.lit(1).alias("_side")).unionByName(after.select(key, F.lit(2).alias("_side")))
    seen = sides.groupBy(key).agg(F.bit_or("_side").alias("_seen"))
    return seen.select(key, F.element_at(F.array(F.lit("removed"), F.lit("added"), F.lit("common")), F.col("_seen"))
                       .alias("change"))


def content_groups(entries: DataFrame, content: str, key: str) -> DataFrame:
    """Members of each set of entries with the same content, one row per member.

    A set of copies may be very large, so it stays rows: member, content, the set's smallest key and size.
    Hashing the content is the costly part, so the (content, key) pairs are kept and not hashed again.
    """
    members = cut_lineage(entries.select(content, key).distinct())
    sets = members.groupBy(content).agg(F.min(key).alias("representative"), F.count(F.lit(1)).alias("group_size"))
    return members.join(sets, content)


def shard_memory(store: DataFrame, shard: str = "shard", vector: str = "embedding") -> DataFrame:
    """Vector bytes per shard, and the total as the row whose shard is null."""
    sizes = store.select(shard, (F.size(vector).cast("long") * 4).alias("_bytes"))
    return sizes.rollup(shard).agg(F.sum("_bytes").alias("bytes"), F.count(F.lit(1)).alias("entries"))


def index_stats(index: DataFrame, requests: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: entries, dimensions, bytes, requests, hits, hit ratio and status."""
    entries = index.agg(
        F.count(F.lit(1)).alias("embedding_count"),
        F.max(F.size(vector)).alias("embedding_dimensions"),
        F.coalesce(F.sum(F.size(vector).cast("long") * 4), F.lit(0)).alias("index_size_bytes"),
    )
    traffic = requests.agg(
        F.count(F.lit(1)).alias("total_requests"), F.count_if("cache_hit").alias("cache_hits"))
    return one_row(entries, traffic).select(
        "*",
        ratio("cache_hits", F.greatest("total_requests", F.lit(1))).alias("hit_ratio"),
        F.when(F.col("embedding_count") > 0, "healthy").otherwise("degraded").alias("status"))
