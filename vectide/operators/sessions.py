"""Session views of the access log: likely next keys, drift, and compute saved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vectide.functions.numbers import ratio
from vectide.functions.vectors import cosine
from vectide.operators.groups import BLOCK_SECONDS, time_block, top_per_group, with_previous
from vectide.session import cut_lineage


def session_steps(log: DataFrame, gap_seconds: int, user: str = "user_id",
                  block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """Accesses with `previous_key` (null at a session start) and `session_start`.

    A session of a user ends where nothing follows for `gap_seconds`. Inside (user, time block) windows
    see all but the block's border; one summary row per block carries the last access and the latest
    session start over it.
    """
    gap = gap_seconds * 1_000_000

    def apart(later: str, earlier: str) -> Column:
        return F.unix_micros(F.col(later)) - F.unix_micros(F.col(earlier)) > gap

    order = Window.partitionBy(user, "_block").orderBy("ts", "event_id")
    here = F.struct(F.col("ts"), F.col("embedding_id"))
    local = (
        log.withColumn("_block", time_block("ts", block_seconds))
        .withColumn("_before", F.lag(here).over(order))
        .withColumn("_start", F.when(apart("ts", "_before.ts"), F.col("ts")))
    )
    ends = local.groupBy(user, "_block").agg(
        F.min("ts").alias("_first"), F.max("_start").alias("_latest"),
        F.max_by(here, F.struct("ts", "event_id")).alias("_last"))
    chain = Window.partitionBy(user).orderBy("_block")
    opened = (
        ends.withColumn("_carried", F.lag("_last").over(chain))
        .withColumn("_opens", F.col("_carried").isNull() | apart("_first", "_carried.ts"))
        .withColumn("_opened", F.when(F.col("_opens"), F.col("_first")))
    )
    carried = opened.select(
        user, "_block", "_carried", "_opens",
        # the latest start known at the block's first access
        F.greatest("_opened", F.max(F.greatest("_opened", "_latest")).over(
            chain.rowsBetween(Window.unboundedPreceding, -1))).alias("_known"))
    first_of_block = F.col("_before").isNull()
    return (
        local.withColumn("_running", F.max("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .join(carried, [user, "_block"])
        .withColumn("previous_key", F.when(first_of_block, F.when(~F.col("_opens"), F.col("_carried.embedding_id")))
                    .when(F.col("_start").isNull(), F.col("_before.embedding_id")))
        .withColumn("session_start", F.coalesce("_running", "_known"))
        .drop("_block", "_before", "_start", "_running", "_carried", "_opens", "_known")
    )


def next_key_ngram(log: DataFrame, gap_seconds: int, top: int = 3, user: str = "user_id") -> DataFrame:
    """For each key the keys that most often follow it within a session, with their share."""
    rows = with_previous(log, user, "ts", "event_id", ["ts", "embedding_id"])
    within = F.unix_micros("ts") - F.unix_micros("previous.ts") <= gap_seconds * 1_000_000
    # one row per pair of keys; kept, since both the best pairs and the totals come from it
    counts = cut_lineage(rows.filter(within).groupBy(
        F.col("previous.embedding_id").alias("embedding_id"), F.col("embedding_id").alias("next_key")
    ).agg(F.count(F.lit(1)).alias("follows")))
    totals = counts.groupBy("embedding_id").agg(F.sum("follows").alias("_total"))
    best = top_per_group(counts, ["embedding_id"], [F.col("follows").desc(), F.col("next_key")], top)
    return best.join(totals, "embedding_id").withColumn("share", ratio("follows", "_total")).drop("_total")


def context_steps(log: DataFrame, gap_seconds: int, n: int, user: str = "user_id") -> DataFrame:
    """Accesses with `context`: the up to n keys before it in its session, the last one first.

    Each round carries one key more over from the access before, so a context of n keys takes n rounds of blocked
    windows and no window holds more than a block.
    """
    rows, none = log, F.array().cast(f"array<{dict(log.dtypes)['embedding_id']}>")
    for k in range(n):
        carry = ["ts", "embedding_id"] + (["context"] if k else [])
        stepped = with_previous(rows, user, "ts", "event_id", carry)
        within = F.unix_micros("ts") - F.unix_micros("previous.ts") <= gap_seconds * 1_000_000
        longer = F.array("previous.embedding_id") if not k else F.concat(F.array("previous.embedding_id"), "previous.context")
        rows = stepped.withColumn("context", F.when(F.coalesce(within, F.lit(False)), F.slice(longer, 1, n)).otherwise(none)).drop(
            "previous", "position")
    return rows


def backoff_model(steps: DataFrame, n: int, top: int = 3, least: int = 2, discount: float = 0.5) -> DataFrame:
    """(context, next_key, follows, total, rank, share) for every context of 1 to n keys that occurs `least` times.

    The `top` keys that most often follow, with the share of follows left after an absolute discount; what the
    discount takes belongs to shorter contexts. A single key keeps its row however rare, as nothing is shorter.
    """
    contexts = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: F.slice("context", F.lit(1), k))
    grams = steps.filter(F.size("context") > 0).select(
        F.explode(F.array_distinct(contexts)).alias("context"), F.col("embedding_id").alias("next_key"))
    # one row per context and key; kept, since both the best keys and the totals come from it
    counts = cut_lineage(grams.groupBy("context", "next_key").agg(F.count(F.lit(1)).alias("follows")))
    totals = counts.groupBy("context").agg(F.sum("follows").alias("total")).filter(
        (F.col("total") >= least) | (F.size("context") == 1))
    best = top_per_group(counts, ["context"], [F.col("follows").desc(), F.col("next_key")], top)
    return best.join(totals, "context").withColumn("share", (F.col("follows") - F.lit(discount)) / F.col("total"))


def predict_next(histories: DataFrame, model: DataFrame, n: int, by: list[str]) -> DataFrame:
    """(by, context_length, next_key, rank, share) for each history, from the longest of its contexts in the model.

    `histories` has `context` with the last key first; `by` tells its rows apart. A history whose last key is not in
    the model has no row.
    """
    contexts = F.transform(F.sequence(F.lit(1), F.least(F.lit(n), F.size("context"))), lambda k: F.slice("context", F.lit(1), k))
    asked = histories.filter(F.size("context") > 0).select(*by, F.explode(contexts).alias("context"))
    known = asked.join(model.select("context").distinct(), "context")
    longest = known.groupBy(*by).agg(F.max_by("context", F.size("context")).alias("context"))
    return longest.join(model, "context").select(*by, F.size("context").alias("context_length"), "next_key", "rank", "share")


def session_drift(log: DataFrame, vectors: DataFrame, gap_seconds: int, user: str = "user_id") -> DataFrame:
    """Mean cosine between neighbouring accesses of a session; null for sessions of one access.

    The cosine is computed once per distinct pair of neighbouring keys, not once per access.
    """
    steps = session_steps(log, gap_seconds, user)
    pairs = cut_lineage(steps.groupBy(user, "session_start", "previous_key", "embedding_id").agg(
        F.count(F.lit(1)).alias("_n")))
    lean = vectors.select("embedding_id", "embedding")
    distinct = pairs.filter(F.col("previous_key").isNotNull()).select("previous_key", "embedding_id").distinct()
    left = lean.select(F.col("embedding_id").alias("previous_key"), F.col("embedding").alias("_before"))
    cosines = distinct.join(lean, "embedding_id").join(left, "previous_key").select(
        "previous_key", "embedding_id", cosine("_before", "embedding").alias("_cosine"))
    return pairs.join(cosines, ["previous_key", "embedding_id"], "left").groupBy(user, "session_start").agg(
        F.sum("_n").alias("accesses"),
        F.try_divide(F.sum(F.col("_cosine") * F.col("_n")),
                     F.sum(F.when(F.col("_cosine").isNotNull(), F.col("_n")))).alias("mean_similarity"))


def compute_saved(requests: DataFrame, seconds_per_embedding: float, by: list[str]) -> DataFrame:
    """Compute seconds saved by hits, in total and per lookup."""
    return requests.groupBy(*by).agg(
        F.count(F.lit(1)).alias("lookups"), F.count_if("cache_hit").alias("hits"),
    ).withColumn("seconds_saved", F.col("hits") * F.lit(seconds_per_embedding)).withColumn(
        "seconds_saved_per_lookup", ratio("seconds_saved", "lookups"))
