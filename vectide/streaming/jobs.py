"""Structured Streaming twins of the batch operators.

Each job takes a streaming DataFrame, an output folder and a checkpoint folder on shared storage and
returns a started query. Micro-batch writers put batch n into its own folder, so a batch that is
run again after a failure replaces its own output and nothing is counted twice.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from vectide.functions.numbers import ratio
from vectide.functions.vectors import usable
from vectide.operators.clusters import route_to_cluster
from vectide.operators.groups import top_per_group
from vectide.operators.lookup import batch_lookup, lookup_with_fallback
from vectide.operators.similarity import ROUTER_THRESHOLD
from vectide.operators.store import accepted_writes
from vectide.sources.commitlog import FOLD_AFTER, StoreLog

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LATE_SECONDS = 3600


def _start(writer: DataStreamWriter, checkpoint: str, once: bool) -> StreamingQuery:
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _batch_folder(out: str, batch: int) -> str:
    return f"{out}/batch={batch:012d}"


def _read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None where there is no folder or no finished file in it."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def read_batches(spark: SparkSession, out: str) -> DataFrame:
    """All micro-batch outputs below a folder, with the batch number."""
    return spark.read.parquet(out)


def stream_hit_rate(requests: DataFrame, out: str, checkpoint: str, seconds: int = 30,
                    late_seconds: int = LATE_SECONDS, once: bool = True) -> StreamingQuery:
    """Hit rate per window, written when the watermark closes the window."""
    rates = (
        requests.withWatermark("ts", f"{late_seconds} seconds")
        .groupBy(F.window("ts", f"{seconds} seconds"))
        .agg(F.count_if("cache_hit").alias("hits"), F.count(F.lit(1)).alias("requests"))
        .select(F.col("window.start").alias("window_start"), "hits", "requests",
                ratio("hits", "requests").alias("hit_rate"))
    )
    writer = rates.writeStream.outputMode("append").format("parquet").option("path", out)
    return _start(writer, checkpoint, once)


def stream_lookup(requests: DataFrame, store: DataFrame | Callable[[SparkSession], DataFrame], out: str, checkpoint: str,
                  vectors: DataFrame | None = None, threshold: float = ROUTER_THRESHOLD,
                  once: bool = True, dim: int | None = None) -> StreamingQuery:
    """Each request with `found` and the model of the stored entry.

    A function for `store` is called for each micro-batch, so that entries written since the start are
    found; a DataFrame is read as it was when it was made. With `vectors`, the query vector per key, a miss
    falls back to the most similar stored entry, and the answer has the columns of `lookup_with_fallback`; requests may
    bring their own threshold and flag, as there. `dim` is the length of the vectors, by default the commonest.
    """

    def write(batch: DataFrame, number: int) -> None:
        current = store(batch.sparkSession) if callable(store) else store
        if vectors is None:
            answers = batch_lookup(batch, current.select("embedding_id", "model_name"))
        else:
            answers = lookup_with_fallback(batch, current, vectors, threshold, dim=dim)
        answers.write.mode("overwrite").parquet(_batch_folder(out, number))

    return _start(requests.writeStream.foreachBatch(write), checkpoint, once)


def stream_upsert(writes: DataFrame, log: StoreLog, place: Callable[[DataFrame], DataFrame], checkpoint: str, dim: int,
                  name: str = "stream", fold_after: int = FOLD_AFTER, once: bool = True) -> StreamingQuery:
    """Valid writes of each micro-batch, newest per id, as a delta in the commit log of the store.

    `place` adds the store's part to the rows. A batch that is run again changes nothing: the log knows the last
    batch of `name`. Every `fold_after` deltas are folded into the parts they touch.
    """

    def write(batch: DataFrame, number: int) -> None:
        good = accepted_writes(batch, dim, log.read().columns)
        log.append(place(good), name, number)
        if len(log.state().deltas) >= fold_after:
            log.fold()

    return _start(writes.writeStream.foreachBatch(write), checkpoint, once)


def stream_route(vectors: DataFrame, labels: list[int], centroids: np.ndarray, out: str, checkpoint: str,
                 once: bool = True) -> StreamingQuery:
    """Incoming vectors with the cluster of the nearest centroid; stateless.

    Vectors of another length than the centroids', or with missing numbers, are not routed.
    """
    good = vectors.filter(usable("embedding", centroids.shape[1]))
    routed = route_to_cluster(good, labels, centroids).select("embedding_id", "cluster")
    return _start(routed.writeStream.outputMode("append").format("parquet").option("path", out), checkpoint, once)


class AccessTotals(StatefulProcessor):
    """Count, first and last access and the newest scores of one part of a key; order of arrival does not matter."""

    def __init__(self, scores: int):
        self.scores = scores

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", "n long, first_us long, last_us long")
        self.recent = handle.getListState("recent", "us long, event_id long, score double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, first, last = self.totals.get() if self.totals.exists() else (0, None, None)
        kept = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []

        def newest(found: list) -> list:
            return heapq.nlargest(self.scores, found, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or 0))

        for row in rows:
            n += 1
            if row.us is not None:
                first = row.us if first is None else min(first, row.us)
                last = row.us if last is None else max(last, row.us)
            if row.similarity_score is not None:
                kept.append((row.us, row.event_id, row.similarity_score))
                if len(kept) >= 10 * self.scores:
                    kept = newest(kept)
        kept = newest(kept)
        self.totals.update((n, first, last))
        if kept:
            self.recent.put(kept)
        yield Row(embedding_id=key[0], part=key[1], access_count=n, first_us=first, last_us=last,
                  recent_us=[r[0] for r in kept], recent_ids=[r[1] for r in kept], recent_scores=[r[2] for r in kept])

    def close(self) -> None:
        pass


TOTALS_SCHEMA = ("embedding_id long, part int, access_count long, first_us long, last_us long, "
                 "recent_us array<long>, recent_ids array<long>, recent_scores array<double>")


def stream_access_stats(log: DataFrame, out: str, checkpoint: str, scores: int = 100, parts: int = 16,
                        once: bool = True) -> StreamingQuery:
    """Running statistics per key, each change as a row; read them with `access_stats_after`.

    Accesses of a key are dealt over `parts`, so a hot key is spread over tasks; its parts are put together
    when they are read. Late and unordered accesses count like all others. Needs the RocksDB state store
    provider.
    """
    lean = log.select(
        "embedding_id", F.pmod(F.coalesce(F.xxhash64("event_id"), F.lit(0)), F.lit(parts)).cast("int").alias("part"),
        F.unix_micros("ts").alias("us"), "event_id", "similarity_score")
    totals = lean.groupBy("embedding_id", "part").transformWithState(
        statefulProcessor=AccessTotals(scores), outputStructType=TOTALS_SCHEMA, outputMode="Append", timeMode="None")
    return _start(totals.writeStream.outputMode("append").format("parquet").option("path", out), checkpoint, once)


def access_stats_after(spark: SparkSession, out: str, scores: int = 100) -> DataFrame:
    """Statistics per key as of the last finished batch, in the form of the batch operator."""
    rows = spark.read.schema(TOTALS_SCHEMA).parquet(out)
    # the count of a part only grows, so its newest row is the one with the highest
    others = [c for c in rows.columns if c not in ("embedding_id", "part")]
    parts = rows.groupBy("embedding_id", "part").agg(
        F.max_by(F.struct(*others), F.col("access_count")).alias("_row")).select("embedding_id", "_row.*")
    counts = parts.groupBy("embedding_id").agg(
        F.sum("access_count").alias("access_count"), F.min("first_us").alias("_first"), F.max("last_us").alias("_last"))
    scored = parts.select("embedding_id", F.explode(F.arrays_zip("recent_us", "recent_ids", "recent_scores")).alias("r"))
    recent = top_per_group(scored, ["embedding_id"], [F.col("r.recent_us").desc(), F.col("r.recent_ids").desc()], scores)
    means = recent.groupBy("embedding_id").agg(F.avg("r.recent_scores").alias("_score"))
    span = (F.col("_last") - F.col("_first")) / 1e6
    return counts.join(means, counts["embedding_id"].eqNullSafe(means["embedding_id"]), "left").select(
        counts["embedding_id"], "access_count", F.timestamp_micros("_last").alias("last_access"),
        F.try_divide(span, F.col("access_count") - 1).alias("average_interval"),
        F.coalesce("_score", F.lit(0.0)).alias("avg_similarity"))


class OrderedAccesses(StatefulProcessor):
    """Numbers the accesses of a key in time order, once the watermark says that none can come before them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "n long, last_us long, timer_ms long")
        self.waiting = handle.getListState("waiting", "us long, event_id long")

    def _pass(self, key, rows: list, watermark_ms: int) -> Iterator[Row]:
        n, last, timer = self.done.get() if self.done.exists() else (0, None, None)
        rows.sort()
        ready = bisect.bisect_right(rows, (watermark_ms * 1000, float("inf")))
        for us, event_id in rows[:ready]:
            n += 1
            yield Row(embedding_id=key[0], event_id=event_id, us=us, access_frequency=n,
                      time_since_last_access=0.0 if last is None else (us - last) / 1e6)
            last = us
        left = rows[ready:]
        if timer is not None and timer > watermark_ms:
            self.handle.deleteTimer(timer)
        timer = None
        if left:
            # the first millisecond at which nothing can come before the first of them
            timer = left[0][0] // 1000 + 1
            self.handle.registerTimer(timer)
            self.waiting.put(left)
        elif self.waiting.exists():
            self.waiting.clear()
        self.done.update((n, last, timer))

    def _held(self) -> list:
        return [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        found = self._held() + [(r.us, r.event_id) for r in rows]
        yield from self._pass(key, found, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._pass(key, self._held(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_access_patterns(log: DataFrame, out: str, checkpoint: str, late_seconds: int = LATE_SECONDS,
                           once: bool = True) -> StreamingQuery:
    """A pattern row per access: its number in its key and the seconds since the access before.

    A row is written when the watermark has passed it, so accesses up to `late_seconds` late are numbered in
    their place; later ones, and those without a time, are left out. A key's order makes its accesses one
    sequence: what waits of a key is at most its accesses of `late_seconds` and one micro-batch, as two numbers
    each. Needs the RocksDB state store provider.
    """
    lean = log.filter(F.col("ts").isNotNull() & F.col("event_id").isNotNull()).withWatermark(
        "ts", f"{late_seconds} seconds").select("embedding_id", "ts", F.unix_micros("ts").alias("us"), "event_id")
    patterns = lean.groupBy("embedding_id").transformWithState(
        statefulProcessor=OrderedAccesses(),
        outputStructType="embedding_id long, event_id long, us long, access_frequency long, time_since_last_access double",
        outputMode="Append", timeMode="EventTime")
    return _start(patterns.writeStream.outputMode("append").format("parquet").option("path", out), checkpoint, once)


class ExpiringEntry(StatefulProcessor):
    """One entry per key; an event-time timer at its expiry emits the key and clears the entry."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "created_us long, expires_ms long")

    def _forget_timer(self) -> None:
        if self.entry.exists():
            old = self.entry.get()[1]
            if old >= 0:
                self.handle.deleteTimer(old)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = None
        for row in rows:
            if newest is None or row.created_us > newest.created_us:
                newest = row
        if newest is not None and not (self.entry.exists() and self.entry.get()[0] > newest.created_us):
            self._forget_timer()
            expires = -1
            if newest.ttl_seconds is not None:
                # the first whole millisecond at which the age is above the TTL
                expires = (newest.created_us + newest.ttl_seconds * 1_000_000) // 1000 + 1
                self.handle.registerTimer(expires)
            self.entry.update((newest.created_us, expires))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        created = self.entry.get()[0]
        self.entry.clear()
        yield Row(embedding_id=key[0], created_us=created, expired_ms=expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def stream_ttl_store(writes: DataFrame, out: str, checkpoint: str, late_seconds: int = LATE_SECONDS,
                     once: bool = True) -> StreamingQuery:
    """Keys as they expire. `writes` has embedding_id, created_at and ttl_seconds; time is event time.

    A write up to `late_seconds` behind the newest of the batches before is stored, an older one is lost;
    expiries are written as much later. Needs the RocksDB state store provider. Of several writes of a key in one micro-batch the newest counts.
    """
    lean = writes.withWatermark("created_at", f"{late_seconds} seconds").select(
        "embedding_id", "created_at", F.unix_micros("created_at").alias("created_us"), "ttl_seconds")
    expired = lean.groupBy("embedding_id").transformWithState(
        statefulProcessor=ExpiringEntry(),
        outputStructType="embedding_id long, created_us long, expired_ms long",
        outputMode="Append", timeMode="EventTime")
    return _start(expired.writeStream.outputMode("append").format("parquet").option("path", out), checkpoint, once)


def refresh_if_stale(spark: SparkSession, path: str, now: int, every_seconds: int,
                     build: Callable[[], DataFrame]) -> DataFrame:
    """The newest table below `path`, built anew when it is older than `every_seconds` at `now` (epoch seconds).

    Call it from any scheduler; it keeps no clock. Earlier tables stay as they are.
    """
    known = _read_if_there(spark, path)
    last = known.agg(F.max("at")).first()[0] if known is not None else None
    if last is None or now - last > every_seconds:
        build().write.mode("overwrite").parquet(f"{path}/at={now}")
        last = now
    return spark.read.parquet(f"{path}/at={last}")
