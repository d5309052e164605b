"""Hit and miss labels under a time-to-live that starts at the miss and is not extended by hits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vectide.operators.groups import top_per_group
from vectide.session import cut_lineage


def _walk(times: np.ndarray, ttl: int, reach: int, held_until: np.ndarray | None = None) -> tuple[list[int], int, bool]:
    """(positions of the misses in sorted `times` after `reach`, how far they reach, whether the walk is done).

    A miss at t covers all accesses up to t + ttl. `held_until[i]` is the end of the time after row i in
    which rows may have been left out (0: none): if the next miss could be one of those, the walk stops.
    """
    misses: list[int] = []
    while True:
        i = int(np.searchsorted(times, reach, side="right"))
        if held_until is not None and i > 0 and reach < held_until[i - 1]:
            return misses, reach, False
        if i == len(times):
            return misses, reach, True
        misses.append(i)
        reach = int(times[i]) + ttl


def _sorted(table: pa.Table, tie: str) -> pa.Table:
    return table.sort_by([("_t", "ascending"), (tie, "ascending")])


def _label_whole_keys(timed: DataFrame, key: str, tie: str, ttl: int) -> DataFrame:
    """All rows of a key in one group; every column passes through as Arrow."""

    def label(table: pa.Table) -> pa.Table:
        table = _sorted(table, tie)
        # rows without a time come last
        timed_rows = len(table) - table.column("_t").null_count
        times = table.column("_t").slice(0, timed_rows).to_numpy()
        hit = np.arange(len(table)) < timed_rows
        if timed_rows:
            hit[_walk(times, ttl, int(times[0]) - 1)[0]] = False
        return table.drop_columns(["_t"]).append_column("cache_hit", pa.array(hit))

    fields = [f"`{name}` {kind}" for name, kind in timed.dtypes if name != "_t"]
    return timed.groupBy(key).applyInArrow(label, ", ".join([*fields, "cache_hit boolean"]))


def _round_of(ttl: int, kept: int, max_spans: int, key: str, tie: str):
    """One key's kept rows: its misses, and a row without a tie whose `_front` says where to go on."""

    def walk(table: pa.Table) -> pa.Table:
        table = _sorted(table, tie)
        times, spans = table.column("_t").to_numpy(), table.column("_span").to_numpy()
        front, until = table.column("_front")[0].as_py(), table.column("_until")[0].as_py()
        ends = np.append(spans[1:] != spans[:-1], True)
        sizes = np.diff(np.append(-1, np.flatnonzero(ends)))
        full = np.repeat(sizes >= kept, sizes)
        held = np.where(ends & full, front + (spans + 1) * ttl, 0)
        misses, reach, done = _walk(times, ttl, front, held)
        horizon = front + max_spans * ttl
        if done:
            # all rows up to the horizon are settled; go on behind it if the key has more
            reach, done = max(reach, horizon), until <= max(reach, horizon)
        found = table.select([key, tie, "_t"]).take(pa.array(misses, pa.int64())).append_column(
            "_front", pa.nulls(len(misses), pa.int64()))
        if done:
            return found
        rest = pa.table([table.column(key).slice(0, 1), pa.nulls(1, table.schema.field(tie).type),
                         pa.nulls(1, pa.int64()), pa.array([reach], pa.int64())], names=found.schema.names)
        return pa.concat_tables([found, rest])

    return walk


def _join(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on equality that also matches null with null; keeps the left key columns."""
    renamed = right.select([F.col(c).alias(f"_r_{c}" if c in names else c) for c in right.columns])
    same = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in names]
    return left.join(renamed, same, how).drop(*[f"_r_{c}" for c in names])


def _misses_in_rounds(timed: DataFrame, key: str, tie: str, ttl: int, kept: int, max_spans: int) -> DataFrame:
    """(key, tie, _t) of all misses of keys with more rows than one group may hold.

    Time after a key's front is cut into spans of one TTL; at most one miss falls into a span. A round
    walks the `kept` earliest rows of each of the next `max_spans` spans. A key whose walk needs a later
    row, or has rows behind those spans, goes into another round that starts where this one stopped.
    """
    lean = timed.select(key, tie, "_t")
    types = dict(lean.dtypes)
    schema = f"`{key}` {types[key]}, `{tie}` {types[tie]}, `_t` bigint, `_front` bigint"
    ahead, misses = lean, None
    while True:
        # spans start right before the key's next access, however far off that is
        front = ahead.groupBy(key).agg((F.min("_t") - 1).alias("_front"), F.max("_t").alias("_until"))
        spans = (
            _join(lean, front, [key]).filter(F.col("_t") > F.col("_front"))
            .withColumn("_span", F.floor((F.col("_t") - F.col("_front") - 1) / F.lit(ttl)).cast("long"))
            .filter(F.col("_span") < max_spans)
        )
        earliest = top_per_group(spans, [key, "_span"], [F.col("_t"), F.col(tie)], kept).drop("rank")
        walk = _round_of(ttl, kept, max_spans, key, tie)
        found = cut_lineage(earliest.groupBy(key).applyInArrow(walk, schema))
        part = found.filter(F.col("_front").isNull()).select(key, tie, "_t")
        misses = part if misses is None else misses.unionByName(part)
        rest = found.filter(F.col("_front").isNotNull()).select(key, "_front")
        if rest.isEmpty():
            return misses
        ahead = _join(lean, rest, [key]).filter(F.col("_t") > F.col("_front")).select(lean.columns)


def ttl_hits(log: DataFrame, key: str = "embedding_id", ts: str = "ts", tie: str = "event_id",
             ttl_seconds: int = 3600, rows_per_key: int = 1_000_000, kept_per_span: int = 1000,
             max_spans: int = 1000) -> DataFrame:
    """Adds `cache_hit`: false for the access that loads the key, true until the load is older than the TTL.

    An access at exactly the TTL still hits; one without a time is a miss that loads nothing. Rows without
    a key are one key; `tie` is unique among the rows of a key. The walk from load to load is sequential, so
    a key's rows meet in one group, unless it has more than `rows_per_key` (counted first, combined before
    the shuffle). The misses of those keys alone are found in rounds over the earliest rows of each TTL-long
    span, `kept_per_span` x `max_spans` of a key at a time; the labels are the same.
    """
    ttl = ttl_seconds * 1_000_000
    timed = log.withColumn("_t", F.unix_micros(F.col(ts)))
    # at most one row per `rows_per_key` rows of the log
    hot = cut_lineage(
        log.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > rows_per_key).select(key))
    if hot.isEmpty():
        return _label_whole_keys(timed, key, tie, ttl)
    crowded = _join(timed, hot, [key], "left_semi")
    misses = _misses_in_rounds(crowded, key, tie, ttl, kept_per_span, max_spans)
    labelled = (
        _join(crowded, misses.withColumn("_miss", F.lit(True)), [key, tie, "_t"], "left")
        .withColumn("cache_hit", F.col("_miss").isNull() & F.col("_t").isNotNull())
        .drop("_miss", "_t")
    )
    return labelled.unionByName(_label_whole_keys(_join(timed, hot, [key], "left_anti"), key, tie, ttl))
