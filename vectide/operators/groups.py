"""Group-wise building blocks that hold when one group has a large share of all rows.

A plain `partitionBy(key)` window sends a whole key to one task. The functions here cut a key into
blocks, work inside the blocks, and pass what must cross a block border through a small summary.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from vectide.session import cut_lineage

# Width of a time block. A key with a third of 10^12 rows a month has under 8 million of them in a minute,
# and 43,200 blocks a month to chain. Sparse keys have about one row per block at any width.
BLOCK_SECONDS = 60


def time_block(ts: str, block_seconds: int) -> Column:
    """Number of the block of `block_seconds` that the time falls into."""
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(block_seconds * 1_000_000)).cast("long")


def one_row(*frames: DataFrame) -> DataFrame:
    """Frames of one row each, with different columns, as one row; no join is needed for that."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank",
                  spread: int = 32) -> DataFrame:
    """The first k rows of each group in `order`, with their rank.

    Stage one ranks inside `spread` parts of the group and keeps k of each, stage two ranks the
    survivors, so no task sees more than its part of a hot group. For k up to 1,000 Spark also cuts to
    k rows per group before the first shuffle (WindowGroupLimit).
    """
    if spread > 1:
        part = Window.partitionBy(*by, "_part").orderBy(*order)
        df = (
            df.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(spread)))
            .withColumn("_n", F.row_number().over(part))
            .filter(F.col("_n") <= k)
            .drop("_part", "_n")
        )
    whole = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= k)


def with_previous(df: DataFrame, by: str, ts: str, tie: str, carry: list[str],
                  block_seconds: int = BLOCK_SECONDS, position: str = "position", previous: str = "previous",
                  first: str | None = None) -> DataFrame:
    """Adds the running number of each row in its key, a struct of the row before it and, on request,
    the key's first ts.

    Rows are ordered by (ts, tie). Windows run inside (key, time block); the last row and the row count
    of each block travel through a summary of one row per block, so a hot key is spread over its blocks.
    Choose `block_seconds` so that one key's busiest block fits one task. Rows without a key are one key,
    rows without a ts come first in theirs.
    """
    # a struct equals another also where both hold null, and a join on it stays co-located with the window
    blocks = df.withColumn("_by", F.struct(F.col(by).alias("k"))).withColumn(
        "_block", F.coalesce(time_block(ts, block_seconds), F.lit(-(1 << 62))))
    kept = F.struct(*[F.col(c) for c in carry])
    inner = Window.partitionBy("_by", "_block").orderBy(ts, tie)
    local = blocks.select(
        "*",
        F.row_number().over(inner).alias("_local_position"),
        F.lag(kept).over(inner).alias("_local_previous"),
    )
    # the last ts alone is a plain maximum, which a hash aggregate can hold
    last = F.struct(F.max(ts).alias(ts)) if carry == [ts] else F.max_by(kept, F.struct(ts, tie))
    ends = blocks.groupBy("_by", "_block").agg(
        F.count(F.lit(1)).alias("_rows"), last.alias("_last"), F.min(ts).alias("_first"))
    chain = Window.partitionBy("_by").orderBy("_block")
    carried = ends.select(
        "_by", "_block",
        F.sum("_rows").over(chain.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.lag("_last").over(chain).alias("_carried"),
        F.min("_first").over(chain.rowsBetween(Window.unboundedPreceding, 0)).alias("_first"),
    )
    out = (
        local.join(carried, ["_by", "_block"])
        .withColumn(position, F.col("_local_position") + F.coalesce("_before", F.lit(0)))
        .withColumn(previous, F.coalesce("_local_previous", "_carried"))
    )
    if first:
        out = out.withColumn(first, F.col("_first"))
    return out.drop("_by", "_block", "_local_position", "_local_previous", "_before", "_carried", "_first")


def trailing_mean(df: DataFrame, by: str, position: str, value: str, n: int, out: str,
                  block_rows: int = 100_000) -> DataFrame:
    """Mean of `value` over the row and the n - 1 rows before it in its key, in constant work per row.

    `position` numbers the rows of a key from 1 without holes. Rows are cut into chunks of n: a frame that ends in
    a chunk is the chunk's rows up to it and the last rows of the chunk before. Both sums run over unbounded frames,
    one from the left, one from the right, and are added, never subtracted, so a huge or infinite value is gone once
    it has left the frame. A key is also cut into blocks of about `block_rows` rows, whole chunks; each block gets
    copies of the chunk before it. Null and NaN do not count; a frame without a number has no mean.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    block_rows = -(-block_rows // n) * n
    zero_based = F.col(position) - 1
    own = F.floor(zero_based / F.lit(block_rows)).cast("long")
    needed_next = F.pmod(zero_based, F.lit(block_rows)) >= block_rows - n
    clean = F.when(~F.isnan(value), F.col(value).cast("double"))
    copies = df.withColumns({"_own": own, "_chunk": F.floor(zero_based / F.lit(n)).cast("long"), "_value": clean}).withColumn(
        "_block", F.explode(F.when(needed_next, F.array(F.col("_own"), F.col("_own") + 1)).otherwise(F.array(F.col("_own")))))
    chunk, upward = Window.partitionBy(by, "_block", "_chunk"), (Window.unboundedPreceding, 0)
    from_left = chunk.orderBy(position).rowsBetween(*upward)
    from_right = chunk.orderBy(F.col(position).desc()).rowsBetween(*upward)
    summed = copies.withColumns({
        "_right": F.struct(F.sum("_value").over(from_right).alias("sum"), F.count("_value").over(from_right).alias("rows")),
    }).withColumns({
        "_sum": F.sum("_value").over(from_left), "_rows": F.count("_value").over(from_left),
    })
    # the frame of a chunk's last row is the chunk itself
    crosses = F.pmod(zero_based, F.lit(n)) != n - 1
    before = F.when(crosses, F.lag("_right", n - 1).over(Window.partitionBy(by, "_block").orderBy(position)))
    return (
        summed.withColumn("_before", before)
        .withColumn(out, F.try_divide(
            F.coalesce("_sum", F.lit(0.0)) + F.coalesce("_before.sum", F.lit(0.0)),
            F.col("_rows") + F.coalesce("_before.rows", F.lit(0))))
        .filter(F.col("_block") == F.col("_own"))
        .drop("_own", "_block", "_chunk", "_value", "_right", "_sum", "_rows", "_before")
    )


# Bits settled in a round of `order_statistics`: a group has at most 2 ** RADIX_BITS counts in it.
RADIX_BITS = 16
# Values of a group that are put in order as one list; with more left another round follows.
LIST_ROWS = 10_000


def _sortable(value: str) -> Column:
    """The bits of a double as a long that sorts like it; -0.0 counts as 0.0."""

    @F.arrow_udf("long")
    def bits(values: pa.Array) -> pa.Array:
        raw = (values.to_numpy(zero_copy_only=False) + 0.0).view(np.int64)
        return pa.array(raw ^ ((raw >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))

    return bits(value)


def order_statistics(df: DataFrame, value: str, shares: dict[str, float], by: list[str],
                     extra: list[Column] | None = None, list_rows: int = LIST_ROWS) -> DataFrame:
    """Exact order statistics: for each group the value at 0-based index floor(share * n), the last one for share 1.

    Null and NaN do not count; a group without a value has no row, an empty table without groups one of nulls.
    `extra` are aggregates over the group's rows with a value.

    Radix selection on the bits of the doubles. A round counts the rows by their next RADIX_BITS bits, combined
    before the shuffle, and keeps for each share the one prefix that holds its index. At most four rounds
    settle all bits; earlier, a prefix of up to `list_rows` rows (counted) is put in order as a list. No group is
    sorted whole, and no task holds more of one than its counts.
    """
    clean = df.withColumn("_value", F.col(value).cast("double")).filter(F.col("_value").isNotNull() & ~F.isnan("_value"))
    # a struct equals another also where both hold null
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("none"))
    rows = clean.select(group.alias("_g"), "_value").withColumn("_bits", _sortable("_value"))
    shift = 64 - RADIX_BITS
    counts = cut_lineage(rows.groupBy("_g", F.shiftright("_bits", shift).alias("_prefix")).agg(F.count(F.lit(1)).alias("_rows")))
    sizes = counts.groupBy("_g").agg(F.sum("_rows").alias("_n"))
    index = F.array(*[F.struct(F.lit(name).alias("name"), F.least(
        F.floor(F.lit(share) * F.col("_n")).cast("long"), F.col("_n") - 1).alias("index")) for name, share in shares.items()])
    wanted = sizes.select("_g", F.explode(index).alias("_w")).select("_g", "_w.name", "_w.index")
    run = Window.partitionBy("_g", "name").orderBy("_prefix").rowsBetween(Window.unboundedPreceding, 0)
    while True:
        reached = (counts.join(wanted, "_g") if "name" not in counts.columns else counts.join(wanted, ["_g", "name"])).withColumn(
            "_upto", F.sum("_rows").over(run))
        # at most one row for each group and share
        wanted = cut_lineage(reached.filter((F.col("_upto") > F.col("index")) & (F.col("_upto") - F.col("_rows") <= F.col("index"))).select(
            "_g", "name", (F.col("index") - F.col("_upto") + F.col("_rows")).alias("index"), "_prefix", "_rows"))
        inside = rows.withColumn("_prefix", F.shiftright("_bits", shift)).join(
            wanted.select("_g", "_prefix", "name"), ["_g", "_prefix"]).drop("_prefix")
        most = wanted.agg(F.max("_rows")).first()[0] or 0
        if most <= list_rows or not shift:
            break
        shift -= RADIX_BITS
        counts = inside.groupBy("_g", "name", F.shiftright("_bits", shift).alias("_prefix")).agg(F.count(F.lit(1)).alias("_rows"))
        wanted = wanted.drop("_prefix", "_rows")
    if shift:
        found = inside.groupBy("_g", "name").agg(F.array_sort(F.collect_list("_value")).alias("_values")).join(
            wanted, ["_g", "name"]).select("_g", "name", F.get("_values", F.col("index").cast("int")).alias("_value"))
    else:  # all bits are settled, so the rows of a prefix are one value
        found = inside.groupBy("_g", "name").agg(F.min("_value").alias("_value"))
    picked = found.groupBy("_g").agg(*[F.max(F.when(F.col("name") == name, F.col("_value"))).alias(name) for name in shares])
    if not by:
        picked = picked.agg(*[F.max(name).alias(name) for name in shares])
        return one_row(picked, clean.agg(*extra)) if extra else picked
    if extra:
        totals = clean.groupBy(group.alias("_g")).agg(*extra)
        picked = picked.join(totals, "_g")
    return picked.select(*[F.col(f"_g.{c}") for c in by], *[c for c in picked.columns if c != "_g"])


def newest(df: DataFrame, ts: str, tie: str, n: int, block_seconds: int = 3600) -> DataFrame:
    """The n newest rows by (ts, tie).

    Row counts per time block (a small aggregate) give a lower bound for ts; as a literal it is pushed
    to the scan, so the final top-n only sees the newest blocks.
    """
    counts = df.groupBy(time_block(ts, block_seconds).alias("_block")).agg(F.count(F.lit(1)).alias("_rows"))
    newer = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        counts.withColumn("_newer", F.coalesce(F.sum("_rows").over(newer), F.lit(0)))
        .filter(F.col("_newer") < n).agg(F.min("_block")).first()[0]
    )
    if cut is not None:
        df = df.filter(F.col(ts) >= F.timestamp_micros(F.lit(cut * block_seconds * 1_000_000)))
    return df.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)
