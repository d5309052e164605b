"""Pieces that several text operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vectide.session import new_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """`df` written below the shared folder and read again.

    Ends the lineage in files every executor can read, and gives Catalyst the true size, on which it
    chooses between a broadcast and a shuffle for the joins that follow.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: str = "text") -> Column:
    """Tells apart the texts of rows that share a doc_id, or have none; null is not the empty text."""
    return F.xxhash64(F.col(text).isNull(), F.col(text))


def null_safe(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Join on equality that also matches null with null; keeps the left key columns."""
    renamed = right.select([F.col(c).alias(f"__right_{c}" if c in names else c) for c in right.columns])
    on = [F.col(c).eqNullSafe(F.col(f"__right_{c}")) for c in names]
    return left.join(renamed, on, how).drop(*[f"__right_{c}" for c in names])


def first_by_hash(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The first n rows in the order of a hash of `keys`, then of the keys.

    A sorted limit alone has each task send its own first n rows to one task. Rows up to a hash are the first rows of
    all; the cut is widened until it (counted) holds enough of them.
    """
    rows = df.withColumn("__hash", F.xxhash64(*keys))
    share = 2.0 * n / max(rows.count(), 1)
    while share < 1.0:
        near = rows.filter(F.col("__hash") <= int(share * 2.0**64) - 2**63)
        if near.limit(n).count() == n:
            rows = near
            break
        share *= 8
    return rows.orderBy("__hash", *keys).limit(n).drop("__hash")
