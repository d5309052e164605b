"""The store as Parquet: versioned writes in shard folders, and reads that prune to shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_store(store: DataFrame, base: str, version: int | str, shard: str = "shard") -> str:
    """Writes a full version below `base`, one folder per shard, and returns its path.

    Rows are rebalanced by shard: Spark splits a shard that is larger than the advisory partition size
    and merges small ones, so a hot shard is written by many tasks and files come out of even size. An
    earlier version is never touched; writing the same version again replaces only that one.
    """
    path = f"{base}/version={version}"
    store.hint("rebalance", shard).write.mode("overwrite").partitionBy(shard).parquet(path)
    return path


def read_store(spark: SparkSession, path: str, shards: list[int] | None = None) -> DataFrame:
    """A written version; `shards` prunes to those folders."""
    table = spark.read.parquet(path)
    return table if shards is None else table.filter(table["shard"].isin(shards))
