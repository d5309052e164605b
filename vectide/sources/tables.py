"""Readers for the input tables, with declared schemas where types need it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# `ts` is stored without a zone; declared as TIMESTAMP it is read as UTC and filters on it reach the scan
EVENTS_SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read.schema(EVENTS_SCHEMA) if name == "events" else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The table as a stream, be it one file or a folder of part files.

    A streaming path must be a folder or a pattern, and the part files of a folder do not bear the table's name.
    """
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parque[t]")


def load_store(table: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Stored rows whose vector has the expected dimension."""
    return table.filter(F.size(vector) == dim)
