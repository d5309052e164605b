"""Small numeric expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(_col(a).cast("double"), _col(b).cast("double")), F.lit(0.0))


def age_seconds(newer: Column, older: Column) -> Column:
    return (F.unix_micros(newer) - F.unix_micros(older)) / F.lit(1e6)


def age_hours(newer: Column, older: Column) -> Column:
    return age_seconds(newer, older) / F.lit(3600.0)


def closeness(a: Column | str, b: Column | str) -> Column:
    """1 - |a - b| / max(a, b); null when the larger is 0."""
    a, b = _col(a).cast("double"), _col(b).cast("double")
    return F.lit(1.0) - F.try_divide(F.abs(a - b), F.greatest(a, b))


def hash_bucket(value: Column | str, buckets: int) -> Column:
    """Stable bucket of any value, 0 to buckets - 1."""
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def timestamp(text: str) -> Column:
    return F.lit(text).cast("timestamp")
