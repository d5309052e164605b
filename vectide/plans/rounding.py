"""Rounding that both engines agree on.

Means of decimal values often lie half-way between two rounded numbers, where the last bit decides. A
nudge far below the kept digits sends all of them up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def nudged(value: Column | str, digits: int) -> Column:
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value + F.lit(10.0 ** -(digits + 3)), digits)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, nudged(c, digits))
    return df

