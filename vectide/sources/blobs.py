"""Vectors as raw little-endian bytes with a declared element type and shape, and back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from vectide.functions.vectors import float32_bytes

# Element types a blob may declare.
ELEMENT_TYPES = {"float32": "<f4", "float64": "<f8"}


@F.arrow_udf(T.ArrayType(T.FloatType()))
def _from_bytes(blobs: pa.Array, element_types: pa.Array, lengths: pa.Array) -> pa.Array:
    """Null where the bytes do not fit the type and the length. All blobs of one type are read as one buffer."""
    wanted, held = lengths.fill_null(-1).to_numpy(), pc.binary_length(blobs).fill_null(-2).to_numpy()
    good, parts = np.zeros(len(blobs), bool), []
    for name, code in ELEMENT_TYPES.items():
        named = pc.equal(element_types, name).fill_null(False).to_numpy(zero_copy_only=False)
        mine = named & (wanted >= 0) & (wanted <= held) & (held == wanted * np.dtype(code).itemsize)
        good |= mine
        parts.append((mine, code))
    sizes = np.where(good, wanted, 0)
    ends = np.cumsum(sizes)
    flat = np.empty(int(ends[-1]) if len(ends) else 0, np.float32)
    for mine, code in parts:
        chosen = pc.filter(blobs, pa.array(mine))
        if len(chosen):
            offsets = np.frombuffer(chosen.buffers()[1], "<i4")[chosen.offset:chosen.offset + len(chosen) + 1]
            data = np.frombuffer(chosen.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
            flat[np.repeat(mine, sizes)] = np.ascontiguousarray(data).view(code)
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.append(~good, False))
    return pa.ListArray.from_arrays(offsets, pa.array(flat))


def encode_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """Adds `blob`, `element_type` and `shape` and drops the vector."""
    return (
        table.withColumn("blob", float32_bytes(vector))
        .withColumn("element_type", F.lit("float32"))
        .withColumn("shape", F.array(F.size(vector)))
        .drop(vector)
    )


def shape_length(shape: Column) -> Column:
    # -1 where the product is too large for a long: such a shape fits no blob
    return F.coalesce(F.aggregate(shape, F.lit(1).cast("long"), lambda acc, n: F.try_multiply(acc, n.cast("long"))),
                      F.lit(-1).cast("long"))


def decode_vectors(table: DataFrame, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(decoded, quarantine): a blob whose length does not fit its type and shape is set aside, not fatal."""
    tried = table.withColumn(
        vector, _from_bytes("blob", "element_type", shape_length(F.col("shape"))))
    good = tried.filter(F.col(vector).isNotNull()).drop("blob", "element_type", "shape")
    bad = tried.filter(F.col(vector).isNull()).drop(vector)
    return good, bad
