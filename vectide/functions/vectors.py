"""Vector expressions over ARRAY<FLOAT> columns, accumulated in double."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; null when the lengths differ."""
    products = F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def l2_norm(v: Column | str) -> Column:
    squares = F.transform(_col(v), lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, p: acc + p))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null for a zero vector, a NaN element or unequal lengths."""
    value = F.try_divide(dot(a, b), l2_norm(a) * l2_norm(b))
    return F.when(~F.isnan(value), value)


def distance_to_similarity(distance: Column | str) -> Column:
    return F.lit(1.0) - _col(distance)


def vector_bytes(v: Column | str) -> Column:
    """Size of a float32 vector in bytes."""
    return F.size(_col(v)).cast("long") * F.lit(4)


def usable(v: Column | str, dim: int | None = None) -> Column:
    """True for a vector that can take part in a cosine: right length, no null element."""
    v = _col(v)
    whole = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull())
    return whole if dim is None else whole & (F.size(v) == dim)


def dense(column: pa.Array) -> np.ndarray:
    """A list<float> Arrow column as an (n, d) double matrix; raises where lengths differ."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) and (np.diff(column.offsets.to_numpy()) != len(column[0])).any():
        raise ValueError("vectors of different lengths in one column")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a zero row becomes NaN and so matches nothing."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


@F.arrow_udf(T.BinaryType())
def float32_bytes(vectors: pa.Array) -> pa.Array:
    """The little-endian float32 bytes of each vector, null for null; a null element is NaN. No loop over rows."""
    flat = vectors.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).astype("<f4")
    ends = 4 * pc.list_value_length(vectors).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    offsets = np.concatenate([[0], ends]).astype("<i4")
    packed = pa.Array.from_buffers(pa.binary(), len(vectors), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
    return pc.if_else(vectors.is_valid(), packed, pa.scalar(None, pa.binary())) if vectors.null_count else packed
