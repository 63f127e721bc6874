"""Shared pieces of the operators over a table of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DIM = 64  # components of a vector; others have no distance or product with these
SCALE = 256  # a component x becomes the whole number floor(SCALE * x)


def usable(vector: str, dim: int) -> Column:
    """True for a vector of exactly ``dim`` components, all there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & finite, F.lit(False))


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column as a matrix of doubles, one row each."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def whole_numbers(vectors: np.ndarray, limit: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of every component; a component beyond ``limit`` raises ValueError, as 64 bits would not hold its results."""
    found = np.floor(vectors * float(scale))
    if len(found) and np.abs(found).max() > limit:
        raise ValueError(f"a component times {scale} is beyond {limit}: results would not fit 64 bits")
    return found.astype(np.int64)


def pack(matrix: np.ndarray, kind: str) -> pa.Array:
    """Each row as the bytes of its values, little-endian, of numpy type ``kind``."""
    flat = np.ascontiguousarray(matrix, dtype=kind)
    width = flat.shape[1] * flat.dtype.itemsize
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(flat), [None, pa.py_buffer(flat.tobytes())])
    return fixed.cast(pa.binary())


def unpack(column: pa.Array | pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    """The matrix that ``pack`` wrote, ``width`` values a row."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)
