"""Vector expressions, Arrow <-> numpy, and sums of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, functions as F

from procspark.functions.arrays import fsum


def dot(a: Column, b: Column) -> Column:
    return fsum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(fsum(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one of them is zero, as in ``unit_rows``."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.when(a.isNotNull() & b.isNotNull(), 0.0))


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def mean_vector(vec: Column, weight: Column | None = None) -> Column:
    """Aggregate: (weighted) mean of array<double>, combined on the map side."""
    v = array_to_vector(vec)
    return vector_to_array(Summarizer.mean(v, weight) if weight is not None else Summarizer.mean(v))


def sum_vector(vec: Column) -> Column:
    """Aggregate: sum of array<double>, combined on the map side."""
    return vector_to_array(Summarizer.sum(array_to_vector(vec)))


def matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column of equal-length vectors -> (rows, dims)."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.chunk(0) if arr.num_chunks else pa.array([], col.type)
    n = len(arr)
    flat = arr.flatten().to_numpy(zero_copy_only=False).astype("float64")
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def list_array(m: np.ndarray) -> pa.ListArray:
    n, d = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d, dtype="int32")),
                                    pa.array(np.ascontiguousarray(m).ravel()))


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero vector stays zero, so its cosine with anything is 0."""
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1.0)
