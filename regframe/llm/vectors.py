"""Vectors of a table as checked rows and as numpy blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted


def is_valid(vector: Column) -> Column:
    """Neither missing nor holding a missing or non-finite component."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def valid_vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``id, vec`` of valid vectors with an id; of rows that repeat an id the smallest vector."""
    vec = F.col(quoted(vec_col)).cast("array<double>")
    return (table.filter(F.col(quoted(id_col)).isNotNull() & is_valid(vec))
            .select(F.col(quoted(id_col)).cast("long").alias("id"), vec.alias("vec"))
            .groupBy("id").agg(F.min("vec").alias("vec")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of ``width`` doubles; shorter lists are filled with 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == len(column) * width:
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    for i, row in enumerate(column.to_pylist()):
        out[i, :len(row)] = row[:width]
    return out


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()
