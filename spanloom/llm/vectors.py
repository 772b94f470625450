"""Vectors as integer rows: which take part, and their matrices within Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vectors: DataFrame, vector_column: str) -> DataFrame:
    """The rows whose vector is there and holds neither null nor a non-finite component; the vector as doubles."""
    rows = vectors.withColumn(vector_column, F.transform(F.col(vector_column), lambda e: e.cast("double")))
    bad = F.exists(vector_column, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return rows.filter(F.col(vector_column).isNotNull() & ~bad)


def floors(vector: Column, scale: int, shift: int = 0) -> Column:
    """floor(scale * x) + shift of each component, as long."""
    return F.transform(vector, lambda e: F.floor(F.lit(float(scale)) * e).cast("long") + F.lit(shift).cast("long"))


def by_length(batch: pa.RecordBatch, column: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix of longs) for each length of the lists of a column without nulls."""
    lists = batch.column(column)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    begin = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, flat.reshape(-1, size) if len(rows) == len(sizes) and size else flat[begin[rows][:, None] + np.arange(size)[None, :]]
