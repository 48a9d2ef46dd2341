"""Helpers for tables of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> Column:
    """Whether the vector is not null, not empty, not zero and holds only finite numbers."""
    finite = F.forall(column, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(finite & (F.size(column) > 0) & F.exists(column, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equally long vectors as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; equal vectors get equal values wherever they stand."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def sample(rows: DataFrame, limit: int, count: int) -> np.ndarray:
    """Unit vectors of about ``limit`` of ``count`` rows at most, picked by a hash of the vector."""
    draw = F.xxhash64("embedding").bitwiseAND(0x7FFFFFFF)
    picked = rows.filter(draw < int(min(1.0, limit / max(count, 1)) * (1 << 31))).select(F.col("embedding").cast("array<double>")).toArrow()
    x = matrix(picked.column(0))
    return unit(x[np.lexsort(x.T)]) if len(x) else x
