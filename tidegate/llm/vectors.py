"""Vectors as arrays of single-precision numbers, and measures on them in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null or empty, not zero, and all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equally long lists, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def norms(x: np.ndarray) -> np.ndarray:
    """Lengths, each from its own row alone, whatever rows stand beside it."""
    return np.sqrt((x * x).sum(axis=1))


def cosine(x: np.ndarray, y: np.ndarray, x_norm: np.ndarray, y_norm: np.ndarray) -> np.ndarray:
    """Cosine of row i of ``x`` with row i of ``y``."""
    return (x * y).sum(axis=1) / (x_norm * y_norm)
