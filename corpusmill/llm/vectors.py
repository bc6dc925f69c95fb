"""Helpers for embedding columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> Column:
    """True for vectors that are neither null nor empty and hold only finite numbers."""
    v = F.col(column)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad, F.lit(False))


def matrix(column: pa.Array, dtype: type) -> np.ndarray:
    """Rows of a list column that all have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(dtype, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype)


def doubles(df: DataFrame, column: str = "embedding") -> Column:
    return F.col(column).cast("array<double>")
