"""What the vector operators share: which vectors count, and vectors of an Arrow column as a matrix."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def usable(column: str) -> Column:
    """True for vectors with components, none of them NULL, NaN or infinite."""
    x = F.col(column)
    broken = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.coalesce((F.size(x) > 0) & ~broken, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows as doubles; all rows must have ``width`` components."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
