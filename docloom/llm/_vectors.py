"""Vector columns as whole-number matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Floors beyond this are not used: squares of their differences, and products with each other, would not fit a long.
LARGEST = 1 << 26


def usable(c: Column, factor: int) -> Column:
    """Whether a vector is there, has only finite components, and floors of at most LARGEST."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * factor) > LARGEST)
    return c.isNotNull() & ~F.exists(c, odd)


def width(kept: DataFrame, column: str) -> int:
    """Components of the longest vector; shorter ones are continued by zeros."""
    return kept.agg(F.max(F.size(column))).first()[0] or 0


def floors(column: pa.Array, factor: int, length: int) -> np.ndarray:
    """floor(factor * x) of usable vectors, in double precision, as one row of `length` each."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * factor).astype(np.int64)
    out = np.zeros((len(sizes), length), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out
