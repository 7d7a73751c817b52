"""Vectors as whole numbers: what the exact operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * c) of each component c as a double, as longs (beyond their range: the nearest long)."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))))


def usable(vector: Column) -> Column:
    """Not null, and every component a finite number."""
    number = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, number)


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, x) of the rows with a usable vector."""
    return rows.where(usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vec_col), scale).alias("x"))


def matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """A list column as rows of int64; shorter vectors end in zeros, as if they had the width of the longest (or width)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width, int(length.max(initial=0)))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (length == width).all():
        return flat.reshape(len(length), width)
    out = np.zeros((len(length), width), np.int64)
    out[np.arange(width) < length[:, None]] = flat
    return out


def largest(x: np.ndarray) -> int:
    """The largest absolute value, as a Python integer (that of the least long has no int64)."""
    return max(-int(x.min()), int(x.max())) if x.size else 0
