"""Integer vectors of an embedding column, as tasks and whole-table statistics need them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Not null, not empty, and every entry a finite number."""
    finite = F.forall(vector, lambda v: F.coalesce(F.abs(v.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def common_length(vectors: DataFrame, column: str) -> int:
    """The length that most rows have, the smaller one of a tie; 0 without rows."""
    lengths = vectors.groupBy(F.size(column).alias("length")).agg(F.count(F.lit(1)).alias("n"))
    found = lengths.orderBy(F.desc("n"), "length").limit(1).collect()
    return found[0]["length"] if found else 0


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The rows of a list column without nulls, all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def lists(rows: np.ndarray) -> pa.Array:
    """A list column from a matrix."""
    n, dim = rows.shape
    offsets = pa.array(np.arange(0, (n + 1) * dim, dim) if dim else np.zeros(n + 1), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(rows).reshape(-1)))
