"""What operators on embeddings share: which vectors take part, and their rows as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(vector: Column, scale: float = 1.0) -> Column:
    """Whether a vector holds entries, and all of them, times ``scale``, are finite numbers; never null."""
    sound = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < float("inf")))
    return F.coalesce((F.size(vector) > 0) & sound, F.lit(False))


def usual_dimension(rows: DataFrame, vector: str) -> int | None:
    """The most frequent length of the vectors, the larger one of two; None without rows."""
    sizes = rows.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return most and most["d"]


def matrix(column: pa.Array | pa.ChunkedArray, dimension: int) -> np.ndarray:
    """Lists of one length, without nulls, as the rows of a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)
