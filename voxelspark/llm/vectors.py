"""What both vector operators need: usable rows, classes of equal vectors, and Arrow to numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Not null, not empty, not zero, every component present and finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def plain(df: DataFrame, vector: str) -> Column:
    """The vector as array<float> if it is that, else as array<double>."""
    return F.col(vector).cast("array<float>" if df.schema[vector].dataType.simpleString() == "array<float>" else "array<double>")


def rows_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id, vector`` of usable rows with an id."""
    return df.select(F.col(id_col).cast("long").alias("id"), plain(df, vector_col).alias("vector")).where(usable("vector") & F.col("id").isNotNull())


def by_length(rows: DataFrame) -> list[DataFrame]:
    """``rows`` of each length of vector that occurs, shortest first: vectors of different lengths can't be compared."""
    lengths = sorted(r[0] for r in rows.select(F.size("vector")).distinct().collect())
    return [rows.where(F.size("vector") == d) for d in lengths] if len(lengths) > 1 else [rows] * len(lengths)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1) if n else np.zeros((0, 0))
