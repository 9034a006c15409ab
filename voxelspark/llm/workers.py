"""Python workers live on after a task and work for the next operator: what a task needed is given back at its end."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows of an Arrow batch of texts, at most: some texts are very long.
BATCH_ROWS = 2000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def text_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless smaller ones are set already."""
    if not 0 < int(spark.conf.get(_ROWS, "10000")) <= BATCH_ROWS:
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def release() -> None:
    """Give unused memory back to the system: Arrow's pool and, where the C library can, the heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, releasing memory when its task ends."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
