"""Arrow batches inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it


def release() -> None:
    """Give memory that is free in this worker back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def bounded(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts have at most `limit` bytes together, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        i, done = 0, 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(i, j - i)
            i, done = j, int(ends[j - 1])
        release()
    release()


@contextmanager
def short_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Jobs that run inside pass at most `rows` rows at once to Python; executors and workers both hold a whole batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
