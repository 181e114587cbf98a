"""Memory of Python workers, which Spark keeps for the tasks that follow.

Batches sent to them are bounded in bytes, since rows hold whole texts of any length: a batch of the default 10,000
rows is held once by the JVM outside its heap and once by the worker. What a task frees stays with the allocators
unless it is handed back, so each stage of a pipeline would add its own peak to the worker's size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import SparkSession

#: A batch ends with the row that passes this; rows are never cut.
BATCH_BYTES = 4 << 20
_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches of this session, where it sets no bound of its own."""
    if spark.conf.get(_SETTING, None) is None:
        spark.conf.set(_SETTING, BATCH_BYTES)


def hand_back() -> None:
    """Returns freed memory to the system, as far as the C library can."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """work, handing freed memory back at the end of each task."""

    @wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            hand_back()

    return run
