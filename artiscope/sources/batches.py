"""Batches of rows between Spark and Python, bounded by rows and by bytes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows, and bytes, that go to Python or come back at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Let the session send rows to Python in small batches, as files are long; what a worker holds is bounded by a batch.

    The setting stays, as what a query returns is computed later; a smaller one of the caller's is left alone.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return free memory of a worker to the machine; else an idle one holds what its last task needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def file_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of all batches, one at a time: only one file is a Python value."""
    for batch in batches:
        for row in zip(*batch.columns):
            yield tuple(x.as_py() for x in row)


def record_batches(rows: Iterator[Sequence], kinds: Sequence[pa.DataType], names: Sequence[str], size: Callable[[Sequence], int] = lambda _: 0) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ``BATCH_ROWS`` rows that end once they hold ``BATCH_BYTES`` by ``size``."""
    held, total = [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=list(names))
    try:
        for row in rows:
            held.append(row)
            total += size(row)
            if len(held) >= BATCH_ROWS or total >= BATCH_BYTES:
                yield make()
                held, total = [], 0
        if held:
            yield make()
    finally:
        give_back()
