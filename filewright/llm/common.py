"""Batches of texts in tasks, what a worker keeps between tasks, and small column helpers."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20  # of text handled at once in a task; only memory depends on it
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))  # A-Z in small letters, all else as it is


def id_bucket(column: str, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; NULL for a NULL id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % buckets


def kept_in_worker(name: str, make: Callable):
    """``make()``, made once in each Python worker and kept for later tasks."""
    module = sys.modules.setdefault("_filewright_worker", types.ModuleType("_filewright_worker"))
    if not hasattr(module, name):
        setattr(module, name, make())
    return getattr(module, name)


def slices(batch: pa.RecordBatch, column: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` in pieces of about ``limit`` bytes of one text column, each of one row at least."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield batch.slice(start)


def map_texts(df: DataFrame, text: str, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], limit: int = BATCH_BYTES) -> DataFrame:
    """Apply ``make()``, called once a task, to pieces of ``df`` of about ``limit`` bytes of the column ``text``."""
    column = df.columns.index(text)

    def run(batches):
        import pyarrow.compute  # noqa: F401

        work = make()
        for batch in batches:
            for piece in slices(batch, column, limit):
                yield work(piece)

    return df.mapInArrow(run, schema)
