"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelweave.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str):
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """The texts of an Arrow column; a null counts as an empty text."""
    return [t if t is not None else "" for t in column.to_pylist()]


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of documents that no label may be learned from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


_HELD: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], object]):
    """What this Python worker keeps from task to task, one thing at a time: what another operator kept goes first."""
    if key not in _HELD:
        _HELD.clear()
        trim()
        _HELD[key] = make()
    return _HELD[key]


def trim() -> None:
    """Give free memory back to the machine: a worker lives on, and what a task has freed would stay its own."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def crc32_of(ids: bytes) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF


def batches(source: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most `rows` rows, so that Python never holds more texts than that."""
    for batch in source:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    trim()


def with_bases(totals: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """totals plus the exclusive prefix sum of `value` in ascending `order`.

    One row a partition comes in, never one a document, so the single-task window stays small.
    """
    from pyspark.sql import Window

    window = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(value).over(window), F.lit(0)).cast("long"))


def exclusive_cumsum(values: np.ndarray, start: int) -> np.ndarray:
    out = np.empty(len(values), np.int64)
    if len(values):
        out[0] = start
        np.cumsum(values[:-1], out=out[1:])
        out[1:] += start
    return out
