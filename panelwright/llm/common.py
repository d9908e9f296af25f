"""Small helpers the training-data operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.session import work_folder

# Java and RE2 spelling of the white space that separates words.
GAP = r"[\x20\x09-\x0D]+"
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def whole_text(name: str = "text") -> Column:
    """The text of a row; a missing one is empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP, -1), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_digest(text: Column) -> Column:
    """Sixteen bytes that stand for a text."""
    return F.unhex(F.md5(text.cast("binary")))


@contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go as soon as their query has ended."""
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP_KEY)
        else:
            spark.conf.set(CLEANUP_KEY, before)


class Stage:
    """A table written once below the shared folder, which can be removed when it has been used."""

    def __init__(self, df: DataFrame, label: str, partition_by: tuple[str, ...] = ()):
        self.spark, self.path = df.sparkSession, work_folder(df.sparkSession, label)
        with shuffle_cleanup(self.spark):
            df.write.partitionBy(*partition_by).parquet(self.path)
        self.schema = df.schema

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self, part: str = "") -> None:
        """Remove the table, or one folder of it."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}" if part else self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Return freed memory to the system: Spark keeps a task's Python process for the stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def binary_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The joined bytes of a binary or string array and its offsets, without a copy."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    joined = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return joined[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_array(joined: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array from joined bytes and offsets."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(joined)]
    ).cast(pa.binary())


def row_pieces(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that a column's bytes stay near ``most_bytes``; one row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = binary_buffers(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end
