"""What the text operators share: reading tables, bounded Arrow batches, stable hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A Python batch holds at most this many rows ...
BATCH_ROWS = 256
#: ... and about this many bytes, so that a run of long texts stays small in memory.
BATCH_BYTES = 16 << 20

#: White space of the word contracts: blank and U+0009 to U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: texts differ a thousandfold in length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Return freed memory to the system: a worker process waits for its next task with what
    it holds, and one executor has several such workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library: it trims by itself or not at all
        pass


def map_batches(df: DataFrame, make: Callable[[], Callable], schema: str) -> DataFrame:
    """``mapInArrow`` with per-task set-up: ``make()`` returns batch -> list of batches."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        try:
            for batch in batches:
                work = work or make()
                yield from work(batch)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column's texts with null as the empty text."""
    return [t or "" for t in batch.column(column).to_pylist()]


def words(text: Column) -> Column:
    """Words of a text by the contracts' white space; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), lambda w: w != "")


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the frame does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def held_by_size(df: DataFrame, rows: int, most: int) -> DataFrame:
    """A broadcast hint behind a check: only where the counted ``rows`` stay within ``most``.
    Larger sides are left to a shuffled join."""
    return F.broadcast(df) if rows <= most else df
