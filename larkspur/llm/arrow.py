"""Small helpers for functions that run over Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Columns = dict[str, list]


def utf8(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8 bytes, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def schema_of(ddl: str) -> StructType:
    return _parse_datatype_string(ddl)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of ``rows`` rows, where the session has Spark's own default: texts are long, and a batch stands in
    memory several times on either side of the pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, rows)


def give_back() -> None:
    """Returns freed memory to the system; workers are kept for other tasks, and idle ones count too."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own ways
        pass


def blocks(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``rows``, but for the last."""
    held, n = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - n)
            batch, n = batch.slice(part.num_rows), n + part.num_rows
            held.append(part)
            if n == rows:
                yield pa.concat_batches(held)
                held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``mapInArrow`` with small batches, giving memory back at the end of a task."""
    small_batches(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


def map_batches(df: DataFrame, of_batch: Callable[[pa.RecordBatch], Columns | None], ddl: str, rows: int = 2000) -> DataFrame:
    """``of_batch`` makes columns (by name) of each Arrow batch, ``rows`` rows at a time, which bounds its memory."""
    spark_schema = schema_of(ddl)
    arrow_schema = to_arrow_schema(spark_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in (whole.slice(at, rows) for whole in batches for at in range(0, whole.num_rows, rows)):
            if made := of_batch(batch):
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in arrow_schema], schema=arrow_schema)

    return map_arrow(df, run, spark_schema)


def by_bytes(texts: list[bytes], most: int) -> Iterator[slice]:
    """Slices of consecutive texts of about ``most`` bytes in all, one text at least."""
    start, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > most:
            yield slice(start, i)
            start, size = i, 0
        size += len(x)
    if start < len(texts):
        yield slice(start, len(texts))
