"""Helpers shared by the training-data operators.

What the operators keep between jobs goes under the folder that all executors
share (``functions.workspace``).
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workspace import delete, drop, exists, fresh_dir, shared_dir, ship, staged

__all__ = ["delete", "drop", "exists", "fresh_dir", "shared_dir", "staged"]

#: Arrow batches stay small because one text may be very long.
BATCH_ROWS = 256
BATCH_BYTES = 16 << 20


def prepare(spark: SparkSession) -> None:
    """Make the package importable on executors and bound Arrow batches.

    Sets two Arrow session options, and only ever to smaller batches.
    """
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def column_index(df: DataFrame, name: str) -> int:
    """Place of the column ``name``: an exact match first, then one that differs in case."""
    names = df.columns
    if name in names:
        return names.index(name)
    lowered = [x.lower() for x in names]
    if name.lower() in lowered:
        return lowered.index(name.lower())
    raise ValueError(f"no column {name!r} among {names}")


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Select columns under new names, whatever other columns are called.

    Goes by place, so extra columns whose names clash (even twice the same, or
    the same but for case) do no harm.
    """
    flat = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return flat.select(*(F.col(f"_{column_index(df, source)}").alias(alias) for alias, source in wanted.items()))


def with_row(df: DataFrame, **wanted: str) -> DataFrame:
    """All columns as one struct ``row`` (by place), beside the wanted ones."""
    flat = df.toDF(*(f"_{i}" for i in range(len(df.columns))))
    return flat.select(
        F.struct(*(F.col(f"_{i}") for i in range(len(df.columns)))).alias("row"),
        *(F.col(f"_{column_index(df, source)}").alias(alias) for alias, source in wanted.items()),
    )


def row_columns(df: DataFrame, like: DataFrame) -> DataFrame:
    """Undo :func:`with_row`."""
    return df.select(*(F.col(f"row._{i}").alias(f"_{i}") for i in range(len(like.columns)))).toDF(*like.columns)


def lean(run):
    """A function of Arrow batches that gives back, at the end of a task, the memory it no longer needs.

    Workers outlive their tasks, and many of them share an executor's memory with
    the JVM; what a task freed stays with the process otherwise.
    """

    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def release() -> None:
    import ctypes

    import pyarrow as pa

    from .words import forget

    forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to ask


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_bucket(column, modulus: int):
    """crc32 of the id as text, modulo ``modulus`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus
