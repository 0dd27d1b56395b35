"""Running numbers over groups of any size, one of which may hold most of the rows.

A window over a group runs in one task.  Here rows are dealt by ranges of group
and order, so a large group lies in several chunks that follow one another;
windows run within a chunk of a group, and what the chunks before it add up to
comes from a table with a row for each chunk of a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"


def chunked(df: DataFrame, group: tuple[str, ...], order: tuple[str, ...], store: Callable[[DataFrame], DataFrame], partitions: int | None = None) -> DataFrame:
    """``df`` with a ``_chunk``: a range of (group, order), numbered upwards.

    ``store`` writes the rows and reads them back, since the numbers must not
    change afterwards.  Rows alike in group and order may fall on both sides of
    a border; where that matters, ``order`` must tell rows apart.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return store(df.repartitionByRange(n, *group, *(F.col(x).asc_nulls_first() for x in order)).withColumn(CHUNK, F.spark_partition_id()))


def totals(chunks: DataFrame, group: tuple[str, ...], **sums: Column) -> DataFrame:
    """``group, _chunk`` and, for each sum, ``name`` (of the chunk), ``name_before`` (of the group's chunks before it) and ``name_all`` (of the group)."""
    own = chunks.groupBy(*group, CHUNK).agg(*(c.alias(x) for x, c in sums.items()))
    before = Window.partitionBy(*group).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    return own.select(
        *group, CHUNK, *sums,
        *(F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in sums),
        *(F.sum(x).over(whole).alias(f"{x}_all") for x in sums),
    )


def within(group: tuple[str, ...], *order: str | Column):
    """The window over one chunk of a group, up to each row."""
    return Window.partitionBy(*group, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def last_before(chunks: DataFrame, group: tuple[str, ...], *order: str, **values: Column) -> tuple[dict[str, Column], DataFrame]:
    """(the last value that isn't null in the rows of the chunk before each row, ``group, _chunk, name_carried``: the last one in the chunks before).

    A row has both if the columns are made beside the table joined on ``group`` and
    ``_chunk``; the first counts where it is there.
    """
    upto = Window.partitionBy(*group, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ordered = F.struct(*order)
    own = chunks.groupBy(*group, CHUNK).agg(*(F.max_by(c, F.when(c.isNotNull(), ordered)).alias(x) for x, c in values.items()))
    before = Window.partitionBy(*group).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = own.select(*group, CHUNK, *(F.last(x, True).over(before).alias(f"{x}_carried") for x in values))
    return {x: F.last(c, True).over(upto) for x, c in values.items()}, carried
