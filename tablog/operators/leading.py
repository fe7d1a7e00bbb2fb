"""The first rows of a table in some order, without moving the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rows of all tasks that one task may merge; more are merged in groups first.
MERGE_ROWS = 2_000_000
# monotonically_increasing_id keeps the row's index in its partition in the lower bits.
_INDEX = (1 << 33) - 1


def first_rows(df: DataFrame, order: list[Column], count: int, tasks: int | None = None) -> DataFrame:
    """The first ``count`` rows in ``order``, in that order; ``tasks`` are those of the scan.

    No task passes on more than ``count`` rows.  Where one task can merge what
    all tasks pass on, each keeps a heap of its first rows.  Else the tasks
    are dealt to the shuffle's partitions and the first rows of each are taken
    before they meet, so that the last merge sees ``count`` rows of each at most.
    """
    tasks = scan_tasks(df) if tasks is None else tasks
    if tasks * count > MERGE_ROWS:
        own = _leading(df, order, count)
        df = _leading(own.repartition(F.spark_partition_id()), order, count)
    return df.orderBy(*order).limit(count)


def _leading(df: DataFrame, order: list[Column], count: int) -> DataFrame:
    """The first ``count`` rows of each partition."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit(_INDEX))
    ordered = df.sortWithinPartitions(*order).withColumn("_place", place)
    return ordered.where(F.col("_place") < count).drop("_place")


def scan_tasks(df: DataFrame) -> int:
    """About how many tasks read the table, by its size as the optimizer knows it.

    The optimizer knows no size of what comes out of a join or filter, and
    takes the largest; that only means a merge in groups.
    """
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    split = df._jdf.sparkSession().sessionState().conf().filesMaxPartitionBytes()
    return max(spark.sparkContext.defaultParallelism, size // split + 1)
