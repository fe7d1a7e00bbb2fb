"""Consecutive numbers for rows, without pulling the rows into one task."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablog.plans.durable import attach, broadcast_limit, durable, remove_path, scratch_path

# Tables up to this size (one row per split, partition, …) are ranked by a
# single window task; larger ones by a distributed sort.
WINDOW_ROWS = 1_000_000
# monotonically_increasing_id keeps the row's index in its partition in the
# lower bits and the partition in the bits above.
_INDEX_BITS = 33
# Size of one entry of a broadcast table of running totals, with overhead.
_ENTRY_BYTES = 64
# Running totals are taken over chunks of this many neighbouring keys (as bits).
_CHUNK_BITS = 16


@dataclass(frozen=True, eq=False)
class SortedTable:
    """Rows written in a total order, with the first position of each part.

    ``frame`` has the rows and ``mid``; parts are numbered in sort order and
    ``starts`` has ``part, first`` for each.  ``bounds`` has that and the sort
    keys of the part's first row, as ``_low0``, ….
    """

    frame: DataFrame
    starts: DataFrame
    total: int
    small: bool
    bounds: DataFrame
    path: str

    def positions(self, name: str = "position") -> DataFrame:
        index = F.col("mid").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
        keyed = self.frame.withColumn("part", F.shiftright("mid", _INDEX_BITS))
        return (
            attach(keyed, self.starts, ["part"], spread="mid", how="inner", small=self.small)
            .withColumn(name, F.col("first") + index)
            .drop("part", "first", "mid")
        )

    def within(self, part: int) -> Column:
        """Rows of one part; the others' row groups are not read."""
        return F.col("mid").between(part << _INDEX_BITS, (part + 1 << _INDEX_BITS) - 1)

    def remove(self) -> None:
        """Delete the written rows; what was made of them can no longer be read."""
        remove_path(self.frame.sparkSession, self.path)

    def mid_of(self, position: int) -> int:
        """The stored row id at a position (0 <= position < total)."""
        row = (
            self.starts.where(F.col("first") <= position)
            .orderBy(F.col("first").desc(), F.col("part").desc())
            .first()
        )
        return (row["part"] << _INDEX_BITS) + position - row["first"]


def sorted_table(df: DataFrame, keys: list[Column], kept: list, low: list[str] | None = None) -> SortedTable:
    """Sort once and write the ``kept`` columns to the shared folder.

    The written copy is what makes positions exact: a range sort samples its
    boundaries anew each time it is evaluated.  It is columnar, so counting
    its parts reads one small column.  The columns ``low`` are written for the
    first row of each part only: an index to the parts.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "sorted")
    lows = [F.col(name).alias(f"_low{i}") for i, name in enumerate(low or [])]
    rows = df.orderBy(*keys).select(*kept, *lows, F.monotonically_increasing_id().alias("mid"))
    index = F.col("mid").bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    names = [f"_low{i}" for i in range(len(lows))]
    rows = rows.withColumns({name: F.when(index == 0, F.col(name)) for name in names})
    rows.write.parquet(path, compression="zstd")
    stored = spark.read.parquet(path)
    parts = durable(
        stored.groupBy(F.shiftright("mid", _INDEX_BITS).alias("part")).agg(
            F.count(F.lit(1)).alias("rows"),
            *[F.any_value(name, ignoreNulls=True).alias(name) for name in names],
        )
    )
    count, total = _size(parts)
    bounds = running(parts, "part", count).select("part", "first", *names)
    small = count * _ENTRY_BYTES <= broadcast_limit(spark)
    return SortedTable(stored.drop(*names), bounds.select("part", "first"), total, small, bounds, path)


def _size(counts: DataFrame) -> tuple[int, int]:
    """Number of entries and sum of their rows."""
    return tuple(counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first())


def running(counts: DataFrame, key: str, entries: int) -> DataFrame:
    """``first``: the number of rows of all smaller keys (unique integers).

    More than a few entries are added up in chunks of neighbouring keys, then
    over the chunks, so that no task meets all of them.
    """
    ahead = (Window.unboundedPreceding, -1)

    def before(rows: str, window) -> Column:
        return F.coalesce(F.sum(rows).over(window.rowsBetween(*ahead)), F.lit(0))

    if entries <= WINDOW_ROWS:
        return counts.withColumn("first", before("rows", Window.orderBy(key)))
    chunked = counts.withColumn("chunk", F.shiftright(key, _CHUNK_BITS))
    sums = chunked.groupBy("chunk").agg(F.sum("rows").alias("chunk_rows"))
    bases = sums.select("chunk", before("chunk_rows", Window.orderBy("chunk")).alias("base"))
    inside = before("rows", Window.partitionBy("chunk").orderBy(key))
    return (
        chunked.withColumn("inside", inside)
        .join(bases, "chunk")
        .withColumn("first", F.col("base") + F.col("inside"))
        .drop("chunk", "inside", "base")
    )


def rank_rows(df: DataFrame, keys: list[str], name: str, rows: int) -> DataFrame:
    """Number the ``rows`` rows of a table 0, 1, … in the order of unique keys."""
    if rows <= WINDOW_ROWS:
        rank = F.row_number().over(Window.orderBy(*keys)).cast("bigint") - 1
        return df.withColumn(name, rank)
    return sorted_table(df, [F.col(k) for k in keys], df.columns).positions(name)


@dataclass(frozen=True, eq=False)
class BlockIndex:
    """How many of a table's rows each block holds, and how many all blocks before it.

    ``starts`` has ``block_no, rows, first_mid, first``.  Rows of a block are
    contiguous in one partition.
    """

    starts: DataFrame
    total: int
    small: bool

    def number(self, df: DataFrame, name: str) -> DataFrame:
        """The counted rows with their number, in place: no sort and no shuffle of the rows."""
        marked = df.withColumn("mid", F.monotonically_increasing_id())
        offset = F.col("mid") - F.col("first_mid")
        moved = F.raise_error("the rows changed while being counted").cast("bigint")
        place = F.when(offset.between(0, F.col("rows") - 1), F.col("first") + offset)
        found = attach(marked, self.starts, ["block_no"], spread="mid", small=self.small)
        return found.withColumn(name, place.otherwise(moved)).drop("mid", "rows", "first_mid", "first")

    def holding(self, start: int, end: int) -> DataFrame:
        """``block_no, first`` of the blocks with rows at ``start <= number < end``."""
        reaches = (F.col("first") < end) & (F.col("first") + F.col("rows") > start)
        return self.starts.where(reaches & (F.col("rows") > 0)).select("block_no", "first")


def block_index(df: DataFrame) -> BlockIndex:
    """Counts the rows of each block and adds up."""
    marked = df.withColumn("mid", F.monotonically_increasing_id())
    counts = durable(
        marked.groupBy("block_no").agg(
            F.count(F.lit(1)).alias("rows"), F.min("mid").alias("first_mid")
        )
    )
    count, total = _size(counts)
    small = count * _ENTRY_BYTES <= broadcast_limit(df.sparkSession)
    return BlockIndex(running(counts, "block_no", count), total, small)
