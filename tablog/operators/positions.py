"""Positions in a view: numbering, pages, ranges, chosen rows."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablog.operators.filters import spec_predicate
from tablog.operators.leading import first_rows
from tablog.operators.numbering import block_index
from tablog.plans.durable import attach
from tablog.plans.view import SHOWN, View

# Positions below this are reached by a top-n; farther ones by the sorted table.
NEAR_ROWS = 10_000
# A page in line order that few files hold is read from these alone.
FEW_FILES = 16
POSITIONED = ("position", *SHOWN)


def with_positions(view: View) -> DataFrame:
    """``position`` (0-based, BIGINT) for every row of the view, unordered."""
    placed = _in_line_order(view)
    return view.show(view.sorted.positions(), "position") if placed is None else placed


def line_positions(view: View) -> DataFrame:
    """``position, line_number`` for every row of the view, unordered."""
    placed = _in_line_order(view)
    if placed is None:
        placed = view.sorted_lines.positions()
    return placed.select("position", "line_number")


def _in_line_order(view: View) -> DataFrame | None:
    """The numbered rows if they need no sort."""
    log, sort = view.log, view.spec.sort
    if not view.by_line:
        return None
    if view.unfiltered and (log.evenly or log.dense and (sort.ascending or log.total is not None)):
        numbered, total = log.frame, log.total
        place = F.col("place") if log.evenly else F.col("line_number") - 1
        numbered = numbered.withColumn("position", place)
    elif log.blocked:
        numbered, total = view.blocks.number(view.filtered, "position"), view.blocks.total
    else:
        return None
    if not sort.ascending:
        numbered = numbered.withColumn("position", F.lit(total - 1) - F.col("position"))
    return numbered.select(*POSITIONED)


def _of_few_files(view: View, start: int, end: int) -> DataFrame | None:
    """The rows at ``start <= position < end`` in line order, read from the files that hold them.

    Their positions go on from those of the files before, so the files are
    numbered by themselves.  None if that would read most of the log.
    """
    log = view.log
    if not (view.by_line and log.part and log.blocks is not None):
        return None
    total = view.blocks.total
    low, high = (start, end) if view.spec.sort.ascending else (total - end, total - start)
    held = view.blocks.holding(low, high).join(log.blocks.select("block_no", "file_path"), "block_no")
    names = [row[0] for row in held.select("file_path").distinct().limit(FEW_FILES + 1).collect()]
    if not names or len(names) > FEW_FILES:
        return None
    own = log.blocks.where(F.col("file_path").isin(names)).select("block_no")
    before = view.blocks.starts.join(own, "block_no").agg(F.min("first")).first()[0]
    rows = log.part(names)
    if not view.unfiltered:
        rows = rows.where(spec_predicate(view.spec, log))
    place = block_index(rows).number(rows, "position").withColumn("position", F.col("position") + before)
    if not view.spec.sort.ascending:
        place = place.withColumn("position", F.lit(total - 1) - F.col("position"))
    return place.select(*POSITIONED)


def _near(view: View, end: int) -> DataFrame:
    """The first ``end`` rows (few) with their positions."""
    df, order = view.sortable()
    rank = F.row_number().over(Window.orderBy(*order)).cast("bigint") - 1
    top = first_rows(df, order, end, view.log.tasks)
    return view.show(top.withColumn("position", rank), "position")


def _slice(view: View, start: int, end: int) -> DataFrame:
    """Rows at ``start <= position < end``."""
    here = F.col("position").between(start, end - 1)
    if end <= start:
        return _near(view, 0)
    if end <= NEAR_ROWS:
        return _near(view, end).where(here)
    if view.by_line and (view.log.blocked or view.unfiltered and view.log.dense):
        few = _of_few_files(view, start, end)
        return (with_positions(view) if few is None else few).where(here)
    table = view.sorted
    end = min(end, table.total)
    if end <= start:
        return _near(view, 0)
    # The stored row ids rise with the position: only row groups of the
    # requested range are read.
    inside = F.col("mid").between(table.mid_of(start), table.mid_of(end - 1))
    part = replace(table, frame=table.frame.where(inside))
    return view.show(part.positions(), "position")


def page(view: View, offset: int, limit: int) -> DataFrame:
    """``limit`` rows from position ``offset`` on, in view order."""
    start = max(offset, 0)
    return _slice(view, start, max(offset + limit, start)).orderBy("position")


def row_range(view: View, anchor: int, target: int) -> DataFrame:
    """Rows between two positions, given in either order, both included."""
    low, high = min(anchor, target), max(anchor, target)
    return _slice(view, max(low, 0), high + 1).orderBy("position")


def rows_at(view: View, positions: Iterable[int] | DataFrame) -> DataFrame:
    """Rows at the given positions, each once; positions outside are skipped.

    ``positions`` may be a DataFrame with a column ``position``.
    """
    if isinstance(positions, DataFrame):
        chosen = positions.select(F.col("position").cast("bigint")).distinct()
        # Spread by line: a position is one row, so no key is hot.
        return attach(
            with_positions(view), chosen, ["position"], spread="position", how="left_semi"
        )
    wanted = sorted({p for p in positions if p >= 0})
    if wanted and wanted[-1] >= NEAR_ROWS:  # counting is cheaper than numbering
        rows = view.count()
        wanted = [p for p in wanted if p < rows]
    if not wanted:
        return _near(view, 0)
    if wanted[-1] < NEAR_ROWS:
        return _near(view, wanted[-1] + 1).where(F.col("position").isin(wanted))
    spark = view.log.frame.sparkSession
    table = spark.createDataFrame([(p,) for p in wanted], "position bigint")
    return rows_at(view, table)
