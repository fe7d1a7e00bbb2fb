"""Rows as text or in long form, the wide table, visible fields, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablog.functions.text import join_fields, pad_fields
from tablog.plans.log import Log
from tablog.plans.view import View

# Output lines are tab-separated and end with CR LF.
OUTPUT_SEPARATOR = "\t"
LINE_END = "\r\n"


def wide_table(log: Log, columns: int | None = None, hidden=()) -> DataFrame:
    """``col_0 … col_{n-1}`` with short rows padded; ``n`` is found if not given."""
    n = log.known_columns() if columns is None else columns
    gone = set(hidden)
    cells = [log.padded(i).alias(f"col_{i}") for i in range(n) if i not in gone]
    return log.frame.select("file_name", "line_number", *cells)


def row_text(fields: Column, separator: str = OUTPUT_SEPARATOR) -> Column:
    """All fields of the row, hidden ones too, at the row's own width."""
    return F.array_join(fields, separator)


def visible_line(log: Log, visible: list[int], separator: str = OUTPUT_SEPARATOR) -> Column:
    """The visible fields as one output line, missing ones empty."""
    return join_fields([log.padded(i) for i in visible], separator)


def visible_fields(fields: Column, hidden: Column, columns: int) -> Column:
    """The row padded to ``columns`` without the row's hidden indices.

    For rows of many files with their own hidden columns, see
    :func:`~tablog.operators.columns.with_hidden`.
    """
    return F.filter(
        pad_fields(fields, columns), lambda _, i: ~F.array_contains(hidden, i)
    )


def explode_fields(df: DataFrame) -> DataFrame:
    """One row ``index, field`` per field."""
    return df.select(
        "file_name", "line_number", F.posexplode("fields").alias("index", "field")
    )


def detail_text(fields: Column) -> Column:
    """One line ``[index]\\tfield`` per field."""
    lines = F.transform(
        fields, lambda f, i: F.concat(F.lit("["), i.cast("string"), F.lit("]\t"), f, F.lit(LINE_END))
    )
    return F.array_join(lines, "")


def load_summary(log: Log) -> DataFrame:
    """``file_name, rows, columns, truncated`` per file.

    Files read from storage come with their profile; a table has one row per
    file that has lines.
    """
    if log.summarize is not None:
        return log.summarize().select("file_name", "rows", "columns", "truncated")
    return log.frame.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max(F.size("fields")).alias("columns"),
        F.lit(False).alias("truncated"),
    )


def export_lines(view: View, visible: list[int] | None = None) -> DataFrame:
    """The view's rows as output lines, in view order."""
    shown = view.visible_columns() if visible is None else visible
    return view.ordered(visible_line(view.log, shown).alias("value"))
