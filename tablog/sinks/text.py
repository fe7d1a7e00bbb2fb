"""Views written as delimited text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tablog.functions.text import join_fields
from tablog.operators.positions import rows_at
from tablog.operators.reshape import LINE_END, OUTPUT_SEPARATOR, visible_line
from tablog.plans.log import Log
from tablog.plans.view import View


def write_view(
    view: View,
    path: str,
    on_conflict: str = "error",
    compression: str | None = None,
) -> int:
    """Write the view's visible fields in view order; returns the row count.

    Lines are tab-separated, end with CR LF and carry no header and no line
    number.  ``path`` becomes a folder of part files in name order, replacing
    what was there; the parts in a row are the one file.  An empty view writes
    nothing.
    """
    if view.is_empty():
        return 0
    visible = view.visible_columns()
    line = _line(view.log, visible, on_conflict, _clean(view))
    return _write(view.ordered(line), path, compression)


def write_rows_at(
    view: View,
    positions: Iterable[int] | DataFrame,
    path: str,
    on_conflict: str = "error",
    compression: str | None = None,
) -> int:
    """Write the rows at some positions, ascending; returns the row count.

    Nothing is written if no position is given, all columns are hidden or the
    view is empty.
    """
    if not isinstance(positions, DataFrame):
        positions = list(positions)
        if not positions:
            return 0
    elif positions.isEmpty():
        return 0
    visible = view.visible_columns()
    if not visible or view.is_empty():
        return 0
    chosen = rows_at(view, positions)
    line = _line(Log(chosen), visible, on_conflict, _clean(view))
    lines = chosen.select("position", line).orderBy("position")
    return _write(lines.select("value"), path, compression)


def _clean(view: View) -> bool:
    """Fields split from lines at tabs hold neither tabs nor line ends."""
    return view.log.lines and view.log.separator == OUTPUT_SEPARATOR


def _line(log: Log, visible: list[int], on_conflict: str, clean: bool) -> Column:
    """The output line; what would not read back as one field is refused or spaced."""
    if on_conflict not in ("error", "replace"):
        raise ValueError(f"on_conflict must be 'error' or 'replace', not {on_conflict!r}")
    line = visible_line(log, visible)
    if clean:
        return line.alias("value")
    special = "[\\t\\r\\n]"
    if on_conflict == "replace":
        spaced = [F.regexp_replace(log.padded(i), special, " ") for i in visible]
        return join_fields(spaced, OUTPUT_SEPARATOR).alias("value")
    conflict = F.lit(False)
    for i in visible:
        conflict = conflict | log.padded(i).rlike(special)
    refused = F.raise_error("a field contains a tab or a line end").cast("string")
    return F.when(conflict, refused).otherwise(line).alias("value")


def _write(lines: DataFrame, path: str, compression: str | None) -> int:
    # Counted while written: above the sort, so each row once.
    seen = Observation()
    counted = lines.observe(seen, F.count(F.lit(1)).alias("rows"))
    counted.write.mode("overwrite").text(path, compression=compression, lineSep=LINE_END)
    return seen.get["rows"]
