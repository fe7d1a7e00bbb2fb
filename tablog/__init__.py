"""Search, sort and reshape large delimited text logs on Spark."""

from tablog.operators.filters import apply_filter, build_predicate, combine
from tablog.operators.lookup import find_position, find_positions, goto_lines, position_table
from tablog.operators.positions import page, row_range, rows_at, with_positions
from tablog.operators.reshape import (
    detail_text,
    explode_fields,
    export_lines,
    load_summary,
    row_text,
    wide_table,
)
from tablog.plans.log import Log
from tablog.plans.spec import Condition, Sort, ViewSpec
from tablog.plans.view import View
from tablog.sinks.text import write_rows_at, write_view
from tablog.sources.checks import (
    BinaryFileError,
    MalformedTextError,
    binary_files,
    malformed_lines,
)
from tablog.sources.stored import open_log, store_log
from tablog.sources.table import log_from_table, log_from_texts
from tablog.sources.text import read_log

__all__ = [
    "BinaryFileError",
    "Condition",
    "Log",
    "MalformedTextError",
    "Sort",
    "View",
    "ViewSpec",
    "apply_filter",
    "binary_files",
    "build_predicate",
    "combine",
    "detail_text",
    "explode_fields",
    "export_lines",
    "find_position",
    "find_positions",
    "goto_lines",
    "load_summary",
    "log_from_table",
    "log_from_texts",
    "malformed_lines",
    "open_log",
    "page",
    "position_table",
    "read_log",
    "row_range",
    "row_text",
    "rows_at",
    "store_log",
    "wide_table",
    "with_positions",
    "write_rows_at",
    "write_view",
]
