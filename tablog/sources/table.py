"""Tables as logs: one row per line, or one text per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablog.functions.text import split_fields
from tablog.operators.numbering import sorted_table
from tablog.plans.log import Log
from tablog.sources.text import RAW_SEPARATORS


def log_from_table(
    df: DataFrame,
    columns: list[str],
    line_number: Column | None = None,
    order_by: list[Column] | None = None,
    file_name: str = "",
    separator: str = "\t",
    dense: bool = False,
) -> Log:
    """Rows of a table as lines; its columns, as text, are the fields (NULL → '').

    ``line_number`` is an expression with a unique value per row, 1 or more
    (``dense``: the values are exactly 1…n); a smaller one or NULL fails the
    query that meets it.  Without one, rows are numbered in the unique
    order ``order_by``, which sorts and writes the table once.
    """
    if (line_number is None) == (order_by is None):
        raise ValueError("give either line_number or order_by")
    total = None
    if line_number is not None:
        line_number = _checked(line_number)
    else:
        table = sorted_table(df, order_by, [F.col(c) for c in dict.fromkeys(columns)])
        df, total = table.positions("_position"), table.total
        line_number, dense = F.col("_position") + 1, True
    cells = tuple(f"cell_{i}" for i in range(len(columns)))
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    rows = df.select(
        F.lit(file_name).alias("file_name"),
        line_number.cast("bigint").alias("line_number"),
        *[text.alias(cell) for text, cell in zip(texts, cells)],
    )
    return Log(
        frame=rows.withColumn("fields", F.array(*cells)),
        separator=separator,
        columns=len(columns),
        cells=cells,
        total=total,
        max_line=total,
        dense=dense,
    )


def _checked(line_number: Column) -> Column:
    """The line number, where it is one."""
    line = line_number.cast("bigint")
    told = F.concat(F.lit("line numbers count from 1, not "), F.coalesce(line.cast("string"), F.lit("NULL")))
    return F.when(line >= 1, line).otherwise(F.raise_error(told).cast("bigint"))


def log_from_texts(
    df: DataFrame,
    text: str,
    key: str,
    separator: str = "\t",
    max_rows: int | None = None,
) -> Log:
    """A table of whole texts as a log of many files, one per text.

    ``key`` is unique and gives the file its name and its place among the files.
    """
    return Log(
        frame=text_rows(df, text, key, separator, max_rows),
        order=("file_key", "line_number"),
        separator=separator,
        lines=True,
        raw=separator in RAW_SEPARATORS,
        summarize=lambda: _text_summary(df, text, key, separator, max_rows),
    )


def _lines(text: str) -> Column:
    """The lines of a text; a final line end adds no line."""
    whole = F.col(text)

    def without(end: str) -> Column:
        return F.left(whole, F.length(whole) - len(end))

    body = whole
    for end in ("\r", "\n", "\r\n"):
        body = F.when(F.endswith(whole, F.lit(end)), without(end)).otherwise(body)
    # Byte-wise replacements and a one-character split: no regex engine.
    for end in ("\r\n", "\r"):
        body = F.replace(body, F.lit(end), F.lit("\n"))
    return F.split(body, "\n", -1)


def _text_summary(
    df: DataFrame, text: str, key: str, separator: str, max_rows: int | None
) -> DataFrame:
    """Rows, columns and truncation per text, from the text alone."""
    none = F.array().cast("array<string>")
    all_lines = F.when(F.coalesce(F.col(text), F.lit("")) == "", none).otherwise(_lines(text))
    lines = df.select(F.col(key).cast("string").alias("file_name"), all_lines.alias("lines"))
    kept, cut = F.col("lines"), F.lit(False)
    if max_rows is not None:
        kept, cut = F.slice("lines", 1, max_rows), F.size("lines") > max_rows
    widths = F.transform(kept, lambda line: F.size(split_fields(line, separator)))
    return lines.select(
        "file_name",
        F.size(kept).cast("bigint").alias("rows"),
        F.coalesce(F.array_max(widths), F.lit(0)).alias("columns"),
        cut.alias("truncated"),
    )


def text_rows(
    df: DataFrame, text: str, key: str, separator: str, max_rows: int | None = None
) -> DataFrame:
    """``file_name, file_key, line_number, value, fields`` of each text's lines."""
    lines = df.where(F.col(text) != "").select(
        F.col(key).cast("string").alias("file_name"),
        F.col(key).alias("file_key"),
        F.posexplode(_lines(text)).alias("line", "value"),
    )
    rows = lines.select(
        "file_name",
        "file_key",
        (F.col("line") + 1).cast("bigint").alias("line_number"),
        "value",
        split_fields(F.col("value"), separator).alias("fields"),
    )
    return rows if max_rows is None else rows.where(F.col("line_number") <= max_rows)
