"""The base table: ragged rows of text fields with their original line numbers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablog.functions.text import line_field, raw_field, split_fields


@dataclass(frozen=True, eq=False)
class Log:
    """Rows ``file_name, line_number, fields`` and how they may be read.

    ``frame`` may carry more columns than :attr:`rows` shows: ``value`` (the
    raw line), ``block_no`` and ``place``.

    * ``order``: columns that together give every row its unique place.
    * ``lines``: ``value`` holds the line the fields were split from.
    * ``raw``: that line can be searched instead of the fields.
    * ``columns``: number of columns if already known.
    * ``cells``: the columns the fields were made of, in a table of rows of
      one width; each can be read without the others.
    * ``total``: number of rows if already known.
    * ``dense``: line numbers are 1, 2, … without gaps over the whole log.
    * ``blocked``: rows of a ``block_no`` are contiguous in one partition and
      in line order, the same way in every evaluation.
    * ``in_order``: partitions and their rows come in line order.
    * ``placed``: how many places ``place`` counts, 0, 1, … in line order over
      the whole log; some may be empty.
    * ``blocks``: ``block_no, file_path`` of each block, and how many ``rows``
      it and the blocks before it (``first``) have.
    * ``part``: reads some of the files, by their paths, as ``frame`` does.
    * ``holding``: the rows of the files that may hold all of some texts, if a
      search can be narrowed to these (else None).
    * ``tasks``: how many splits the scan has, if known.
    * ``summarize``: makes the load summary, one row per file.
    """

    frame: DataFrame
    order: tuple[str, ...] = ("line_number",)
    separator: str = "\t"
    lines: bool = False
    raw: bool = False
    columns: int | None = None
    cells: tuple[str, ...] = ()
    total: int | None = None
    max_line: int | None = None
    dense: bool = False
    blocked: bool = False
    in_order: bool = False
    placed: int | None = None
    blocks: DataFrame | None = None
    part: Callable[[list[str]], DataFrame] | None = None
    holding: Callable[[list[str]], DataFrame | None] | None = None
    tasks: int | None = None
    summarize: Callable[[], DataFrame] | None = None

    @property
    def rows(self) -> DataFrame:
        return self.frame.select("file_name", "line_number", "fields")

    @property
    def evenly(self) -> bool:
        """Whether ``place`` has no gaps."""
        return self.placed is not None and self.placed == self.total

    @property
    def fields(self) -> Column:
        return F.col("fields")

    def field(self, index: int) -> Column:
        """One field, or NULL where the row has no such column."""
        if index >= 0 and self.lines:
            return line_field(F.col("value"), self.separator, index)
        return self.cell(index)

    def cell(self, index: int) -> Column:
        """Like :meth:`field`, for when several fields of a row are wanted."""
        if 0 <= index < len(self.cells):
            return F.col(self.cells[index])
        return raw_field(self.fields, -1 if self.cells else index)

    def padded(self, index: int) -> Column:
        """One field of several, empty where the row has no such column."""
        return F.coalesce(self.cell(index), F.lit(""))

    @property
    def body(self) -> tuple[str, ...]:
        """The columns that carry a row's fields most compactly."""
        return ("value",) if self.lines else self.cells or ("fields",)

    def from_body(self) -> Column:
        """The fields, made anew from :attr:`body`."""
        if self.lines:
            return split_fields(F.col("value"), self.separator).alias("fields")
        return F.array(*self.cells).alias("fields") if self.cells else self.fields

    def known_columns(self) -> int:
        """Widest row; 0 for an empty log."""
        return self._measured[0] if self.columns is None else self.columns

    def known_max_line(self) -> int:
        return self._measured[1] if self.max_line is None else self.max_line

    @cached_property
    def _measured(self) -> tuple[int, int]:
        """Facts the source did not know, from one pass over the rows."""
        columns = F.lit(self.columns) if self.columns is not None else F.max(F.size("fields"))
        zero = F.lit(0)
        return tuple(
            self.frame.agg(
                F.coalesce(columns, zero), F.coalesce(F.max("line_number"), zero)
            ).first()
        )

    def one_file(self, file_name: str | None = None, file_path: str | None = None) -> Log:
        """The part of the log that came from one file, by its name or its path.

        Files of one name in two folders are told apart by path only.
        """
        if (file_name is None) == (file_path is None):
            raise ValueError("give either file_name or file_path")
        column = "file_name" if file_path is None else "file_path"
        own = F.col(column) == (file_name if file_path is None else file_path)
        whole = self.summarize
        return replace(
            self,
            frame=self.frame.where(own),
            columns=len(self.cells) or None,
            total=None,
            max_line=None,
            dense=False,
            placed=None,
            part=None,
            holding=None,
            summarize=None if whole is None else lambda: whole().where(own),
        )
