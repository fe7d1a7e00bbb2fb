"""A view: a log seen through a request, in a fixed row order."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablog.functions.text import folded
from tablog.operators.filters import needed_texts, spec_predicate
from tablog.operators.numbering import BlockIndex, SortedTable, block_index, sorted_table
from tablog.plans.log import Log
from tablog.plans.spec import ViewSpec

SHOWN = ("file_name", "line_number", "fields")


class View:
    """Filter and sort of the base table, never of another view.

    Equal sort keys keep ascending line order in both directions, so the order
    is total.
    """

    def __init__(self, log: Log, spec: ViewSpec | None = None):
        self.log = log
        self.spec = spec or ViewSpec()

    @property
    def by_line(self) -> bool:
        return self.spec.sort.by_line and not self.spec.order_by

    @property
    def unfiltered(self) -> bool:
        return not self.spec.active_conditions()

    @cached_property
    def filtered(self) -> DataFrame:
        """The rows of the view in no particular order."""
        if self.unfiltered:
            return self.log.frame
        frame = None
        if self.log.holding is not None and needed_texts(self.spec):
            frame = self.log.holding(needed_texts(self.spec))
        frame = self.log.frame if frame is None else frame
        return frame.where(spec_predicate(self.spec, self.log))

    def key_parts(self) -> list[tuple[Column, bool]]:
        """Sort expressions with their direction (True: ascending), ties aside."""
        parts = list(self.spec.order_by)
        if not self.spec.sort.by_line:
            text = F.coalesce(self.log.field(self.spec.sort.column), F.lit(""))
            parts.append((folded(text, self.spec.text_order), self.spec.sort.ascending))
        return parts

    @property
    def ties_ascend(self) -> bool:
        return self.spec.sort.ascending or not self.spec.sort.by_line

    @property
    def kept(self) -> list[str]:
        """Columns a row needs to be shown; a line stands in for its fields.

        A line is a fraction of the size of its fields in a shuffle and is
        split again afterwards.
        """
        names = ["file_name", *self.log.order, "line_number", *self.log.body]
        return list(dict.fromkeys(names))

    @property
    def key_names(self) -> list[str]:
        """The columns that :meth:`sortable` sorts by."""
        return [f"_key{i}" for i in range(len(self.key_parts()))] + list(self.log.order)

    def sortable(self, *columns: Column) -> tuple[DataFrame, list[Column]]:
        """The rows (``columns``, or :attr:`kept`) with the keys to sort them by.

        Each key is a column of its own, so that sorting does not compute it at
        each comparison; the columns of the log's order break ties.
        """
        chosen = [c.alias(f"_out{i}") for i, c in enumerate(columns)]
        chosen = [*chosen, *self.log.order] if columns else self.kept
        parts = self.key_parts()
        keys = [key.alias(f"_key{i}") for i, (key, _) in enumerate(parts)]
        names = self.key_names
        ups = [up for _, up in parts] + [self.ties_ascend] * len(self.log.order)
        order = [F.col(n).asc() if up else F.col(n).desc() for n, up in zip(names, ups)]
        return self.filtered.select(*chosen, *keys), order

    def show(self, df: DataFrame, *more: str) -> DataFrame:
        """Rows of :attr:`kept` columns as they are shown, with ``more`` in front."""
        return df.select(*more, "file_name", "line_number", self.log.from_body())

    @property
    def needs_sort(self) -> bool:
        """False if the scan already meets the rows in view order."""
        return not (self.by_line and self.spec.sort.ascending and self.log.in_order)

    def ordered(self, line: Column) -> DataFrame:
        """One output column of the view, in view order."""
        if not self.needs_sort:
            return self.filtered.select(line)
        if self.by_line and self.spec.sort.ascending and self.log.placed is not None:
            return self._dealt(line)
        df, order = self.sortable(line)
        return df.orderBy(*order).select(F.col("_out0").alias("value"))

    def _dealt(self, line: Column) -> DataFrame:
        """One output column, in line order over many files.

        The place of each line in the log is known, so the lines are dealt to
        parts by it and put in order there; nothing is sampled.
        """
        parts = int(self.log.frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        part = F.floor(F.col("place") / max(-(-self.log.placed // parts), 1)).cast("int")
        rows = self.filtered.select(line.alias("value"), "place")
        return rows.repartitionById(parts, part).sortWithinPartitions("place").select("value")

    def rows(self) -> DataFrame:
        """The rows of the view in view order."""
        if not self.needs_sort:
            return self.filtered.select(*SHOWN)
        df, order = self.sortable()
        return self.show(df.orderBy(*order))

    def count(self) -> int:
        if self.unfiltered and self.log.total is not None:
            return self.log.total
        return self.filtered.count()

    def is_empty(self) -> bool:
        if self.unfiltered and self.log.total is not None:
            return self.log.total == 0
        return self.filtered.isEmpty()

    @cached_property
    def blocks(self) -> BlockIndex:
        """How many of the view's rows each block of the log has; counted once, if not known."""
        if self.unfiltered and self.log.evenly:
            return BlockIndex(self.log.blocks, self.log.total, small=False)
        return block_index(self.filtered)

    @cached_property
    def sorted(self) -> SortedTable:
        """The view sorted and written once, shared by all lookups by position."""
        df, order = self.sortable()
        return sorted_table(df, order, self.kept, self.key_names)

    @cached_property
    def sorted_lines(self) -> SortedTable:
        """Like :attr:`sorted` with nothing but the line numbers to carry."""
        if "sorted" in vars(self):
            return self.sorted
        df, order = self.sortable(F.col("line_number"))
        return sorted_table(df, order, [F.col("_out0").alias("line_number")], self.key_names)

    @property
    def known_order(self) -> SortedTable | None:
        """The view sorted, if that was done before."""
        return vars(self).get("sorted") or vars(self).get("sorted_lines")

    def close(self) -> None:
        """Delete what was written for the view; it is written anew if asked for again.

        Pages and positions that were not collected yet read it, so they go, too.
        """
        for name in ("sorted", "sorted_lines"):
            table = vars(self).pop(name, None)
            if table is not None:
                table.remove()

    def __enter__(self) -> View:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()

    def visible_columns(self) -> list[int]:
        return self.spec.visible(self.log.known_columns())
