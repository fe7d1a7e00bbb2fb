"""What a view asks for: conditions, sort order, hidden columns."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column

from tablog.functions.text import is_blank

# Fixed value: the sort column that stands for the line number.
LINE = -1


@dataclass(frozen=True)
class Condition:
    """A text condition on one column, or on any column (``column=None``).

    ``/…/`` is a regular expression that must match a whole field and is
    case-sensitive; other text is a case-insensitive substring.
    """

    text: str | None
    column: int | None = None


@dataclass(frozen=True)
class Sort:
    """Sort by one column; ``column=None`` (or any negative) is the line number."""

    column: int | None = None
    ascending: bool = True

    @property
    def by_line(self) -> bool:
        return self.column is None or self.column < 0


@dataclass(frozen=True, eq=False)
class ViewSpec:
    """A request for a view.

    ``conditions`` are ANDed and may mix :class:`Condition` with any boolean
    ``Column``.  ``single`` applies only while the list is empty; a list of
    blank conditions still replaces it.  ``order_by`` puts the caller's own
    ``(expression, ascending)`` pairs in front of ``sort``.
    """

    conditions: tuple[Condition | Column, ...] = ()
    single: Condition | None = None
    sort: Sort = field(default_factory=Sort)
    hidden: tuple[int, ...] = ()
    order_by: tuple[tuple[Column, bool], ...] = ()
    text_order: str = "utf8"

    def active_conditions(self) -> list[Condition | Column]:
        """The conditions that count, blank ones left out."""
        chosen = self.conditions or ((self.single,) if self.single else ())
        return [c for c in chosen if isinstance(c, Column) or not is_blank(c.text)]

    def visible(self, columns: int) -> list[int]:
        return visible_columns(columns, self.hidden)

    def rebind(self, columns: int) -> ViewSpec:
        """The same request for a newly loaded log of ``columns`` columns.

        Listed conditions keep a column that still exists and fall back to any
        column otherwise; the single condition, the sort and the hidden
        columns start afresh.
        """
        return replace(
            self,
            conditions=tuple(_rebound(c, columns) for c in self.conditions),
            single=None,
            sort=Sort(),
            hidden=(),
            order_by=(),
        )


def _rebound(condition: Condition | Column, columns: int) -> Condition | Column:
    if isinstance(condition, Column) or condition.column is None:
        return condition
    kept = condition.column if 0 <= condition.column < columns else None
    return replace(condition, column=kept)


def visible_columns(columns: int, hidden) -> list[int]:
    """All column indices but the hidden ones, ascending; strangers are ignored."""
    gone = set(hidden)
    return [i for i in range(columns) if i not in gone]


def hidden_columns(columns: int, visible) -> list[int]:
    """Inverse of :func:`visible_columns`: what a config entry stores."""
    shown = set(visible)
    return [i for i in range(columns) if i not in shown]
