"""Text conditions as boolean columns."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablog.functions.regex import full_match_pattern, matches, regex_body, required_texts
from tablog.functions.text import is_blank, trim_query
from tablog.plans.log import Log
from tablog.plans.spec import Condition, ViewSpec


def build_predicate(condition: Condition | Column, log: Log) -> Column:
    """The rows of ``log`` that meet one condition; never NULL.

    A blank text and an invalid pattern pass every row.  A row without the
    column fails, whatever the text or pattern.
    """
    if isinstance(condition, Column):
        return F.coalesce(condition, F.lit(False))
    if is_blank(condition.text):
        return F.lit(True)
    query = trim_query(condition.text)
    body = regex_body(query)
    if body is not None:
        pattern = full_match_pattern(body)
        if pattern is None:
            return F.lit(True)
        return _matching(log, condition.column, pattern, required_texts(body))
    return _substring(log, condition.column, query)


def _matching(log: Log, column: int | None, pattern: str, texts: list[str] | None) -> Column:
    """Fields that match; rows without any of the ``texts`` are told apart before that."""
    if texts is None:
        return _test_fields(log, column, lambda f: matches(f, pattern))

    def holding(text: Column) -> Column:
        return reduce(Column.__or__, [F.contains(text, F.lit(t)) for t in texts])

    if log.lines:
        # A field is part of its line, which is there before it is split.
        return holding(F.col("value")) & _test_fields(log, column, lambda f: matches(f, pattern))
    return _test_fields(log, column, lambda f: holding(f) & matches(f, pattern))


def _substring(log: Log, column: int | None, query: str) -> Column:
    # lower() on both sides, so that both use the same case tables.
    low = F.lower(F.lit(query))
    if not log.raw:
        return _test_fields(log, column, lambda f: F.contains(F.lower(f), low))
    if log.separator in query:
        return F.lit(False)
    on_line = F.contains(F.lower(F.col("value")), low)
    if column is None:
        return on_line
    # The line is cheap to search and tells most rows apart before splitting.
    return on_line & _test_fields(log, column, lambda f: F.contains(F.lower(f), low))


def _test_fields(log: Log, column: int | None, test) -> Column:
    if column is not None:
        if column < 0 or (log.cells and column >= len(log.cells)):
            return F.lit(False)
        return F.coalesce(test(log.field(column)), F.lit(False))
    if log.cells:  # plain columns: prunable and compiled with the scan
        tests = [test(F.col(cell)) for cell in log.cells]
        return F.coalesce(reduce(Column.__or__, tests, F.lit(False)), F.lit(False))
    return F.coalesce(F.exists(log.fields, test), F.lit(False))


def combine(predicates: Iterable[Column]) -> Column:
    """AND of predicates; none pass every row."""
    return reduce(Column.__and__, predicates, F.lit(True))


def spec_predicate(spec: ViewSpec, log: Log) -> Column:
    """AND of the request's conditions, those that are cheap to reject by first."""
    conditions = sorted(spec.active_conditions(), key=lambda c: _cost(c, log))
    return combine(build_predicate(c, log) for c in conditions)


def needed_texts(spec: ViewSpec) -> list[str]:
    """Texts that every row of the view holds, whatever their case, as far as its conditions tell."""
    texts = []
    for condition in spec.active_conditions():
        if isinstance(condition, Column) or is_blank(condition.text):
            continue
        query = trim_query(condition.text)
        body = regex_body(query)
        if body is None:
            texts.append(query)
        elif full_match_pattern(body) is not None:
            required = required_texts(body) or []
            # Beyond ASCII, a text may be lower-cased otherwise alone than in its line.
            texts += required if len(required) == 1 and required[0].isascii() else []
    return texts


def _cost(condition: Condition | Column, log: Log) -> int:
    if isinstance(condition, Column):
        return 3
    if regex_body(trim_query(condition.text)) is not None:
        return 2 if condition.column is None else 1
    return 0 if log.raw or condition.column is not None else 2


def apply_filter(log: Log, predicate: Column) -> DataFrame:
    return log.frame.where(predicate)
