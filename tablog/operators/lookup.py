"""From line numbers to positions in a view, and go-to-line outcomes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablog.functions.text import parse_line_number
from tablog.operators.filters import spec_predicate
from tablog.operators.numbering import SortedTable
from tablog.operators.positions import line_positions
from tablog.plans.durable import attach
from tablog.plans.view import View

# Up to this many lines are found by counting the rows ahead of each in one
# pass; more by numbering the view.  Both give the same positions.
COUNTED_LINES = 64


def find_position(view: View, line_number: int) -> int:
    """The first position that shows the line, or -1."""
    return find_positions(view, [line_number])[line_number]


def find_positions(view: View, line_numbers: list[int]) -> dict[int, int]:
    """Positions of some lines (-1: not in the view)."""
    wanted = sorted(set(line_numbers))
    if _countable(view, wanted) and view.known_order is not None:
        return _indexed(view, view.known_order, wanted)
    if _countable(view, wanted):
        return _counted(view, wanted)[0]
    spark = view.log.frame.sparkSession
    table = spark.createDataFrame([(n,) for n in wanted], "line_number bigint")
    return {r["line_number"]: r["position"] for r in position_table(view, table).collect()}


def _countable(view: View, wanted: list[int]) -> bool:
    # The caller's sort keys may be NULL, which counting does not compare.
    return len(wanted) <= COUNTED_LINES and not view.spec.order_by


def _counted(view: View, wanted: list[int]) -> tuple[dict[int, int], set[int], int, int]:
    """Positions of a few lines, those among them that the log has, and the numbers of
    rows of the view and the largest line of the log.

    One pass over the log, after another that fetches the lines' sort keys
    unless they are the line numbers.
    """
    keyed, names, ups = _keyed(view)
    if view.by_line and view.log.order == ("line_number",):
        targets = [{"line_number": n, names[0]: n} for n in wanted]
    else:
        targets = _targets(keyed, names, ups, wanted)
    counts = [F.count_if("_shown"), F.coalesce(F.max("line_number"), F.lit(0))]
    counts += [F.count_if(F.col("line_number") == n) for n in wanted]
    for target in targets:
        counts.append(F.count_if(F.col("_shown") & _ahead(names, ups, target)))
        counts.append(F.count_if(F.col("_shown") & (F.col("line_number") == target["line_number"])))
    row = list(keyed.agg(*[c.alias(f"_count{i}") for i, c in enumerate(counts)]).first())
    rows, most, there, ahead = row[0], row[1], row[2 : 2 + len(wanted)], row[2 + len(wanted) :]
    found = dict.fromkeys(wanted, -1)
    for i, target in enumerate(targets):
        if ahead[2 * i + 1]:
            found[target["line_number"]] = ahead[2 * i]
    return found, {n for n, count in zip(wanted, there) if count}, rows, most


def _keyed(view: View) -> tuple[DataFrame, list[str], list[bool]]:
    """The log's lines with whether they are ``_shown`` and their sort keys; the keys' names and directions."""
    log = view.log
    shown = F.lit(True)
    if not view.unfiltered:
        shown = F.coalesce(spec_predicate(view.spec, log), F.lit(False))
    parts = view.key_parts() + [(F.col(n), view.ties_ascend) for n in log.order]
    names = [f"_key{i}" for i in range(len(parts))]
    keyed = log.frame.select(
        "line_number",
        shown.alias("_shown"),
        *[part.alias(name) for name, (part, _) in zip(names, parts)],
    )
    return keyed, names, [up for _, up in parts]


def _targets(keyed: DataFrame, names: list[str], ups: list[bool], wanted: list[int]) -> list[dict]:
    """Line number and sort keys of the first row of each wanted line that is shown."""
    here = keyed.where(F.col("line_number").isin(wanted) & F.col("_shown"))
    return [r.asDict() for r in _firsts(here, names, ups).collect()] if wanted else []


def _indexed(view: View, table: SortedTable, wanted: list[int]) -> dict[int, int]:
    """Positions of some lines in a view that is sorted already.

    The first keys of the parts tell which one holds a line's keys, and only
    that one is read.
    """
    keyed, names, ups = _keyed(view)
    targets = _targets(keyed, names, ups, wanted)
    found = dict.fromkeys(wanted, -1)
    if not targets:
        return found
    rows = held_rows(table, ups, targets)
    first = rows.groupBy("line_number").agg(F.min("position").alias("position"))
    return found | {r["line_number"]: r["position"] for r in first.collect()}


def held_rows(table: SortedTable, ups: list[bool], targets: list[dict]) -> DataFrame:
    """``line_number, position`` of the targets' lines in the parts that hold their keys."""
    lows = [f"_low{i}" for i in range(len(ups))]
    holders = []
    for i, target in enumerate(targets):
        keys = {low: target[f"_key{k}"] for k, low in enumerate(lows)}
        same = reduce(Column.__and__, [F.col(low) == F.lit(key) for low, key in keys.items()])
        before = _ahead(lows, ups, keys) | same
        holders.append(F.max(F.when(before, F.struct("first", "part"))).alias(f"_holder{i}"))
    held = table.bounds.agg(*holders).first()
    conditions, places = F.lit(False), F.lit(None).cast("bigint")
    for target, holder in zip(targets, held):
        here = table.within(holder["part"]) & (F.col("line_number") == target["line_number"])
        conditions = conditions | here
        places = F.when(here, F.col("mid") - (holder["part"] << 33) + holder["first"]).otherwise(places)
    return table.frame.where(conditions).select("line_number", places.alias("position"))


def _firsts(keyed: DataFrame, names: list[str], ups: list[bool]) -> DataFrame:
    """Sort keys of the first row of each line number; several files may have it."""

    def best(columns: list[str], up: bool) -> Column:
        key = F.struct(*columns)
        return (F.min(key) if up else F.max(key)).alias("_best")

    if len(set(ups)) == 1:
        first = keyed.groupBy("line_number").agg(best(names, ups[0]))
        return first.select("line_number", "_best.*")
    # The text key and the ties run in opposite directions: the ties first.
    lead, ties = names[0], names[1:]
    tied = keyed.groupBy("line_number", lead).agg(best(ties, ups[1]))
    pick = F.min_by if ups[0] else F.max_by
    first = tied.groupBy("line_number").agg(pick(F.struct(lead, "_best"), lead).alias("_row"))
    return first.select("line_number", f"_row.{lead}", "_row._best.*")


def _ahead(names: list[str], ups: list[bool], target: dict) -> Column:
    """Rows that sort before the target, compared key by key."""

    def step(after: Column, key: tuple[str, bool]) -> Column:
        name, up = key
        here, there = F.col(name), F.lit(target[name])
        before = here < there if up else here > there
        return before | ((here == there) & after)

    return reduce(step, reversed(list(zip(names, ups))), F.lit(False))


def position_table(view: View, lines: DataFrame) -> DataFrame:
    """``line_number, position`` for a table of line numbers (-1: not in the view)."""
    wanted = lines.select(F.col("line_number").cast("bigint")).distinct()
    shown = attach(
        line_positions(view),
        wanted,
        ["line_number"],
        spread="position",
        how="left_semi",
    )
    first = shown.groupBy("line_number").agg(F.min("position").alias("position"))
    return wanted.join(first, "line_number", "left").select(
        "line_number", F.coalesce("position", F.lit(-1).cast("bigint")).alias("position")
    )


def goto_lines(view: View, requests: list[str] | DataFrame) -> DataFrame:
    """Outcome of going to each requested line, as the user typed it.

    ``request, line, status, position, max_line`` with status ``shown`` (at
    ``position``), ``filtered_out`` (the log has the line, the view does not),
    ``missing``, ``invalid`` or ``no_data`` (the view is empty).  A table of
    requests has a column ``request``.  Any positive BIGINT may be a line.
    """
    spark = view.log.frame.sparkSession
    listed = not isinstance(requests, DataFrame)
    if listed:
        requests = spark.createDataFrame([(r,) for r in requests], "request string")
    typed = requests.select("request", parse_line_number(F.col("request")).alias("line"))
    few = None
    if listed:
        few = sorted({r["line"] for r in typed.where("line >= 1").collect()})
    if few is not None and _countable(view, few):
        found, there, rows, most = _counted(view, few)
        empty = rows == 0
        places = spark.createDataFrame(
            [(n, p, n in there) for n, p in found.items()],
            "line bigint, position bigint, there boolean",
        )
    else:
        most, empty = view.log.known_max_line(), view.is_empty()
        asked = typed.where("line >= 1").select(F.col("line").alias("line_number")).distinct()
        places = _with_presence(view, position_table(view, asked), most)
    line, position = F.col("line"), F.col("position")
    status = (
        F.when(F.lit(empty), "no_data")
        .when(line.isNull() | (line < 1), "invalid")
        .when(position >= 0, "shown")
        .when(F.col("there"), "filtered_out")
        .otherwise("missing")
    )
    return typed.join(places, "line", "left").select(
        "request",
        "line",
        status.alias("status"),
        F.when(position >= 0, position).alias("position"),
        F.lit(most).cast("bigint").alias("max_line"),
    )


def _with_presence(view: View, places: DataFrame, most: int) -> DataFrame:
    """``line, position, there``: whether the log itself has the line."""
    places = places.withColumnRenamed("line_number", "line")
    if view.log.dense:
        return places.withColumn("there", F.col("line") <= most)
    hidden = places.where("position < 0").select(F.col("line").alias("line_number"))
    base = view.log.frame.select("line_number")
    found = attach(base, hidden, ["line_number"], spread="line_number", how="left_semi").distinct()
    found = found.select(F.col("line_number").alias("line"), F.lit(True).alias("there"))
    return places.join(found, "line", "left")
