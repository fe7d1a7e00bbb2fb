from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablog import (
    Condition,
    Sort,
    View,
    ViewSpec,
    detail_text,
    explode_fields,
    find_position,
    find_positions,
    goto_lines,
    page,
    position_table,
    row_range,
    row_text,
    rows_at,
    wide_table,
    with_positions,
)
from tablog.functions.text import line_label, raw_field
from tablog.operators import positions as positions_module


def values(log, column):
    return [r[0] for r in log.frame.select(column).collect()]


def test_field_access(make_log):
    log = make_log([["field1", "field2", "field3"], []], lines=[42, 43])
    assert values(log, F.size(log.fields)) == [3, 0]
    assert values(log, raw_field(log.fields, 1)) == ["field2", None]
    for index in (10, 100, -1, -100):
        assert values(log, raw_field(log.fields, index)) == [None, None]


def test_wide_table(make_log):
    log = make_log([["a"], ["b", "c", "d"]])
    wide = wide_table(log)
    assert wide.columns == ["file_name", "line_number", "col_0", "col_1", "col_2"]
    assert [tuple(r)[2:] for r in wide.collect()] == [("a", "", ""), ("b", "c", "d")]
    assert wide_table(log, hidden=(0, 7)).columns[2:] == ["col_1", "col_2"]


def test_forms(make_log):
    log = make_log([["a", "", "c"], [""]])
    assert values(log, row_text(log.fields)) == ["a\t\tc", ""]
    assert values(log, detail_text(log.fields)) == ["[0]\ta\r\n[1]\t\r\n[2]\tc\r\n", "[0]\t\r\n"]
    long = explode_fields(log.frame).collect()
    assert [(r["line_number"], r["index"], r["field"]) for r in long] == [
        (1, 0, "a"), (1, 1, ""), (1, 2, "c"), (2, 0, ""),
    ]
    log = make_log([["a"]], lines=[1234567])
    assert values(log, line_label(F.col("line_number"))) == ["1,234,567"]


@pytest.mark.parametrize(
    "lines,asked",
    [
        ([1, 2, 3], {1: 0, 2: 1, 3: 2}),
        ([1, 2], {99: -1, 0: -1, -1: -1}),
        ([100, 101], {100: 0}),
        ([1, 2, 1000], {1000: 2}),
        ([10, 50, 100], {10: 0, 50: 1, 100: 2, 30: -1}),
        ([2147483647], {2147483647: 0, 2147483646: -1}),
        ([42], {42: 0, 41: -1}),
        ([5, 6, 5_000_000_000], {5_000_000_000: 2}),
    ],
)
def test_find_position(make_log, lines, asked):
    view = View(make_log([["x"]] * len(lines), lines))
    for line, position in asked.items():
        assert find_position(view, line) == position


@pytest.mark.parametrize("end", [100, 5000, 9999])
def test_first_rows_without_moving_the_others(spark, make_log, monkeypatch, end):
    import random

    from tablog.operators import leading

    draw = random.Random(end)
    rows = [[draw.choice("abcABC"), str(draw.random())] for _ in range(12_000)]
    log = replace(make_log(rows), tasks=4)
    spec = ViewSpec(sort=Sort(0, ascending=False))
    order = sorted(range(len(rows)), key=lambda i: (-ord(rows[i][0].lower()), i))
    want = [i + 1 for i in order[end - 50 : end]]

    def taken():
        near = page(View(log, spec), end - 50, 50)
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert f"TakeOrderedAndProject(limit={end}" in plan and "Exchange rangepartitioning" not in plan
        assert [r["line_number"] for r in near.collect()] == want
        return plan

    assert "Exchange" not in taken()  # a heap per task, merged in one
    monkeypatch.setattr(leading, "MERGE_ROWS", 0)
    plan = taken()
    # What is exchanged between groups was cut to the first rows of a task before.
    above, below = plan.split("Exchange hashpartitioning")
    assert "Exchange" not in below
    assert f"< {end})" in below.split("Sort [")[0] and f"< {end})" in above


def test_find_position_in_empty_view(make_log):
    view = View(make_log([["x"]]), ViewSpec(conditions=(Condition("zzz"),)))
    assert find_position(view, 1) == -1


def two_files(spark, make_log):
    from dataclasses import replace

    a, b = make_log([["m"], ["b"]], file_name="a"), make_log([["a"], ["z"]], file_name="b")
    return replace(a, frame=a.frame.union(b.frame), order=("file_name", "line_number"))


@pytest.mark.parametrize("sort", [Sort(), Sort(ascending=False), Sort(0), Sort(0, False)])
def test_first_of_several_files(spark, make_log, sort):
    view = View(two_files(spark, make_log), ViewSpec(sort=sort))
    shown = [r["line_number"] for r in view.rows().collect()]
    table = spark.createDataFrame([(1,), (2,), (3,)], "line_number bigint")
    found = {r[0]: r[1] for r in position_table(view, table).collect()}
    assert found == {1: shown.index(1), 2: shown.index(2), 3: -1}
    assert {n: find_position(view, n) for n in (1, 2, 3)} == found


REQUESTS = ["1", " 3 ", "4", "9", "0", "-1", "1.5", "x", "", "+2", "99999999999", "3000000000"]
REQUESTS.append("99999999999999999999")
OUTCOMES = {
    "1": ("filtered_out", None),
    " 3 ": ("shown", 0),
    "4": ("filtered_out", None),
    "9": ("missing", None),
    "0": ("invalid", None),
    "-1": ("invalid", None),
    "1.5": ("invalid", None),
    "x": ("invalid", None),
    "": ("invalid", None),
    "+2": ("shown", 1),
    "99999999999": ("missing", None),
    "3000000000": ("missing", None),
    "99999999999999999999": ("invalid", None),
}


@pytest.mark.parametrize("many", [False, True])
def test_goto_lines(spark, make_log, many):
    log = make_log([["x"], ["a b"], ["a c"], ["y"]])
    spec = ViewSpec(conditions=(Condition("a"),), sort=Sort(ascending=False))
    asked = spark.createDataFrame([(r,) for r in REQUESTS], "request string") if many else REQUESTS
    rows = goto_lines(View(log, spec), asked).collect()
    assert {r["request"]: (r["status"], r["position"]) for r in rows} == OUTCOMES
    assert {r["max_line"] for r in rows} == {4}


def test_goto_lines_in_an_empty_view(make_log):
    view = View(make_log([["x"]]), ViewSpec(conditions=(Condition("zzz"),)))
    assert [r["status"] for r in goto_lines(view, ["1", "x"]).collect()] == ["no_data"] * 2


@pytest.fixture(params=["near", "far"])
def reach(request, monkeypatch):
    if request.param == "far":
        monkeypatch.setattr(positions_module, "NEAR_ROWS", 0)


def shown(df):
    return [(r["position"], r["line_number"]) for r in df.collect()]


def test_slices(make_log, reach):
    log = make_log([[f"k{i % 3}"] for i in range(20)])
    view = View(log, ViewSpec(sort=Sort(0, False)))
    full = list(enumerate([r["line_number"] for r in view.rows().collect()]))
    assert sorted(shown(with_positions(view))) == full
    assert shown(page(view, 5, 4)) == full[5:9]
    assert shown(page(view, 18, 10)) == full[18:]
    assert shown(page(view, 30, 5)) == []
    assert shown(page(view, 3, 0)) == []
    assert shown(row_range(view, 9, 4)) == full[4:10]
    assert shown(row_range(view, 4, 4)) == [full[4]]
    assert sorted(shown(rows_at(view, [7, 3, 3, 100, -2]))) == [full[3], full[7]]
    assert shown(rows_at(view, [])) == []


def test_rows_at_table(spark, make_log):
    view = View(make_log([["b"], ["a"], ["c"]]), ViewSpec(sort=Sort(0)))
    chosen = spark.createDataFrame([(0,), (2,), (2,), (50,), (-1,)], "position int")
    assert sorted(shown(rows_at(view, chosen))) == [(0, 2), (2, 3)]


@pytest.mark.parametrize("spec", [{}, {"sort": Sort(0, False)}, {"conditions": (Condition("1"),)}])
def test_many_lines_are_found_like_few(spark, make_log, spec):
    log = make_log([[f"v{i % 7}1" if i % 3 else "x"] for i in range(150)], lines=range(2, 302, 2))
    view = View(log, ViewSpec(**spec))
    wanted = list(range(1, 310))
    table = spark.createDataFrame([(n,) for n in wanted], "line_number bigint")
    places = {r["line_number"]: r["position"] for r in position_table(view, table).collect()}
    assert find_positions(view, wanted) == places
    few = wanted[::11]
    assert find_positions(view, few) == {n: places[n] for n in few}


@pytest.mark.parametrize("many", [False, True])
def test_numbers_between_lines_are_missing(spark, make_log, many):
    log = make_log([["a"], ["b"], ["a"]], lines=[1, 5, 9])
    asked = ["2", "3", "1", "5", "9", "10"]
    if many:
        asked = spark.createDataFrame([(a,) for a in asked], "request string")
    for view in (View(log), View(log, ViewSpec(conditions=(Condition("a"),), sort=Sort(0)))):
        got = {r["request"]: r["status"] for r in goto_lines(view, asked).collect()}
        five = "shown" if view.unfiltered else "filtered_out"
        assert got == {"2": "missing", "3": "missing", "1": "shown", "5": five, "9": "shown", "10": "missing"}


@pytest.fixture
def parts_stay(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("ascending", [True, False])
def test_lookup_in_a_sorted_view_reads_one_part(spark, make_log, parts_stay, ascending):
    import random

    from tablog.operators.lookup import _keyed, _targets, held_rows

    draw = random.Random(8)
    rows = [[draw.choice("abcdefgh"), str(draw.random())] for _ in range(400)]
    log = make_log(rows)
    with View(log, ViewSpec(conditions=(Condition("5"),), sort=Sort(0, ascending))) as view:
        before = find_positions(view, list(range(1, 61)))
        table = view.sorted_lines  # as any lookup of many lines leaves it
        assert table.bounds.count() > 1
        assert find_positions(view, list(range(1, 61))) == before
        assert find_positions(view, [10**6]) == {10**6: -1}
        line = next(n for n, p in before.items() if p >= 0)
        keyed, names, ups = _keyed(view)
        held = held_rows(table, ups, _targets(keyed, names, ups, [line]))
        plan = held._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters" in plan and "GreaterThanOrEqual(mid" in plan
        part = table.frame.where(table.within(table.mid_of(before[line]) >> 33))
        assert part.select(F.input_file_name()).distinct().count() == 1
        assert [tuple(r) for r in held.collect()] == [(line, before[line])]
        path = Path(table.path.removeprefix("file:"))
        assert path.exists()
    assert not path.exists()
