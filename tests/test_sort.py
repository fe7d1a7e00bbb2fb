import pytest

from tablog import Sort, View, ViewSpec


def order(log, sort, **spec):
    return [r["line_number"] for r in View(log, ViewSpec(sort=sort, **spec)).rows().collect()]


@pytest.mark.parametrize(
    "rows,sort,expected",
    [
        ([["c"], ["b"], ["a"]], Sort(), [1, 2, 3]),
        ([["c"], ["b"], ["a"]], Sort(ascending=False), [3, 2, 1]),
        ([["c"], ["b"], ["a"]], Sort(-1), [1, 2, 3]),
        ([["banana"], ["cherry"], ["apple"]], Sort(0), [3, 1, 2]),
        ([["banana"], ["cherry"], ["apple"]], Sort(0, False), [2, 1, 3]),
        ([["banana"], ["Apple"]], Sort(0), [2, 1]),
        ([["same"], ["SAME"], ["same"]], Sort(0), [1, 2, 3]),
        ([["same"], ["SAME"], ["same"]], Sort(0, False), [1, 2, 3]),
        ([["2"], ["10"]], Sort(0), [2, 1]),
        ([["a"], [""]], Sort(0), [2, 1]),
        ([["a", "b", "c", "d"], ["a"]], Sort(3), [2, 1]),
        ([["a", "b", "c", "d"], ["a"]], Sort(3, False), [1, 2]),
    ],
)
def test_order(make_log, rows, sort, expected):
    assert order(make_log(rows), sort) == expected


def test_text_orders_differ_beyond_the_basic_plane(make_log):
    log = make_log([["\uffee"], ["\U0001f600"]])
    assert order(log, Sort(0)) == [1, 2]
    assert order(log, Sort(0), text_order="utf16") == [2, 1]


def test_own_sort_key(make_log):
    from pyspark.sql import functions as F

    log = make_log([["a"], ["b", "c"], ["a", "c"]])
    assert order(log, Sort(0), order_by=((F.size("fields"), False),)) == [3, 2, 1]
