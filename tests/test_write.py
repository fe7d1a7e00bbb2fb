from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tablog import Condition, Sort, View, ViewSpec, read_log, write_rows_at, write_view
from tablog.sources.table import log_from_table


def content(path):
    parts = sorted(p for p in Path(path).iterdir() if p.name.startswith("part-"))
    return b"".join(p.read_bytes() for p in parts).decode()


ROWS = [["col1", "col2", "col3"], ["val1", "val2", "val3"], ["data1", "data2", "data3"]]


def test_view(make_log, tmp_path):
    out = str(tmp_path / "out")
    assert write_view(View(make_log(ROWS)), out) == 3
    assert content(out) == "col1\tcol2\tcol3\r\nval1\tval2\tval3\r\ndata1\tdata2\tdata3\r\n"
    # Replaces what was there, in view order, visible columns only.
    spec = ViewSpec(conditions=(Condition("l"),), sort=Sort(0, False), hidden=(1,))
    assert write_view(View(make_log(ROWS), spec), out) == 2
    assert content(out) == "val1\tval3\r\ncol1\tcol3\r\n"


def test_short_rows_are_padded(make_log, tmp_path):
    log = make_log([["a"], ["", "日本語", "データ"]])
    assert write_view(View(log), str(tmp_path / "out")) == 2
    assert content(tmp_path / "out") == "a\t\t\r\n\t日本語\tデータ\r\n"


def test_order_over_part_files(spark, make_log, tmp_path):
    rows = [[f"k{i * 7919 % 1000:03d}", str(i)] for i in range(1000)]
    view = View(make_log(rows), ViewSpec(sort=Sort(0)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert write_view(view, str(tmp_path / "out")) == 1000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    lines = content(tmp_path / "out").split("\r\n")[:-1]
    assert lines == sorted(lines) and len(lines) == 1000
    assert len(list((tmp_path / "out").glob("part-*"))) > 1


def test_many_files_in_line_order_without_sampling(spark, write, tmp_path):
    for i in range(100):
        write(f"in/f{i:02}", "".join(f"{i}\t{j}\n" for j in range(i % 7)).encode())
    log = read_log(spark, str(tmp_path / "in"))
    for conditions, keep in [((), lambda j: True), ((Condition("/[135]/", 1),), lambda j: j in (1, 3, 5))]:
        view = View(log, ViewSpec(conditions=conditions))
        plan = view.ordered(F.col("value").alias("value"))._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan
        want = [f"{i}\t{j}\r\n" for i in range(100) for j in range(i % 7) if keep(j)]
        out = tmp_path / f"out{len(conditions)}"
        assert write_view(view, str(out)) == len(want)
        assert content(out) == "".join(want)


def test_chosen_rows(spark, make_log, tmp_path):
    log = make_log([["row0col1", "row0col2"], ["row1col1", "x"], ["row2col1", "row2col2"]])
    out = str(tmp_path / "out")
    assert write_rows_at(View(log), [2, 0, 2], out) == 2
    assert content(out) == "row0col1\trow0col2\r\nrow2col1\trow2col2\r\n"
    assert write_rows_at(View(make_log([["a", "b"]])), [0, 5, 100], out) == 1
    assert content(out) == "a\tb\r\n"
    table = spark.createDataFrame([(1,), (9,)], "position int")
    assert write_rows_at(View(log), table, out) == 1
    assert content(out) == "row1col1\tx\r\n"


def test_nothing_to_write(spark, make_log, tmp_path):
    out = tmp_path / "out"
    log = make_log(ROWS)
    empty = View(log, ViewSpec(conditions=(Condition("zzz"),)))
    blind = View(log, ViewSpec(hidden=(0, 1, 2)))
    assert write_view(empty, str(out)) == 0
    assert write_rows_at(empty, [0], str(out)) == 0
    assert write_rows_at(View(log), [], str(out)) == 0
    assert write_rows_at(View(log), spark.createDataFrame([], "position int"), str(out)) == 0
    assert write_rows_at(blind, [0], str(out)) == 0
    assert not out.exists()
    # A view without visible columns writes one empty line per row.
    assert write_view(blind, str(out)) == 3
    assert content(out) == "\r\n" * 3


def test_no_rows_at_far_positions(make_log, tmp_path):
    assert write_rows_at(View(make_log(ROWS)), [50], str(tmp_path / "out")) == 0


@pytest.mark.parametrize("bad", ["a\tb", "a\nb", "a\rb"])
def test_fields_that_would_not_read_back(spark, tmp_path, bad):
    df = spark.createDataFrame([(1, bad, None)], "n bigint, x string, y string")
    view = View(log_from_table(df, ["x", "y"], line_number=df["n"]))
    with pytest.raises(Exception, match="tab or a line end"):
        write_view(view, str(tmp_path / "out"))
    assert write_view(view, str(tmp_path / "out"), on_conflict="replace") == 1
    assert content(tmp_path / "out") == "a b\t\r\n"


def test_files_with_another_separator(spark, write, tmp_path):
    log = read_log(spark, write("a", b"x\ty,z\n"), separator=",")
    with pytest.raises(Exception, match="tab or a line end"):
        write_view(View(log), str(tmp_path / "out"))


def test_round_trip(spark, make_log, write, tmp_path):
    data = "".join(f"{i}\t{'x' * (i % 7)}\t\r\n" for i in range(500))
    log = read_log(spark, write("a", data.encode()))
    out = str(tmp_path / "out")
    assert write_view(View(log), out) == 500
    assert content(out) == data
    again = read_log(spark, out)
    assert View(again).count() == 500 and again.known_columns() == 3


def test_compressed(spark, make_log, tmp_path):
    out = str(tmp_path / "out")
    assert write_view(View(make_log(ROWS)), out, compression="gzip") == 3
    back = read_log(spark, out)
    assert sorted(r["fields"] for r in back.rows.collect()) == sorted(ROWS)
