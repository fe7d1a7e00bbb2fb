import os

import pytest
from pyspark.sql import functions as F

from tablog import (
    Condition,
    Sort,
    View,
    ViewSpec,
    load_summary,
    log_from_table,
    log_from_texts,
    open_log,
    read_log,
    store_log,
    with_positions,
)
from tablog.operators.filters import needed_texts
from tablog.sources import search


def test_stored_log(spark, write, tmp_path):
    files = {"a": ["x\terror", "y", "Error\t"], "b": ["", "no\terror\tz"]}
    for name, lines in files.items():
        write(f"in/{name}", "\n".join(lines).encode())
    log = read_log(spark, str(tmp_path / "in"))
    path = str(tmp_path / "stored")
    store_log(log, path)
    again = open_log(spark, path)
    assert again.known_columns() == 3 and View(again).count() == 5
    for spec in (
        ViewSpec(),
        ViewSpec(conditions=(Condition("error"),)),
        ViewSpec(conditions=(Condition("error", 1),), sort=Sort(0, False)),
    ):
        want = with_positions(View(log, spec)).orderBy("position").collect()
        assert with_positions(View(again, spec)).orderBy("position").collect() == want


def test_stored_table(spark, make_log, tmp_path):
    log = make_log([["a", "b"], ["c"]])
    again = store_log(log, str(tmp_path / "stored"))
    assert again.rows.orderBy("line_number").collect() == log.rows.collect()
    assert again.known_columns() == 2


def test_summary_outlives_storing_and_choosing_a_file(spark, write, tmp_path):
    ten, five = b"".join(b"%d\n" % i for i in range(10)), b"a\tb\n" * 5
    write("in/x/one.tsv", ten), write("in/y/one.tsv", five), write("in/empty.tsv", b"")
    places = [f"{tmp_path}/in/{name}" for name in ("x", "y", "empty.tsv")]
    log = read_log(spark, places, max_rows=6)
    want = [("empty.tsv", 0, 0, False), ("one.tsv", 5, 2, False), ("one.tsv", 6, 1, True)]
    for kept in (log, store_log(log, str(tmp_path / "out"))):
        assert sorted(map(tuple, load_summary(kept).collect())) == want
        assert sorted(map(tuple, load_summary(kept.one_file("one.tsv")).collect())) == want[1:]
        (path,) = [r[0] for r in kept.frame.select("file_path").distinct().collect() if "/x/" in r[0]]
        part = kept.one_file(file_path=path)
        assert list(map(tuple, load_summary(part).collect())) == want[2:]
        assert part.frame.count() == 6
    with pytest.raises(ValueError):
        log.one_file()


def test_facts_of_texts_are_found_while_storing(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a b\nc"), (2, "d e f")], "id int, text string")
    log = store_log(log_from_texts(texts, "text", "id", separator=" "), str(tmp_path / "out"))
    assert (log.columns, log.total, log.max_line) == (3, 3, 2)


def test_only_the_asked_columns_are_sorted(spark):
    table = spark.createDataFrame([(2, "b", "wide"), (1, "a", "wide")], "k int, v string, w string")
    log = log_from_table(table, ["v"], order_by=[F.col("k")])
    assert [r["fields"] for r in log.frame.orderBy("line_number").collect()] == [["a"], ["b"]]
    stored = {os.path.dirname(path) for path in log.frame.inputFiles() if path.endswith(".parquet")}
    for path in stored:
        assert not {"k", "w"} & set(spark.read.parquet(path).columns)
    assert stored


@pytest.mark.parametrize("lines", [True, False])
def test_searches_read_only_files_that_may_match(spark, write, make_log, tmp_path, lines):
    words = ["alpha", "Beta", "gamma", "deLta", "ü日本語", "a.b*c", "zz"]
    texts = [[f"{w} {n}" for n in range(20)] for w in words]
    if lines:
        for i, rows in enumerate(texts):
            write(f"in/f{i}", "".join(f"{i}\t{x}\n" for x in rows).encode())
        spark.conf.set("spark.sql.files.openCostInBytes", "128m")  # a task, and so a stored file, for each
        log = read_log(spark, str(tmp_path / "in"))
    else:
        rows = [(7 * i + j, x) for i, own in enumerate(texts) for j, x in enumerate(own)]
        table = spark.createDataFrame([(n + 1, x) for n, (_, x) in enumerate(rows)], "n int, x string").repartitionByRange(7, "n")
        log = log_from_table(table, ["n", "x"], line_number=F.col("n"))
    plain = store_log(log, str(tmp_path / "plain"))
    stored = store_log(log, str(tmp_path / "stored"), searchable=True)
    spark.conf.unset("spark.sql.files.openCostInBytes")
    everything = stored.frame.select(F.input_file_name()).distinct().count()
    assert everything > 3
    for text in ["beta", "GAMMA 1", "ü日本", "/a.b.*/", "/(al|be)pha 3/", "/delta.*/", "/deLta 1.*/", "a.b*", "zz", "nowhere"]:
        for column in (None, 1):
            spec = ViewSpec(conditions=(Condition(text, column),))
            view = View(stored, spec)
            want = sorted(map(tuple, View(plain, spec).rows().collect()))
            assert sorted(map(tuple, view.rows().collect())) == want, text
            if text in ("beta", "GAMMA 1", "ü日本", "/deLta 1.*/", "a.b*"):
                scanned = [r for r in stored.holding(needed_texts(spec)).select(F.input_file_name()).distinct().collect()]
                assert len(scanned) < everything, text
    assert stored.holding(["nowhere"]).count() == 0
    assert stored.holding(["zz"]) is None  # too short to tell
    # Two conditions narrow the search together; one of another kind does not get in the way.
    both = ViewSpec(conditions=(Condition("beta"), Condition("gamma")))
    assert View(stored, both).count() == 0


def test_filters_are_made_without_sorting_every_three_letters(spark, tmp_path, monkeypatch):
    lines = [(f"{'Abcab' * 50} ü日{n % 7}",) for n in range(2000)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(lines, "value string").repartition(2).write.parquet(path)
    wrote = []
    monkeypatch.setattr(type(spark.range(0).write), "parquet", lambda self, path: wrote.append(self._df))
    search.write_filters(spark.read.parquet(path), F.col("value"), "nowhere")
    (filters,) = wrote
    wanted = {x[i : i + 3].lower() for (x,) in lines for i in range(len(x) - 2)}
    bits = spark.createDataFrame([(t,) for t in wanted], "t string").select(F.pmod(F.xxhash64("t"), F.lit(search.BITS)))
    want = {r[0] for r in bits.collect()}
    found = {}
    for r in filters.collect():
        places = [8 * i + j for i, byte in enumerate(bytes(r.bits)) for j in range(8) if byte >> j & 1]
        found.setdefault(r.file, set()).update(r.bucket * search.BITMAP + at for at in places)
    assert list(found.values()) == [want, want]
    # What the letters pass first takes each bit once, in a hash table.
    plan = filters._jdf.queryExecution().executedPlan().toString().split("Generate explode")[0]
    assert "HashAggregate" in plan.split("SortAggregate")[-1]
