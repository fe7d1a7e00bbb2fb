import pytest

from tablog.functions.text import pad_fields
from tablog.operators import columns as columns_module
from tablog.operators.columns import (
    ConfigConflictError,
    clear_config,
    config_from_json,
    config_to_json,
    delete_hidden,
    empty_config,
    hidden_for,
    load_config,
    read_config_json,
    save_config,
    update_config,
    upsert_hidden,
    with_hidden,
    write_config_json,
)
from tablog.operators.reshape import visible_fields
from tablog.plans.spec import hidden_columns, visible_columns
from pyspark.sql import functions as F


@pytest.fixture
def config(spark):
    def make(**entries):
        rows = [(k, v) for k, v in entries.items()]
        return spark.createDataFrame(rows, "file_name string, hidden array<int>")

    return make


def as_dict(df):
    return {r["file_name"]: r["hidden"] for r in df.collect()}


def test_visible_columns():
    assert visible_columns(4, [1, 3, 99, -1]) == [0, 2]
    assert visible_columns(2, []) == [0, 1]
    assert hidden_columns(4, [0, 2]) == [1, 3]


def test_read(spark, config):
    table = config(**{"a": [0, 2, 5], "sample-log_2024.01.01.tsv": [100, 200, 300], "e": []})
    assert hidden_for(table, "a") == [0, 2, 5]
    assert hidden_for(table, "sample-log_2024.01.01.tsv") == [100, 200, 300]
    assert hidden_for(table, "e") == [] == hidden_for(table, "stranger")
    assert hidden_for(empty_config(spark), "a") == []


def test_upsert_and_delete(config):
    table = config(a=[0, 1], b=[2])
    changed = upsert_hidden(table, config(a=[3, 4, 5], c=[]))
    assert as_dict(changed) == {"a": [3, 4, 5], "b": [2], "c": []}
    assert as_dict(delete_hidden(changed, ["a", "zzz"])) == {"b": [2], "c": []}
    assert as_dict(delete_hidden(changed, config(b=[], c=[]))) == {"a": [3, 4, 5]}
    assert as_dict(delete_hidden(changed, [])) == as_dict(changed)
    assert as_dict(clear_config(changed)) == {}


def test_saved_versions(spark, config, tmp_path):
    path = str(tmp_path / "config")
    assert as_dict(load_config(spark, path)) == {}
    save_config(config(a=[0, 2]), path)
    save_config(upsert_hidden(load_config(spark, path), config(b=[1])), path)
    assert as_dict(load_config(spark, path)) == {"a": [0, 2], "b": [1]}
    save_config(clear_config(load_config(spark, path)), path)
    assert as_dict(load_config(spark, path)) == {}


def test_half_written_version_is_not_read(spark, config, tmp_path):
    path = str(tmp_path / "config")
    save_config(config(a=[0]), path)
    config(b=[1]).write.parquet(f"{path}/.saving-x")
    assert as_dict(load_config(spark, path)) == {"a": [0]}


def test_two_savers_from_one_version(spark, config, tmp_path):
    path = str(tmp_path / "config")
    assert save_config(config(a=[0]), path) == 1
    # Both start from version 1; the first to publish wins and the other is told.
    mine = upsert_hidden(load_config(spark, path, 1), config(b=[1]))
    theirs = upsert_hidden(load_config(spark, path, 1), config(c=[2]))
    assert save_config(theirs, path, base=1) == 2
    with pytest.raises(ConfigConflictError):
        save_config(mine, path, base=1)
    assert as_dict(load_config(spark, path)) == {"a": [0], "c": [2]}
    assert not [p for p in (tmp_path / "config").iterdir() if p.name.startswith(".saving")]

    # An update goes on from what somebody else published meanwhile.
    turns = []

    def change(newest):
        turns.append(as_dict(newest))
        if len(turns) == 1:
            update_config(spark, path, lambda c: upsert_hidden(c, config(d=[3])))
        return upsert_hidden(newest, config(b=[1]))

    assert update_config(spark, path, change) == 4
    assert turns == [{"a": [0], "c": [2]}, {"a": [0], "c": [2], "d": [3]}]
    assert as_dict(load_config(spark, path)) == {"a": [0], "b": [1], "c": [2], "d": [3]}


def test_a_taken_number_is_never_shared(spark, config, tmp_path, monkeypatch):
    path = str(tmp_path / "config")
    save_config(config(a=[0]), path)
    save_config(config(a=[1]), path)
    # A saver that has not seen version 2 takes the next number after it.
    numbers = iter([1, 2])
    monkeypatch.setattr(columns_module, "newest_version", lambda *_: next(numbers))
    assert save_config(config(a=[2]), path) == 3
    monkeypatch.undo()
    assert [as_dict(load_config(spark, path, v)) for v in (1, 2, 3)] == [{"a": [0]}, {"a": [1]}, {"a": [2]}]


def test_old_versions_go(spark, config, tmp_path):
    path = str(tmp_path / "config")
    for i in range(5):
        save_config(config(a=[i]), path, keep=2)
    assert sorted(p.name for p in (tmp_path / "config").iterdir()) == ["version=4", "version=5"]
    assert as_dict(load_config(spark, path)) == {"a": [4]}


def test_json(spark, config, write, tmp_path):
    path = write("config.json", '{\n  "sample.tsv": [0, 2, 5],\n  "ü": []\n}'.encode())
    entries = {"sample.tsv": [0, 2, 5], "ü": []}
    assert as_dict(read_config_json(spark, path)) == entries
    assert as_dict(config_from_json(config_to_json(config(**entries)))) == entries
    assert as_dict(read_config_json(spark, str(tmp_path / "none.json"))) == {}


def test_hidden_per_file(spark, make_log, config):
    log = make_log([["a", "b", "c"], ["d"]], file_name="f")
    rows = with_hidden(log, config(f=[1, 9], g=[0]))
    shown = visible_fields(F.col("fields"), F.col("hidden"), 3)
    assert [r[0] for r in rows.orderBy("line_number").select(shown).collect()] == [
        ["a", "c"], ["d", ""],
    ]
    rows = with_hidden(log, config(g=[0])).select("hidden").collect()
    assert [r[0] for r in rows] == [[], []]


def test_hot_file_beyond_the_broadcast_size(spark, make_log, config, monkeypatch):
    from tablog.plans import durable

    monkeypatch.setattr(durable, "BROADCAST_BYTES", 0)
    log = make_log([["a", "b"]] * 200, file_name="f")
    rows = with_hidden(log, config(f=[1]))
    assert "SortMergeJoin" in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 200
    # All rows have one key: as many copies of its entry as the shuffle has tasks.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert durable.hot_keys(log.frame, ["file_name"]).first()["_salts"] == tasks
    two = log.frame.select(F.when(F.col("line_number") <= 20, F.col("line_number")).otherwise(0).alias("k"))
    hot = durable.hot_keys(two, ["k"]).collect()
    assert [(r["k"], r["_salts"]) for r in hot] == [(0, -(-180 * tasks // 200))]
    assert durable.hot_keys(two.where("k > 0"), ["k"]) is None
    assert {tuple(r["hidden"]) for r in rows.collect()} == {(1,)}


def test_pad(make_log):
    log = make_log([["a"], ["b", "c", "d"], []])
    padded = log.frame.select(pad_fields(log.fields, 2)).collect()
    assert [r[0] for r in padded] == [["a", ""], ["b", "c", "d"], ["", ""]]


def test_config_files_of_both_forms(spark, config, tmp_path, write):
    table = config(a=[0, 2], b=[], **{'q"{}': [1]})
    for lines in (False, True):
        path = str(tmp_path / f"c{lines}")
        write_config_json(table, path, lines=lines)
        assert as_dict(read_config_json(spark, path)) == as_dict(table)
    write_config_json(clear_config(table), str(tmp_path / "none"))
    assert as_dict(read_config_json(spark, str(tmp_path / "none"))) == {}
    for bad in ('{"a": [1]} {"b": [2]}', '{"a": [1]}\nrest', '{\n"a": [1]}\n{"b": [2]}', "[1]"):
        with pytest.raises(Exception, match="neither one JSON object"):
            read_config_json(spark, write("bad.json", bad.encode())).collect()


def test_names_are_unique(spark, config, make_log):
    twice = config(a=[1]).union(config(a=[2]))
    for use in (
        lambda: upsert_hidden(config(b=[0]), twice).collect(),
        lambda: with_hidden(make_log([["x"]], file_name="a"), twice).collect(),
    ):
        with pytest.raises(Exception, match="several entries for a"):
            use()
    updates = config(a=[1]).withColumn("turn", F.lit(2)).union(config(a=[2]).withColumn("turn", F.lit(1)))
    assert as_dict(upsert_hidden(config(a=[0], b=[0]), updates, order="turn")) == {"a": [1], "b": [0]}


def test_other_errors_are_not_an_absent_file(spark, monkeypatch):
    from pyspark.errors import AnalysisException

    def refuse(*args, **options):
        raise AnalysisException("denied", errorClass="OTHER")

    monkeypatch.setattr("pyspark.sql.readwriter.DataFrameReader.text", refuse)
    with pytest.raises(AnalysisException):
        read_config_json(spark, "/nowhere")
