import __spark_entry__ as entry
import pytest
from pyspark.sql import functions as F


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(0, 7, "view", "a"), (1, 8, "error", "b"), (2, 9, "view", None), (3, 7, "error", None)]
    events = spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, props string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_wide_table_takes_its_width_from_the_rows(spark, folder):
    assert entry.event_files(spark, folder).columns is None
    wide = entry.queries()["wide_table_found"](spark, folder)
    assert wide.columns == ["file_name", "line_number", "col_0", "col_1", "col_2", "col_3"]
    assert sorted(map(tuple, wide.collect())) == [
        ("error", 2, "1", "8", "error", "b"),
        ("error", 4, "3", "7", "error", ""),
        ("view", 1, "0", "7", "view", ""),
        ("view", 3, "2", "9", "view", ""),
    ]


def test_hidden_columns_pad_to_the_width_of_the_rows(spark, folder):
    rows = entry.queries()["hidden_by_file_found"](spark, folder).orderBy(F.col("line_number"))
    # "view" hides column 0, "error" column 1.
    assert [r.text for r in rows.collect()] == ["7\tview\t", "1\terror\tb", "9\tview\t", "3\terror\t"]
