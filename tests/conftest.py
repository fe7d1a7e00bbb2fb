import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tablog-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


ROWS = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("line_number", T.LongType()),
        T.StructField("fields", T.ArrayType(T.StringType())),
    ]
)


@pytest.fixture(scope="session")
def make_log(spark):
    """A log of literal rows: lists of fields, lines 1…n or as given."""
    from tablog import Log

    def make(rows, lines=None, file_name="f"):
        numbers = lines or range(1, len(rows) + 1)
        data = [(file_name, n, list(r)) for n, r in zip(numbers, rows)]
        return Log(frame=spark.createDataFrame(data, ROWS))

    return make


@pytest.fixture
def write(tmp_path):
    """Write bytes to a file of a test's own folder; returns its path."""

    def put(name, data):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
        return str(path)

    return put
