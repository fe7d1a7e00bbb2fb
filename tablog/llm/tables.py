"""Intermediate tables, written to the shared folder and removed after use."""

from __future__ import annotations

from types import TracebackType

from pyspark.sql import DataFrame, SparkSession

from tablog.plans.durable import scratch_path


class Written:
    """Tables that live as long as a ``with`` block; what outlives it must not read them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Written:
        return self

    def keep(self, rows: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
        """The rows, written as Parquet and read again."""
        return self.keep_all([rows], label, compression)

    def keep_all(self, parts: list[DataFrame], label: str, compression: str = "snappy") -> DataFrame:
        """The rows of all ``parts``, written one part after the other."""
        path = scratch_path(self.spark, label)
        self.paths.append(path)
        for rows in parts:
            rows.write.parquet(path, mode="append", compression=compression)
        return self.spark.read.schema(parts[0].schema).parquet(path)

    def __exit__(
        self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None
    ) -> None:
        configuration = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(configuration).delete(target, True)
