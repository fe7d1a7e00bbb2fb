"""Input checks: binary files and malformed UTF-8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablog.plans.durable import attach, durable
from tablog.plans.log import Log
from tablog.sources.scan import (
    Paths,
    distinct_paths,
    frozen_session,
    list_files,
    rebase,
    text_lines,
)

# Fixed value: a NUL byte among this many first bytes makes a file binary.
HEAD_BYTES = 8192
NUL = "\0"
# Up to this many suspicious files are named in the scan that checks them.
NAMED_FILES = 10_000
# Splits no shorter than the head, whatever the session says, so that the
# first split of a file holds it.
_HEAD_SPLITS = {"maxPartitionBytes": "128MB", "openCostInBytes": "4MB"}


class BinaryFileError(ValueError):
    """An input file is not text."""


class MalformedTextError(ValueError):
    """An input file is not valid UTF-8."""


def binary_paths(
    spark: SparkSession,
    paths: Paths,
    glob: str | None = None,
    only: list[str] | None = None,
) -> DataFrame:
    """``file_path`` of the files with a NUL byte in their head.

    Lines end at ``\\n`` only here, so that byte offsets are exact.  Two
    aggregations per file: the first line with a NUL, then the bytes before it.
    """
    own = frozen_session(spark, **_HEAD_SPLITS)
    head = rebase(spark, text_lines(own, paths, glob, "\n", only)).where("block_start = 0")

    value = F.col("value")
    first = durable(
        head.where(F.contains(value, F.lit(NUL)))
        .groupBy("file_path")
        .agg(F.min("mid").alias("nul_mid"))
    )
    before = F.when(F.col("mid") < F.col("nul_mid"), F.octet_length(value) + 1).otherwise(
        F.octet_length(F.substring_index(value, NUL, 1))
    )
    offsets = (
        attach(head, first, ["file_path"], spread="mid", how="inner")
        .where(F.col("mid") <= F.col("nul_mid"))
        .groupBy("file_path")
        .agg(F.sum(before).alias("offset"))
    )
    return offsets.where(F.col("offset") < HEAD_BYTES).select("file_path")


def binary_among(
    spark: SparkSession, paths: Paths, glob: str | None, suspects: DataFrame
) -> DataFrame:
    """``file_path`` of the binary files among those with a NUL near the start.

    Only the suspects are read again, unless they are too many to name.
    """
    named = [r[0] for r in suspects.limit(NAMED_FILES + 1).collect()]
    return durable(binary_paths(spark, paths, glob, named if len(named) <= NAMED_FILES else None))


def binary_files(spark: SparkSession, paths: Paths, glob: str | None = None) -> DataFrame:
    """``file_name, file_path, is_binary`` of every input file.

    One pass finds the files with a NUL near the start, which are then judged.
    """
    paths = distinct_paths(spark, paths, glob)
    lines = rebase(spark, text_lines(frozen_session(spark), paths, glob))
    near = (F.col("block_start") < HEAD_BYTES) & F.contains("value", F.lit(NUL))
    suspects = lines.where(near).select("file_path").distinct()
    found = binary_among(spark, paths, glob, suspects).withColumn("is_binary", F.lit(True))
    return (
        list_files(spark, paths, glob)
        .join(found, "file_path", "left")
        .select(
            "file_name", "file_path", F.coalesce("is_binary", F.lit(False)).alias("is_binary")
        )
    )


def malformed_lines(log: Log) -> DataFrame:
    """Lines that are not valid UTF-8, made readable.

    For a log read with ``on_malformed='keep'``.
    """
    return log.frame.where(~F.is_valid_utf8("value")).select(
        "file_name", "line_number", F.make_valid_utf8("value").alias("value")
    )
