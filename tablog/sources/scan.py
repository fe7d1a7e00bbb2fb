"""A text scan whose splits stay the same in every evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablog.operators.numbering import rank_rows

Paths = str | list[str]
PathRange = tuple[str | None, str | None]


def frozen_session(spark: SparkSession, **settings: str) -> SparkSession:
    """A session with a copy of the settings, kept by one scan.

    Where a file is split depends on session settings and on the number of
    cores at planning time, which dynamic allocation changes.  Numbering lines
    takes two passes over the same splits, so the scan holds on to its own.
    """
    own = spark.newSession()
    for name, setting in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            own.conf.set(name, setting)
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        cores = spark.sparkContext.defaultParallelism
        own.conf.set("spark.sql.files.minPartitionNum", str(cores))
    for name, setting in settings.items():
        own.conf.set(f"spark.sql.files.{name}", setting)
    return own


def distinct_paths(spark: SparkSession, paths: Paths, glob: str | None = None) -> list[str]:
    """The given paths, each once; a file reached in two ways is refused.

    Spark would read such a file twice, and its lines would have two numbers.
    Each path is resolved to its files, so it does not matter how it is spelled.
    """
    given = [paths] if isinstance(paths, str) else list(paths)
    names = list(dict.fromkeys(p.rstrip("/") or "/" for p in given))
    if len(names) > 1:
        listed = [
            list_files(spark, name, glob).select("file_path", F.lit(name).alias("given"))
            for name in names
        ]
        twice = (
            reduce(DataFrame.union, listed)
            .groupBy("file_path")
            .agg(F.sort_array(F.collect_list("given")).alias("given"))
            .where(F.size("given") > 1)
            .first()
        )
        if twice is not None:
            raise ValueError(f"{twice['file_path']} is part of {' and '.join(twice['given'])}")
    return names


def rebase(spark: SparkSession, df: DataFrame) -> DataFrame:
    """The same plan seen from ``spark``; the empty branch is optimized away."""
    nothing = spark.range(1).where("false")
    empty = nothing.select(
        *[F.lit(None).cast(c.dataType).alias(c.name) for c in df.schema]
    )
    return empty.unionByName(df)


def _text(
    spark: SparkSession, paths: Paths, glob: str | None, line_end: str | None = None
) -> DataFrame:
    reader = spark.read
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    if line_end is not None:
        reader = reader.option("lineSep", line_end)
    return reader.text(paths)


def text_lines(
    own: SparkSession,
    paths: Paths,
    glob: str | None = None,
    line_end: str | None = None,
    only: list[str] | None = None,
    between: PathRange = (None, None),
) -> DataFrame:
    """``value, file_path, block_start, mid``: lines with the split they came from.

    ``mid`` grows by one from line to line of a split.  Without ``line_end``,
    ``\\n``, ``\\r`` and ``\\r\\n`` all end a line.  ``only`` and ``between``
    (from the first path on, up to the second) prune the file list before
    anything is read.
    """
    lines = _text(own, paths, glob, line_end)
    path = F.col("_metadata.file_path")
    if only is not None:
        lines = lines.where(path.isin(only))
    if between[0] is not None:
        lines = lines.where(path >= between[0])
    if between[1] is not None:
        lines = lines.where(path < between[1])
    return lines.select(
        "value",
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("mid"),
    )


def bare_name(file_path: Column) -> Column:
    """File name without its folder; metadata paths are percent-encoded."""
    encoded = F.substring_index(file_path, "/", -1)
    return F.url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))


def list_files(spark: SparkSession, paths: Paths, glob: str | None = None) -> DataFrame:
    """``file_path, file_name`` of every input file.

    Scans leave out empty files, so the names come from the listing the
    driver's JVM holds; no content is read and no name comes to Python.
    """
    jvm = spark._jvm
    listed = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(
        _text(spark, paths, glob)._jdf.inputFiles()
    )
    listed = jvm.scala.jdk.javaapi.CollectionConverters.asJava(listed)
    names = spark._jsparkSession.createDataset(listed, jvm.org.apache.spark.sql.Encoders.STRING())
    # Metadata paths write an empty authority as file:/x, listings as file:///x.
    path = F.regexp_replace("value", r"^(\w+):///", "$1:/")
    files = DataFrame(names.toDF(), spark).select(path.alias("file_path"))
    return files.withColumn("file_name", bare_name(F.col("file_path")))


def path_slices(
    spark: SparkSession, own: SparkSession, paths: Paths, glob: str | None, splits: int
) -> list[PathRange]:
    """Ranges of paths that together hold all files, of about ``splits`` splits each.

    From the number and size of the files the driver's JVM has listed; a range
    holds one file at least.
    """
    plan = _text(own, paths, glob)._jdf
    files = len(plan.inputFiles())
    size = int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))
    settings = plan.sparkSession().sessionState().conf()
    opening = settings.filesOpenCostInBytes()
    tasks = int(own.conf.get("spark.sql.files.minPartitionNum"))
    split = min(settings.filesMaxPartitionBytes(), max(opening, (size + files * opening) // tasks))
    number = min(-(-(files + size // split) // splits), files)
    if number <= 1:
        return [(None, None)]
    ranked = rank_rows(list_files(spark, paths, glob).select("file_path"), ["file_path"], "n", files)
    first = ranked.where((F.col("n") > 0) & (F.col("n") % -(-files // number) == 0))
    cuts = [row["file_path"] for row in first.orderBy("n").collect()]  # one path per slice
    return list(zip([None, *cuts], [*cuts, None]))
