"""Hidden columns per file: a table ``file_name, hidden ARRAY<INT>``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablog.plans.durable import attach, remove_path
from tablog.plans.log import Log

SCHEMA = "file_name string, hidden array<int>"
JSON_TYPE = "map<string,array<int>>"
# Versions of a saved config that stay.
KEPT_VERSIONS = 10


def empty_config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def config_from_json(texts: DataFrame, column: str = "value") -> DataFrame:
    """Entries of JSON objects ``{"file name": [index, …]}``."""
    entries = F.explode(F.from_json(F.col(column), JSON_TYPE)).alias("file_name", "hidden")
    return texts.select(entries)


def read_config_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON file; an absent file has none.

    The file holds one object, over any number of lines, or one object per
    line; anything else is an error.
    """
    try:
        texts = spark.read.text(path, wholetext=True)
    except AnalysisException as error:
        if _absent(error):
            return empty_config(spark)
        raise
    lines = F.filter(F.split("value", "[\r\n]+"), lambda line: F.trim(line) != "")
    by_line = F.forall(lines, lambda line: _is_object(line))
    objects = (
        F.when(by_line, lines)
        .when(_is_object(F.col("value")), F.array("value"))
        .otherwise(F.raise_error("the config is neither one JSON object nor one per line").cast("array<string>"))
    )
    return config_from_json(texts.select(F.explode(objects).alias("value")))


def _is_object(text: Column) -> Column:
    """Whether the text is one JSON object of index lists, with nothing after it."""
    found = F.from_json(text, JSON_TYPE)
    # What is left after all names and lists of the object are taken away.
    name, indices = r'"(?:[^"\\]|\\.)*"', r"\[[-\d\s,]*\]"
    rest = F.regexp_replace(text, rf"{name}\s*:\s*{indices}", "")
    return found.isNotNull() & rest.rlike(r"\A\s*\{[\s,]*\}\s*\z")


def config_to_json(config: DataFrame) -> DataFrame:
    """One JSON object ``value`` per entry, readable by :func:`config_from_json`."""
    entry = F.create_map(F.col("file_name"), F.col("hidden"))
    return config.select(F.to_json(entry).alias("value"))


def write_config_json(config: DataFrame, path: str, lines: bool = False) -> None:
    """Write the config as one JSON object, or as one object per line (``lines``).

    One object is one text: for configs that a person edits.  Larger ones are
    written by line, in parallel.  Both are read by :func:`read_config_json`.
    """
    config = unique_names(config)
    if lines:
        rows = config_to_json(config)
    else:
        entries = F.map_from_entries(F.collect_list(F.struct("file_name", "hidden")))
        rows = config.agg(F.to_json(entries).alias("value"))
    rows.write.mode("overwrite").text(path)


def unique_names(config: DataFrame, order: str | None = None) -> DataFrame:
    """The config with one entry per file name.

    Of several, the one with the largest value of the column ``order`` counts;
    without such a column they are an error.
    """
    if order is not None:
        return config.groupBy("file_name").agg(F.max_by("hidden", order).alias("hidden"))
    message = F.concat(F.lit("several entries for "), F.col("file_name"))
    once = F.when(F.count(F.lit(1)) == 1, F.any_value("hidden")).otherwise(
        F.raise_error(message).cast("array<int>")
    )
    return config.groupBy("file_name").agg(once.alias("hidden"))


def _absent(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def hidden_for(config: DataFrame, file_name: str) -> list[int]:
    """Hidden columns of one file; none if it has no entry."""
    row = config.where(F.col("file_name") == file_name).first()
    return list(row["hidden"]) if row is not None else []


def upsert_hidden(config: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """``updates`` replace entries of the same file; the others stay.

    Of several updates of one file the last by the column ``order`` counts;
    without it they are an error.
    """
    updates = unique_names(updates, order)
    kept = config.join(updates.select("file_name"), "file_name", "left_anti")
    return kept.select("file_name", "hidden").unionByName(updates)


def delete_hidden(config: DataFrame, names: DataFrame | list[str]) -> DataFrame:
    """The config without some files' entries; unknown names are no error."""
    if isinstance(names, DataFrame):
        return config.join(names.select("file_name").distinct(), "file_name", "left_anti")
    return config.where(~F.col("file_name").isin(names)) if names else config


def clear_config(config: DataFrame) -> DataFrame:
    return config.where("false")


class ConfigConflictError(RuntimeError):
    """Somebody else has published a version since the one that was changed."""


def save_config(
    config: DataFrame, path: str, base: int | None = None, keep: int = KEPT_VERSIONS
) -> int:
    """Publish the config as the next version and return its number.

    The entries are written aside and then renamed to the version's folder,
    which fails if the folder is there: a version is whole or absent, and two
    savers never share one.  ``base`` is the version that was changed
    (:func:`newest_version`, 0 for none); if there is a newer one by now,
    ``ConfigConflictError`` says so and nothing is published.  Without it the
    config replaces whatever is newest.  Only the last ``keep`` versions stay,
    so a reader may finish while others save.
    """
    spark = config.sparkSession
    aside = f"{path}/.saving-{uuid.uuid4().hex}"
    config.select("file_name", "hidden").write.parquet(aside)
    try:
        while True:
            newest = newest_version(spark, path)
            if base is not None and newest != base:
                raise ConfigConflictError(f"version {newest} of {path} is newer than {base}")
            if _renamed(spark, aside, _version_path(path, newest + 1)):
                break
    except BaseException:
        remove_path(spark, aside)
        raise
    for version in _versions(spark, path):
        if version <= newest + 1 - keep:
            remove_path(spark, _version_path(path, version))
    return newest + 1


def update_config(
    spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], keep: int = KEPT_VERSIONS
) -> int:
    """Publish what ``change`` makes of the newest version; its number.

    If somebody else publishes in between, the change is made anew from theirs,
    so no update is lost.
    """
    while True:
        base = newest_version(spark, path)
        try:
            return save_config(change(load_config(spark, path, base)), path, base, keep)
        except ConfigConflictError:
            continue


def newest_version(spark: SparkSession, path: str) -> int:
    """Number of the newest version of a saved config, 0 if there is none."""
    return max(_versions(spark, path), default=0)


def load_config(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a saved config, by default the newest; empty if there is none."""
    version = newest_version(spark, path) if version is None else version
    if version == 0:
        return empty_config(spark)
    stored = spark.read.schema(SCHEMA).parquet(_version_path(path, version))
    return stored.where(F.col("file_name").isNotNull())


def _version_path(path: str, version: int) -> str:
    return f"{path}/version={version}"


def _renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder; False if the target exists.  Atomic where the file system's rename is."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    configuration = spark.sparkContext._jsc.hadoopConfiguration()
    old, new = hadoop.Path(source), hadoop.Path(target)
    qualified = new.getFileSystem(configuration).makeQualified(new)
    files = hadoop.FileContext.getFileContext(qualified.toUri(), configuration)
    no_options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    try:
        files.rename(old, new, no_options)
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions published, from the names of their folders."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return [int(n.removeprefix("version=")) for n in names if n.startswith("version=")]


def with_hidden(log: Log, config: DataFrame, key: str = "file_name") -> DataFrame:
    """The log's rows with the ``hidden`` columns of their file (none: empty array).

    ``key='file_path'`` tells files of the same name in two folders apart; the
    config then holds paths.
    """
    lookup = unique_names(config).withColumnRenamed("file_name", key)
    joined = attach(log.frame, lookup, [key], spread="line_number")
    return joined.withColumn(
        "hidden", F.coalesce("hidden", F.array().cast("array<int>"))
    )
