"""A loaded log kept as Parquet, for searching it again and again."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tablog.plans.log import Log
from tablog.sources.search import files_that_may_hold, write_filters

# Facts about a log that hold for its stored copy, too.
FACTS = (
    "order array<string>, separator string, lines boolean, raw boolean, columns int, "
    "cells array<string>, total bigint, max_line bigint, dense boolean, summarized boolean, "
    "searchable boolean"
)


def store_log(log: Log, path: str, searchable: bool = False) -> Log:
    """Write the log's rows with their line numbers and open the copy.

    ``searchable`` writes a filter of the letters in each file beside them,
    which takes another pass; searches for three letters or more, and patterns
    that require them, then read only files that may match.

    Rows are written where they are, without a shuffle; the line stands in for
    its fields, and facts not known yet are observed meanwhile.  The load
    summary, if the log has one, is written beside them.  Opening the copy
    again needs no pass over the rows.
    """
    seen = Observation()
    frame = log.frame.observe(
        seen,
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.max(F.size("fields")), F.lit(0)).alias("columns"),
        F.coalesce(F.max("line_number"), F.lit(0)).alias("max_line"),
    )
    paths = ["file_path"] if "file_path" in frame.columns else []
    kept = ["file_name", *paths, "line_number", *log.order, *log.body]
    frame.select(*dict.fromkeys(kept)).write.mode("overwrite").parquet(
        f"{path}/rows", compression="zstd"
    )
    spark = log.frame.sparkSession
    names = [fact.split()[0] for fact in FACTS.split(", ")]
    found = {name: getattr(log, name, None) for name in names}
    found |= {name: value for name, value in seen.get.items() if found[name] is None}
    found["summarized"], found["searchable"] = log.summarize is not None, searchable
    if searchable:
        stored = spark.read.parquet(f"{path}/rows")
        text = F.col("value") if log.lines else F.array_join(log.from_body(), "\n")
        write_filters(stored, text, f"{path}/search")
    if log.summarize is not None:
        log.summarize().write.mode("overwrite").parquet(f"{path}/summary")
    row = spark.createDataFrame([tuple(found[name] for name in names)], FACTS)
    row.write.mode("overwrite").json(f"{path}/about")
    return open_log(spark, path)


def open_log(spark: SparkSession, path: str) -> Log:
    """A log written by :func:`store_log`."""
    about = spark.read.schema(FACTS).json(f"{path}/about").first().asDict()
    rows = spark.read.parquet(f"{path}/rows")
    if about.pop("summarized"):
        about["summarize"] = lambda: spark.read.parquet(f"{path}/summary")
    searchable = about.pop("searchable")
    for name in ("order", "cells"):
        about[name] = tuple(about[name])
    log = Log(frame=rows, **about)

    def shown(found: DataFrame) -> DataFrame:
        return found if "fields" in rows.columns else found.select("*", log.from_body())

    def holding(texts: list[str]) -> DataFrame | None:
        names = files_that_may_hold(spark, f"{path}/search", texts)
        if names is None:
            return None
        # A condition on file names prunes the list of files before any is read.
        return shown(rows.where(F.col("_metadata.file_name").isin(names)))

    return replace(log, frame=shown(rows), holding=holding if searchable else None)
