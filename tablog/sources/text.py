"""Delimited text files as a log with exact original line numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablog.functions.text import split_fields
from tablog.operators.numbering import rank_rows, running
from tablog.plans.durable import broadcast_limit, durable
from tablog.plans.log import Log
from tablog.sources.checks import (
    HEAD_BYTES,
    NUL,
    BinaryFileError,
    MalformedTextError,
    binary_among,
)
from tablog.sources.scan import (
    Paths,
    bare_name,
    distinct_paths,
    frozen_session,
    list_files,
    path_slices,
    rebase,
    text_lines,
)

# White-space separators cannot be part of a match within one field and do not
# influence case folding, so the raw line may be searched in place of fields.
RAW_SEPARATORS = ("\t", " ")
# What numbering needs to know about a split.
PLACE = ["first_mid", "lines", "lines_before", "block_no", "first"]
# Size of that in memory, with its key.
ENTRY_BYTES = 64


def read_log(
    spark: SparkSession,
    paths: Paths,
    separator: str = "\t",
    max_rows: int | None = None,
    on_binary: str = "error",
    on_malformed: str = "error",
    glob: str | None = None,
) -> Log:
    """Read text files of any name as ragged rows of text fields.

    No header, quoting, escaping or comments.  ``max_rows`` keeps the first
    lines of each file.  ``on_binary`` is ``error`` or ``skip``;
    ``on_malformed`` is ``error``, ``drop``, ``replace`` or ``keep`` (for
    :func:`~tablog.sources.checks.malformed_lines`).

    One pass profiles the splits (lines, widths, bad bytes) and later passes
    read lines and number them by a lookup of their split; the lines
    themselves are never shuffled.  Very many files are read in slices of the
    file list, each with a lookup of its own that is broadcast.
    """
    _one_of("on_binary", on_binary, ("error", "skip"))
    _one_of("on_malformed", on_malformed, ("error", "drop", "replace", "keep"))
    if not separator:
        raise ValueError("the separator must not be empty")
    paths = distinct_paths(spark, paths, glob)
    own = frozen_session(spark)
    ranges = path_slices(spark, own, paths, glob, max(broadcast_limit(spark) // ENTRY_BYTES, 1))
    slices = [rebase(spark, text_lines(own, paths, glob, between=r)) for r in ranges]

    profile = durable(_profile(slices, separator))
    splits, suspects = profile.agg(F.count(F.lit(1)), F.count_if("nul")).first()
    binary = None
    if suspects:
        named = profile.where("nul").select("file_path").distinct()
        binary = binary_among(spark, paths, glob, named)
        binary = None if binary.isEmpty() else binary
    skipped = None
    if binary is not None:
        if on_binary == "error":
            names = [r[0] for r in binary.limit(5).collect()]
            raise BinaryFileError(f"binary files cannot be read: {names}")
        skipped = profile.join(binary, "file_path", "left_semi")
        profile = profile.join(binary, "file_path", "left_anti")
    blocks = durable(_blocks(profile, max_rows, splits))
    facts = _facts(blocks)

    malformed = facts["malformed"] > 0
    if malformed and on_malformed == "error":
        bad = blocks.where("bad_line <= lines_before + kept").orderBy("block_no")
        places = [tuple(r) for r in bad.select("file_name", "bad_line").limit(5).collect()]
        raise MalformedTextError(f"malformed UTF-8 at (file, line) {places}")

    unique = facts["keys"] == facts["blocks"]

    def finished(frame: DataFrame) -> DataFrame:
        if facts["files"] == 1:
            names = {name: F.lit(facts[name]) for name in ("file_name", "file_path")}
            frame = frame.withColumns(names)
        if facts["cut"]:
            frame = frame.where(F.col("line_number") <= max_rows)
        if malformed and on_malformed == "drop":
            frame = frame.where(F.is_valid_utf8("value"))
        if malformed and on_malformed == "replace":
            frame = frame.withColumn("value", F.make_valid_utf8("value"))
        return frame.withColumn("fields", split_fields(F.col("value"), separator))

    def part(names: list[str]) -> DataFrame:
        """Some text files, read alone: fewer files may be split at other places."""
        lines = rebase(spark, text_lines(own, paths, glob, only=names))
        own_profile = durable(_profile([lines], separator))
        own_blocks = durable(_blocks(own_profile, max_rows, own_profile.count()))
        return finished(_number([lines], own_blocks, None, unique=False))

    frame = finished(_number(slices, blocks, skipped, unique))
    dropped = malformed and on_malformed == "drop"
    exact = not dropped and not facts["cut_inside"]
    return Log(
        frame=frame,
        order=("line_number",) if facts["files"] <= 1 else ("block_no", "line_number"),
        separator=separator,
        lines=True,
        raw=separator in RAW_SEPARATORS and not (malformed and on_malformed == "keep"),
        columns=facts["columns"] if exact else None,
        total=None if dropped else facts["kept"],
        max_line=None if dropped else facts["max_line"],
        dense=facts["files"] <= 1 and not dropped,
        blocked=True,
        in_order=facts["files"] <= 1 and facts["backward"] == 0,
        placed=facts["kept"],
        blocks=blocks.select("block_no", "file_path", F.col("kept").alias("rows"), "first"),
        part=part if facts["files"] > 1 else None,
        tasks=splits,
        summarize=lambda: _summary(
            list_files(spark, paths, glob), blocks, binary, frame, exact
        ),
    )


def _one_of(name: str, given: str, allowed: tuple[str, ...]) -> None:
    if given not in allowed:
        raise ValueError(f"{name} must be one of {allowed}, not {given!r}")


def _profile(slices: list[DataFrame], separator: str) -> DataFrame:
    """One row per split: what a single pass over its lines tells."""
    numbered = [lines.withColumn("slice", F.lit(i)) for i, lines in enumerate(slices)]
    lines = reduce(DataFrame.union, numbered)
    value = F.col("value")
    in_head = F.col("block_start") < HEAD_BYTES
    return lines.groupBy("slice", "file_path", "block_start").agg(
        F.count(F.lit(1)).alias("lines"),
        F.min("mid").alias("first_mid"),
        F.max(F.size(split_fields(value, separator))).alias("width"),
        F.min(F.when(~F.is_valid_utf8(value), F.col("mid"))).alias("bad_mid"),
        F.max(in_head & F.contains(value, F.lit(NUL))).alias("nul"),
    )


def _blocks(profile: DataFrame, max_rows: int | None, splits: int) -> DataFrame:
    """The profile with running line counts per file and a rank over all splits.

    ``backward`` marks a split the scan meets before the one ahead of it in
    the file.
    """
    file = Window.partitionBy("file_path").orderBy("block_start")
    before = file.rowsBetween(Window.unboundedPreceding, -1)
    ranked = rank_rows(profile, ["file_path", "block_start"], "block_no", splits)
    ahead = F.coalesce(F.sum("lines").over(before), F.lit(0))
    kept = F.col("lines")
    if max_rows is not None:
        kept = F.greatest(F.least(kept, F.lit(max_rows) - F.col("lines_before")), F.lit(0))
    placed = ranked.withColumn("lines_before", ahead).withColumn("kept", kept)
    counts = placed.select("block_no", F.col("kept").alias("rows"))
    firsts = running(counts, "block_no", splits).select("block_no", "first")
    return (
        placed.join(firsts, "block_no")
        .withColumn("backward", F.lag("first_mid").over(file) > F.col("first_mid"))
        .withColumn("bad_line", F.col("bad_mid") - F.col("first_mid") + F.col("lines_before") + 1)
        .withColumn("file_name", bare_name(F.col("file_path")))
        .withColumn("block_key", F.xxhash64("file_path", "block_start"))
        .drop("bad_mid", "nul")
    )


def _facts(blocks: DataFrame) -> dict:
    retained = F.col("kept") > 0
    cut = F.col("kept") < F.col("lines")
    end = F.col("lines_before") + F.col("kept")

    def total(column: Column) -> Column:
        return F.coalesce(column, F.lit(0))

    row = blocks.agg(
        F.count(F.lit(1)).alias("blocks"),
        F.count_distinct("block_key").alias("keys"),
        F.count_if(F.col("lines_before") == 0).alias("files"),
        F.min("file_name").alias("file_name"),
        F.min("file_path").alias("file_path"),
        total(F.sum("kept")).alias("kept"),
        total(F.max(end)).alias("max_line"),
        total(F.max(F.when(retained, F.col("width")))).alias("columns"),
        F.count_if(cut).alias("cut"),
        F.count_if(cut & retained).alias("cut_inside"),
        F.count_if(F.col("bad_line") <= end).alias("malformed"),
        F.count_if("backward").alias("backward"),
    ).first()
    return row.asDict()


def _number(
    slices: list[DataFrame], blocks: DataFrame, skipped: DataFrame | None, unique: bool
) -> DataFrame:
    """Lines with their number, by a lookup of the split they came from.

    The lookup is six numbers a split, fewer than Spark's driver itself keeps of
    it; the path comes with the line.  Each slice of the files has its own,
    which is broadcast, so lines stay where they are read.
    """
    place = ["file_path", "block_start"]
    key = F.xxhash64(*place).alias("block_key")
    keys = ["block_key"] if unique else place
    lookup = blocks.select("slice", *keys, *PLACE)
    if skipped is not None:  # known splits whose lines are left out
        out = skipped.select("slice", *place, key, F.lit(True).alias("out")).select("slice", *keys, "out")
        lookup = lookup.unionByName(out, allowMissingColumns=True)
    found = []
    for i, lines in enumerate(slices):
        keyed = lines.select("value", "mid", *place, *([key] if unique else []))
        own = lookup.where(F.col("slice") == i).drop("slice")
        found.append(keyed.join(F.broadcast(own), keys, "left"))
    rows = reduce(DataFrame.union, found)
    if skipped is not None:
        rows = rows.where("out IS NULL")
    offset = F.col("mid") - F.col("first_mid")
    moved = F.raise_error("the input files changed while being read").cast("bigint")
    number = F.when(
        offset.between(0, F.col("lines") - 1), offset + F.col("lines_before") + 1
    ).otherwise(moved)
    return rows.select(
        bare_name(F.col("file_path")).alias("file_name"),
        "file_path",
        "block_no",
        number.alias("line_number"),
        (F.col("first") + offset).alias("place"),
        "value",
    )


def _summary(
    files: DataFrame,
    blocks: DataFrame,
    binary: DataFrame | None,
    frame: DataFrame,
    exact: bool,
) -> DataFrame:
    """``file_name, file_path, rows, columns, truncated`` per file, empty ones too."""
    counted = blocks.groupBy("file_path").agg(
        F.sum("kept").alias("rows"),
        F.max(F.when(F.col("kept") > 0, F.col("width"))).alias("columns"),
        (F.sum("kept") < F.sum("lines")).alias("truncated"),
    )
    if not exact:  # widths or counts of part of a split are not in the profile
        measured = frame.groupBy("file_path").agg(
            F.count(F.lit(1)).alias("rows"), F.max(F.size("fields")).alias("columns")
        )
        counted = counted.select("file_path", "truncated").join(measured, "file_path", "left")
    if binary is not None:
        files = files.join(binary, "file_path", "left_anti")
    return files.join(counted, "file_path", "left").select(
        "file_name",
        "file_path",
        F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"),
        F.coalesce("columns", F.lit(0)).alias("columns"),
        F.coalesce("truncated", F.lit(False)).alias("truncated"),
    )
