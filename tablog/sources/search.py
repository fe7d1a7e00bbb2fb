"""A trigram filter per file of a stored log: which files cannot hold a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A file's trigrams are hashed to so many bits, in bitmaps of the size Spark makes.
BITS = 1 << 18
BITMAP = 1 << 15
# A search that more files may answer reads all of them.
MOST_FILES = 1000


def trigrams(text: Column) -> Column:
    """All three letters in a row of a lower-cased text, repeats too."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?s)(?=(.{3}))"), F.lit(1))


def trigram_bit(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BITS))


def file_filters(rows: DataFrame, text: Column) -> DataFrame:
    """The filters of the stored ``rows``: ``file, bucket, bits``.

    A task keeps each bit of a file once, in a table of no more than ``BITS``
    entries a file, so nothing is sorted or shuffled that grows with the lines.
    """
    each = rows.select(F.col("_metadata.file_name").alias("file"), F.explode(trigrams(text)).alias("trigram"))
    bits = each.select("file", trigram_bit(F.col("trigram")).alias("bit")).distinct()
    placed = bits.select("file", F.floor(F.col("bit") / BITMAP).alias("bucket"), (F.col("bit") % BITMAP).alias("at"))
    return placed.groupBy("file", "bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def write_filters(rows: DataFrame, text: Column, path: str) -> None:
    file_filters(rows, text).write.mode("overwrite").parquet(path)


def files_that_may_hold(spark: SparkSession, path: str, texts: list[str]) -> list[str] | None:
    """Names of the files that may have a line with all the texts, whatever their case.

    None if the texts are too short to tell, or too many files may have one.
    """
    wanted = spark.createDataFrame([(t,) for t in texts], "text string")
    asked: dict[int, set[int]] = {}
    each = wanted.select(F.explode(trigrams(F.col("text"))).alias("trigram"))
    for row in each.select(trigram_bit(F.col("trigram"))).distinct().collect():
        asked.setdefault(row[0] // BITMAP, set()).add(row[0] % BITMAP)
    if not asked:
        return None
    holds = F.lit(False)
    for bucket, places in asked.items():
        every = F.col("bucket") == bucket
        for at in sorted(places):
            byte = F.conv(F.hex(F.substring("bits", at // 8 + 1, 1)), 16, 10).cast("int")
            every = every & (byte.bitwiseAND(F.lit(1 << at % 8)) != 0)
        holds = holds | every
    filters = spark.read.parquet(path).where(F.col("bucket").isin(list(asked)) & holds)
    found = filters.groupBy("file").count().where(F.col("count") == len(asked))
    names = [row["file"] for row in found.select("file").limit(MOST_FILES + 1).collect()]
    return None if len(names) > MOST_FILES else names
