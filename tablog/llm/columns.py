"""Column expressions and small steps shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def named(name: str) -> Column:
    """A column by its exact name, dots and backquotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, without: list[str] | None = None) -> Column:
    """All columns of a table as one struct ``_row``, so that no helper column meets their names."""
    return F.struct(*[named(c) for c in docs.columns if c not in (without or [])]).alias("_row")


def whole_text(column: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(named(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id mod 5 is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
