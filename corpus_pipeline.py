"""From raw documents to token ids: the stages of a training-data pipeline.

Each stage takes what the one before kept and is written and read again, so a
lost executor costs at most a stage.  All stages but the last return the
columns of ``documents``; further columns stay as they are, whatever their names.

In every stage a null text counts as empty, a row without an id is a document
of its own that comes after all others, and no rows give no rows.  Rows
repeated in id and text are scored, cleaned and mixed alike; of near
duplicates the row with the smallest id stays, with its repeats.  Texts of any
length are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablog.llm.columns import named
from tablog.llm.minhash import drop_near
from tablog.llm.mixing import mixed_rows
from tablog.llm.near_lines import drop_near_lines
from tablog.llm.quality import fit_rules, score_quality
from tablog.llm.queries import token_digests
from tablog.plans.durable import remove_path, scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs, fit_rules(docs, labels))
    return scored.where("predicted = 1").select(*[named(c) for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one has; those left without any text go.

    A document that loses no line keeps its text as it was, null included.
    """
    rows = drop_near_lines(docs).where("n_removed = 0 or trim(kept_text) <> ''")
    changed = F.col("n_removed") > 0
    text = F.when(changed, F.col("kept_text")).otherwise(F.col("text"))
    length = F.when(changed, F.length("kept_text").cast("bigint")).otherwise(F.col("n_chars"))
    new = {"text": text.alias("text"), "n_chars": length.alias("n_chars")}
    return rows.select(*[new.get(c, named(c)) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, 75 in a hundred shared."""
    return drop_near(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, as a count and digests."""
    return token_digests(docs)


STAGES = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("tokens", tokens),
]

# A learned classifier, fuzzy links and tokenization have no equal in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:  # nothing reads it any more
            remove_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
