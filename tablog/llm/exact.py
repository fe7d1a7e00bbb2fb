"""Exact duplicates: equal texts, one row of each stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablog.llm.columns import named, whole_text


def exact_groups(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest"
) -> DataFrame:
    """One row per row of ``docs``: which row of its group of equal texts stays.

    Rows are grouped by the 128-bit hash of the text and, within it, by the
    text's bytes, so a collision makes two groups.  Copies are counted in the
    scan tasks before they are shuffled: a group holding a third of all rows
    sends one row per task.  Only groups of two or more are joined back, by
    content hashes, not by text.

    Returns the id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.
    A null text counts as empty.  Null ids never stay unless the whole group
    has none, and then all its rows stay; rows repeating the id that stays are
    all marked kept.  An empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest: {keep}")
    text = whole_text(text_column)
    best = F.min if keep == "smallest" else F.max
    rows = docs.select(named(id_column).alias("_id"), text.alias("_text"))
    hashed = rows.withColumn("_hash", F.unhex(F.md5("_text")))
    groups = (
        hashed.groupBy("_hash", "_text")
        .agg(best("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
        .where("_size > 1")
        .select("_hash", F.sha2("_text", 256).alias("_sha"), "_keep", "_size")
    )
    members = hashed.select("_id", "_hash", F.sha2("_text", 256).alias("_sha"))
    keep_id = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return members.join(groups, ["_hash", "_sha"], "left").select(
        F.col("_id").alias(id_column),
        keep_id.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("_id").eqNullSafe(keep_id).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep: str = "smallest"
) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were.

    Ids are taken to be unique; a row without an id stays if its whole group
    has none.
    """
    kept = exact_groups(docs, id_column, text_column, keep).where("kept")
    kept = kept.select(F.col(id_column).alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    same = named(id_column).eqNullSafe(kept["_kept_id"]) & (
        F.sha2(whole_text(text_column), 256) == kept["_kept_sha"]
    )
    return docs.join(kept, same, "left_semi")
