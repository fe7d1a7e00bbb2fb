"""Bounded samples of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablog.llm.columns import held_out, named

SAMPLE = 6000


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, id_column: str, sample: int
) -> DataFrame:
    """Documents to learn from, with ``_label`` 0 or 1: at most ``sample`` labelled ids.

    Held-out ids, null ids and null labels are left out; of several labels of
    an id the largest counts.  The sample is the first ids in hash order, so
    that it is the same in every run; it is small by its bound and broadcast.
    """
    known = (
        labels.where(~held_out(named(id_column)) & named(label).isNotNull())
        .groupBy(named(id_column).alias("_of"))
        .agg((F.max(named(label)) > 0).cast("double").alias("_label"))
        .orderBy(F.xxhash64("_of"), "_of")
        .limit(sample)
    )
    rows = docs.drop("_of", "_label")
    return rows.join(F.broadcast(known), named(id_column) == F.col("_of")).drop("_of")
