"""Mixing sources to target weights by weighted sampling without replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablog.llm.columns import named, packed, whole_text, word_count
from tablog.plans.durable import durable

# Rows of a source per step of the running total, on average.
ROWS_PER_STEP = 1_000
PLAIN = r"[0-9!-/:-@\[-`{-~]"


def quality_weight(text: Column) -> Column:
    """1 for a text of digits and ASCII punctuation, up to 4 for one without, in thousandths."""
    length = F.length(text)
    clean = length - F.regexp_count(text, F.lit(PLAIN))
    share = F.when(length == 0, F.lit(0)).otherwise(F.floor(clean * 3000 / length))
    return (F.lit(1000) + share) / F.lit(1000.0)


def sampling_key(doc_id: Column, weight: Column, seed: int) -> Column:
    """Exponential with rate ``weight``: the smaller, the earlier in the sample."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f"/{seed}"))
    draw = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((draw + 0.5) / F.lit(float(1 << 52))) / weight


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """Targets of the sources: one row per source in, one out.

    ``sizes`` has ``_source`` (null last) and ``_total``.  The wanted total is
    shared by weight; sources at ``most`` times their size give their excess
    to the others.  With sources in order of limit over weight, the level that
    the rest share is the largest of the levels reached by limiting the first
    0, 1, 2, … of them.  One row per source goes through one task here.
    """
    named_order = Window.orderBy(F.col("_source").asc_nulls_last())
    place = F.row_number().over(named_order) - 1
    weight = F.element_at(F.array([F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_weight", weight).withColumn("_limit", F.col("_total") * F.lit(float(most)))
    by_limit = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("_source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (
        F.sum("_total").over(everything) * F.lit(float(share))
        - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    ) / F.sum("_weight").over(rest)
    leveled = rows.withColumn("_level", level)
    target = F.least("_limit", F.max("_level").over(everything) * F.col("_weight"))
    return leveled.withColumn("target", target).select("_source", "_total", "_rows", "target")


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 1,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    Sources in code-point order (null last) have the ``weights`` in turn and
    share ``share`` times all words, none above ``most`` times its own.  All
    documents are taken in whole epochs as often as they fit in the target;
    the rest is a sample without replacement, in order of exponential keys
    with the documents' quality as rate, cut where the running total comes
    nearest to the target.  A whole document is taken or not, so a source ends
    within half a document of its target.

    The cut is found without sorting a source: keys fall into steps of about
    1,000 rows, totals per step are added up, and only the step that holds
    the cut is ordered.  The cuts, one row per source, are then joined to the
    documents, whose texts are not shuffled.

    A null text is empty and has size 0; ties in the key go by id and text
    hash; rows repeated in id and text are taken or left together.  Columns of
    ``docs`` named like an added one are replaced.
    """
    text = whole_text(text_column)
    added = ["size", "source_size", "target", "copies", "taken"]
    key = sampling_key(named(id_column), quality_weight(text), seed)
    marked = docs.select(
        packed(docs, added),
        named(source_column).cast("string").alias("_source"),
        word_count(text).alias("size"),
        F.struct(
            key.alias("key"),
            F.coalesce(named(id_column).cast("string"), F.lit("")).alias("id"),
            F.xxhash64(text).alias("hash"),
        ).alias("_order"),
    )
    rows = durable(marked.select("_source", "size", "_order"))
    sizes = rows.groupBy("_source").agg(
        F.sum("size").alias("_total"), F.count(F.lit(1)).alias("_rows")
    )
    epochs = F.coalesce(F.floor(F.try_divide("target", "_total")), F.lit(0)).cast("bigint")
    sources = (
        source_targets(sizes, weights, share, most)
        .withColumn("_epochs", epochs)
        .withColumn("_budget", F.col("target") - F.col("_epochs") * F.col("_total"))
        .withColumn("_steps", F.floor(F.col("_rows") / ROWS_PER_STEP) + 1)
    )
    sources = durable(sources)
    step = F.floor((F.lit(1.0) - F.exp(-F.col("_order.key"))) * F.col("_steps")).cast("bigint")

    def with_source(frame: DataFrame, table: DataFrame) -> DataFrame:
        table = table.withColumnRenamed("_source", "_of")
        return frame.join(table, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")

    stepped = with_source(rows, sources.select("_source", "_budget", "_steps")).withColumn("_step", step)
    totals = stepped.groupBy("_source", "_budget", "_step").agg(F.sum("size").alias("_sum"))
    steps = Window.partitionBy("_source").orderBy("_step")
    before = F.coalesce(F.sum("_sum").over(steps.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut_step = (
        totals.withColumn("_before", before)
        .where("_before <= _budget")
        .groupBy("_source")
        .agg(F.max("_step").alias("_cut_step"), F.max("_before").alias("_before"))
    )
    inside = with_source(stepped, cut_step).where("_step = _cut_step")
    units = inside.groupBy("_source", "_budget", "_before", "_order").agg(F.sum("size").alias("_unit"))
    ordered = Window.partitionBy("_source").orderBy("_order")
    running = F.col("_before") + F.sum("_unit").over(
        ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    taken = (
        units.withColumn("_running", running)
        .where("2 * _running - _unit <= 2 * _budget")
        .groupBy("_source")
        .agg(F.max("_order").alias("_cut"))
    )
    cuts = sources.join(cut_step, sources["_source"].eqNullSafe(cut_step["_source"]), "left").select(
        sources["_source"], "_total", "target", "_epochs", "_steps", "_cut_step"
    )
    cuts = cuts.join(
        taken.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of")), "left"
    ).drop("_of")
    cuts = durable(cuts)
    chosen = (step < F.col("_cut_step")) | ((step == F.col("_cut_step")) & (F.col("_order") <= F.col("_cut")))
    copies = F.col("_epochs") + F.coalesce(chosen, F.lit(False)).cast("bigint")
    return (
        with_source(marked, cuts)
        .withColumn("source_size", F.col("_total"))
        .withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select("_row.*", *added)
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, in the columns of ``docs``."""
    defaults = {"id_column": "doc_id", "text_column": "text", "source_column": "source"}
    read = dict.fromkeys(options.get(name, column) for name, column in defaults.items())
    mixed = mix(docs.select(packed(docs).alias("_given"), *[named(c) for c in read]), **options)
    again = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return mixed.where("copies > 0").select("_given", again.alias("_copy")).select("_given.*")
