"""Groups of linked items: candidates by shared buckets, links confirmed, components found."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablog.plans.durable import durable

# Turns in which any central item of a bucket may be paired with the others.
EARLY_TURNS = 2

# Rows of the small tables here that a part holds, and pairs that one task makes.
ROWS_PER_PART = 250_000
PAIRS_PER_PART = 1_000_000

# A trait of one side of a pair, by its name.
Side = Callable[[str], Column]


def settled(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows kept apart from their lineage, in no more parts than they need, and their number.

    Rows that fit one part are grouped and joined there, without a shuffle.
    """
    kept = durable(rows)
    count = kept.coalesce(rows.sparkSession.sparkContext.defaultParallelism).count()
    return kept.coalesce(count // ROWS_PER_PART + 1), count


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it reaches; ``edges`` has ``a`` and ``b``.

    Neighbourhoods are rewired to their smallest node, over larger and over
    smaller neighbours in turn, until what is left is a star around each
    component's smallest node.  Each turn is an aggregation and a
    join, so a node with very many neighbours is no single task's work.
    Nodes without edges to others are left out.
    """

    def rewired(pairs: DataFrame, larger: bool) -> DataFrame:
        if larger:
            # Not a union: that has the parts of both sides, so one part would be dealt out anew.
            ways = [F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in ("ab", "ba")]
            both = pairs.select(F.explode(F.array(*ways)).alias("e")).select("e.u", "e.v")
            least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            out = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            down = pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
            least = down.groupBy("u").agg(F.min("v").alias("m"))
            linked = down.join(least, "u")
            ends = F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m")))
            out = linked.select(ends.alias("e")).select(F.col("e.u").alias("a"), F.col("e.m").alias("b"))
        return out.where("a <> b").distinct()

    now, count = settled(edges.select("a", "b").where("a <> b"))
    while count:
        parts = count // ROWS_PER_PART + 1
        now = durable(rewired(rewired(now, True).coalesce(parts), False).coalesce(parts)).coalesce(parts)
        count, leaves = now.agg(F.count(F.lit(1)), F.count_distinct("a")).first()
        inner = now.select("a").join(now.select(F.col("b").alias("a")), "a", "left_semi")
        if count == leaves and inner.isEmpty():  # every leaf has one centre, and no centre is a leaf
            break
    centres = now.select("b").distinct()
    return now.toDF("node", "component").union(centres.select("b", "b"))


def shared_buckets(rows: DataFrame) -> DataFrame:
    """``bucket``, ``item`` and the bucket's ``size``, where it is two or more; one shuffle."""
    dealt = rows.select("bucket", "item").repartition("bucket")
    sizes = dealt.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("size"), F.min("item").alias("_low"), F.max("item").alias("_high")
    )
    return dealt.join(sizes.where("_low < _high").select("bucket", "size"), "bucket")


def both_sides(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """``a``, ``b``, ``of_a`` and ``of_b``: what ``items`` have, in their second column, of both ends.

    Few pairs are sent to where the items are, so that only items in a pair are shuffled.
    """
    left, right = items.toDF("a", "of_a"), items.toDF("b", "of_b")
    if pairs.count() > ROWS_PER_PART:
        return pairs.join(left, "a").join(right, "b")
    right = right.join(F.broadcast(pairs.select("b").distinct()), "b", "left_semi")
    return left.join(F.broadcast(pairs), "a").join(right.hint("merge"), "b")


def link_groups(
    members: DataFrame,
    traits: DataFrame,
    possible: Callable[[Side, Side], Column],
    confirm: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Components of items that share buckets and are linked.

    ``members`` are :func:`shared_buckets`; ``traits`` has columns about each
    ``item``.  ``possible`` says from both sides' traits whether a pair may be
    linked, and ``confirm`` takes pairs ``a``, ``b`` and keeps those that are.

    Not all pairs of a bucket are made.  First its most central item, the one
    that meets most others over all buckets, is paired with the others: a star.
    What that links is one component, and pairs inside a component can add
    nothing.  Then the next central items are paired with those still in other
    components, a few per bucket at first and more from turn to turn; at last
    the items outside the bucket's main component.  An item that has had its
    turn leaves the bucket, and a bucket is done when one component is left.
    Two items that share many buckets are paired in the first of these only,
    and two central ones from one side only, so every pair is made once at
    most, and the result is that of all pairs.
    """
    of_item = F.sum("size").alias("central"), F.collect_set("bucket").alias("buckets")
    central = durable(members.groupBy("item").agg(*of_item))
    traits, items = settled(traits.join(central.select("item", "buckets"), "item"))
    about = [c for c in traits.columns if c != "item"]
    members, left = settled(members.select("bucket", "item").join(central.drop("buckets"), "item"))
    found: DataFrame | None = None
    turn = 0
    while left:
        # What is in one part stays there: a join alone would not say so to the next one.
        together = max(left, items) <= ROWS_PER_PART

        def joined(one: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
            out = one.join(other, on, how)
            return out.coalesce(1) if together else out

        if found is None:
            rows = members.withColumn("comp", F.col("item"))
        else:
            rows = joined(members, found.withColumnRenamed("node", "item"), "item", "left")
            rows = rows.withColumn("comp", F.coalesce("component", "item")).drop("component")
        mains = rows.groupBy("bucket").agg(
            F.max(F.struct("central", "item", "comp")).alias("main"),
            F.min("comp").alias("_low"),
            F.max("comp").alias("_high"),
        )
        mains = mains.where("_low < _high").select("bucket", F.col("main.comp").alias("main"))
        early = turn < EARLY_TURNS
        slots = 8 ** (turn if early else turn - EARLY_TURNS + 1)
        slot = F.pmod(F.xxhash64("item"), F.lit(slots)).alias("slot")
        rows = joined(rows, mains, "bucket").select("*", slot)
        choice = rows if early else rows.where("comp <> main")
        best = F.max(F.struct("central", "item")).alias("pivot")
        pivots = choice.groupBy("bucket", "slot").agg(best).select("bucket", "pivot.item", F.lit(True).alias("turn"))
        rows, _ = settled(joined(rows.drop("slot"), pivots, ["bucket", "item"], "left"))
        sizes = rows.groupBy("bucket").agg((F.count(F.lit(1)) * F.count("turn")).alias("pairs"))
        together = together and (sizes.agg(F.sum("pairs")).first()[0] or 0) <= PAIRS_PER_PART
        x, y = "x_{}".format, "y_{}".format

        def side(frame: DataFrame, name: Callable[[str], str]) -> DataFrame:
            named = joined(frame.select("bucket", "item", "comp", "turn"), traits, "item")
            return named.select("bucket", *[F.col(c).alias(name(c)) for c in ("item", "comp", "turn", *about)])

        pairs, made = settled(
            joined(side(rows, x), side(rows.where("turn"), y), "bucket")
            .where("x_comp <> y_comp and (x_turn is null or x_item < y_item)")
            .where(possible(lambda n: F.col(x(n)), lambda n: F.col(y(n))))
            .where(F.array_min(F.array_intersect("x_buckets", "y_buckets")) == F.col("bucket"))
            .select(F.least("x_item", "y_item").alias("a"), F.greatest("x_item", "y_item").alias("b"))
        )
        if made:
            links, linked = (pairs, made) if confirm is None else settled(confirm(pairs).select("a", "b"))
            if linked:
                if found is not None:
                    links = links.union(found.select("node", "component"))
                found, _ = settled(components(links))
        members, left = settled(rows.where("turn is null").select("bucket", "item", "central"))
        turn += 1
    if found is None:
        return members.select(F.col("item").alias("node"), F.col("item").alias("component"))
    return found
