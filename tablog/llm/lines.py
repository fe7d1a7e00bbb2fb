"""Lines of texts: their normal form, SimHash, edit similarity, and removal; columns only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablog.llm.columns import named, packed, whole_text
from tablog.plans.durable import attach, durable

NO_ID = (1 << 63) - 1
# Letters of the pieces that a line is first compared in, those of a line of more
# than ``PIECE`` letters, and the letters by which a piece's end is found again.
PIECE, SHORT_PIECE, LONG_PIECE = 4096, 64, 256
ANCHOR = 16
# Bits of a lane that counts words, and words up to which it can.
LANE = 16
MOST_WORDS = (1 << LANE - 2) - 1
# Bits of a lane for lines of few words, and of one that counts more words than a line can have.
NARROW_LANE, WIDE_LANE = 8, 32


def normal_line(line: Column) -> Column:
    """Lower-case letters only, anything between them as one space."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}]+", " "))


def lane_mask(width: int) -> Column:
    """The lowest bit of every lane of ``width`` bits."""
    return F.lit(sum(1 << width * lane for lane in range(64 // width))).cast("bigint")


def lane_counts(hashed: Column, width: int) -> list[Column]:
    """What a word's hash adds to ``width`` numbers, whose lanes count the words with a bit set."""
    return [F.shiftrightunsigned(hashed, i).bitwiseAND(lane_mask(width)) for i in range(width)]


def majority(counts: list[Column], words: Column) -> Column:
    """The bits that more than half of the ``words`` have.

    A lane's second-highest bit tells whether its count is over half; that
    holds up to 2^(width - 2) - 1 words and never touches the sign.
    """
    width = len(counts)
    half = F.floor(words / 2).cast("bigint")
    lift = (F.lit((1 << width - 2) - 1).cast("bigint") - half) * lane_mask(width)
    out = F.lit(0).cast("bigint")
    for i, count in enumerate(counts):
        over = F.shiftrightunsigned(count + lift, width - 2).bitwiseAND(lane_mask(width))
        out = out.bitwiseOR(F.shiftleft(over, i))
    return out


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is found only once."""
    return F.transform(F.array(value), use)[0]


def simhash(hashes: Column) -> Column:
    """The bits that more than half of an array of hashes have.

    As :func:`majority` of :func:`lane_counts`, one number after the other and
    in lanes as wide as the line's words take, so all of them are counted.
    """

    def widest(value: Callable[[int], int | Column]) -> Column:
        few, many = (F.size(hashes) <= (1 << width - 2) - 1 for width in (NARROW_LANE, LANE))
        return F.when(few, value(NARROW_LANE)).when(many, value(LANE)).otherwise(value(WIDE_LANE))

    def counted(known: Column) -> Column:
        own, width, mask, lift = (known[name] for name in ("hashes", "width", "mask", "lift"))

        def with_lane(bits: Column, i: Column) -> Column:
            def add(sums: Column, hashed: Column) -> Column:
                return sums + F.call_function("shiftrightunsigned", hashed, i).bitwiseAND(mask)

            over = F.call_function("shiftrightunsigned", F.aggregate(own, lift, add), width - 2).bitwiseAND(mask)
            return bits.bitwiseOR(F.call_function("shiftleft", over, i))

        return F.aggregate(F.sequence(F.lit(0), width - 1), F.lit(0).cast("bigint"), with_lane)

    half = F.floor(F.size(hashes) / 2).cast("bigint")
    lift = (widest(lambda width: F.lit((1 << width - 2) - 1).cast("bigint")) - half) * widest(lane_mask)
    known = {"hashes": hashes, "width": widest(F.lit), "mask": widest(lane_mask), "lift": lift}
    return bound(F.struct(*[value.alias(name) for name, value in known.items()]), counted)


def aligned_edits(left: Column, right: Column, most: Column) -> Column:
    """Edits of one way from a line to the other: never fewer than they are apart.

    The left line is cut into pieces and the right one where the letters after
    each piece come next, no more than ``most`` letters from where they were
    due; if they don't, the piece is as long as on the left.  Edits of the
    pieces add up; beyond ``most`` they are not followed.
    """

    def followed(line: Column) -> Column:
        n, m, most, size = (line[name] for name in ("n", "m", "most", "size"))

        def step(state: Column, i: Column) -> Column:
            at, end = state["at"], (i + 1) * size
            due = at + size
            low = F.greatest(at, due - most)
            after = F.substring(line["left"], end + 1, F.lit(ANCHOR))
            next_at = F.when(end >= n, m).otherwise(F.call_function("locate", after, line["right"], low + 1) - 1)

            def cut(place: Column) -> Column:
                met = (end >= n) | place.between(low, due + most)
                return F.when(met, place).otherwise(F.least(due, m))

            def edits(to: Column) -> Column:
                a, b = F.substring(line["left"], i * size + 1, size), F.substring(line["right"], at + 1, to - at)
                pair = F.struct(a.alias("a"), b.alias("b"))
                apart = bound(pair, lambda x: F.when(x["a"] == x["b"], 0).otherwise(F.levenshtein(x["a"], x["b"])))
                return F.struct(to.alias("at"), (state["edits"] + apart).alias("edits"))

            return F.when(state["edits"] > most, state).otherwise(bound(bound(next_at, cut), edits))

        pieces = F.sequence(F.lit(0), F.greatest(F.ceil(n / size).cast("int") - 1, F.lit(0)))
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("edits"))
        return F.aggregate(pieces, start, step, lambda state: state["edits"])

    n, m = F.length(left), F.length(right)
    size = F.when(F.greatest(n, m) <= PIECE, F.lit(SHORT_PIECE)).otherwise(F.lit(LONG_PIECE))
    known = {"left": left, "right": right, "n": n, "m": m, "most": most, "size": size}
    return bound(F.struct(*[value.alias(name) for name, value in known.items()]), followed)


def edit_similar(left: Column, right: Column, similarity: float) -> Column:
    """Whether the edit distance leaves ``similarity`` of the longer line.

    The distance of whole lines takes time in the square of their length.  So
    a way piece by piece is tried first, in proportion to it; lines that need
    few enough edits that way are similar.  All others, of any length, are
    compared whole, up to the edits that lines of that length may have.
    """
    longest = F.greatest(F.length(left), F.length(right))
    most = F.floor((1 - similarity) * longest + 1e-9).cast("int")
    whole = F.call_function("levenshtein", left, right, most) >= 0
    near = F.abs(F.length(left) - F.length(right)) <= most
    return near & ((aligned_edits(left, right, most) <= most) | whole)


def keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``_row``, its place in the order (``_id``, ``_hash`` of the text) and its ``_lines``."""
    text = whole_text(text_column)
    return docs.select(
        packed(docs),
        F.coalesce(named(id_column).cast("bigint"), F.lit(NO_ID)).alias("_id"),
        F.xxhash64(text).alias("_hash"),
        F.split(text, "\n").alias("_lines"),
    )


def places_gone(found: DataFrame, groups: DataFrame) -> DataFrame:
    """``_id``, ``_hash`` and ``_gone``: of every group the places of all lines but the first.

    ``found`` has the ``item`` of each place, ``groups`` the ``component`` of
    items linked to others; any other item is a group of its own.
    """
    own = attach(found, groups, ["item"], spread="at").withColumn("group", F.coalesce("component", "item"))
    # Components are named by one of their items, so the names don't meet others.
    place = F.struct("_id", "_hash", "at")
    first = own.groupBy("group").agg(F.min(place).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return (
        attach(own, durable(first), ["group"], spread="at", how="inner")
        .where(place != F.col("lead"))
        .groupBy("_id", "_hash")
        .agg(F.collect_set("at").alias("_gone"))
    )


def without_gone(docs: DataFrame, gone: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_removed``."""
    rows = keyed(docs, id_column, text_column).join(gone, ["_id", "_hash"], "left")
    removed = F.coalesce("_gone", F.array().cast("array<int>"))
    kept = F.filter("_lines", lambda line, at: ~F.array_contains(removed, at))
    n_removed = F.size(removed)
    text = F.array_join(kept, "\n")
    return rows.select(
        "_row.*",
        text.alias("kept_text"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        n_removed.cast("bigint").alias("n_removed"),
    )
