"""Fuzzy line duplicates: SimHash, pigeonhole blocks, edit similarity; columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablog.llm.lines import edit_similar, keyed, normal_line, places_gone, simhash, without_gone
from tablog.llm.links import Side, both_sides, link_groups, settled, shared_buckets
from tablog.llm.tables import Written
from tablog.plans.durable import broadcast_limit, durable

SIMILARITY = 0.9
# One edit for every ten letters, for the parts of short lines.
EDIT = 10
# Up to this length a line is cut into parts, of which two similar lines share one.
SHORT = 29
# Least length of a line similar to one that is longer than that.
LONG = 27
# A SimHash has so many blocks of so many bits, in words of 64.
BLOCKS, BLOCK_BITS = 4, 30
HASHES = -(-BLOCKS * BLOCK_BITS // 64)
# Words from which a line is also cut into quarters.
QUARTERS = 16
# Bytes of an item that a broadcast is sized by, as ``row_bytes`` has it.
ITEM_BYTES = 24
# What a blank line consists of, within brackets.
BLANK = r"\s\p{Z}"
# Letters whose numbers are compared before lines are; others count together.
COUNTED = ["e", "n", "i", "t", "a", "r", "s", "o", "h", "l", "d", "u", "c"]
# Letters of a word, on average, from which a line counts as without spaces.
UNSPACED = 20


def part_keys(norm: Column) -> Column:
    """Keys of which two lines of up to ``SHORT`` letters share one if they are similar.

    The longer one, of m letters, has at most k = m // 10 edits, so one of its
    k + 1 parts is whole in the other: the first at its start, the last at its
    end, or the middle one a letter to either side at most, as one of the
    outer parts is whole if both edits are on one side of it.
    """
    n = F.length(norm)
    keys = []
    for more in range(SHORT // EDIT + 1):
        m = n + more
        edits = F.floor(m / EDIT).cast("int")
        part = F.floor(m / (edits + 1)).cast("int")
        fits = (m >= EDIT) & (m <= SHORT) & (edits >= more)

        def key(place: int, text: Column, where: Column) -> Column:
            return F.when(where, F.xxhash64(F.lit(place), m, text))

        keys.append(key(0, F.substring(norm, F.lit(1), part), fits))
        keys.append(key(2, F.substring(norm, n - part + 1, part), fits))
        for shift in (-1, 0, 1):
            keys.append(key(1, F.substring(norm, part + 1 + shift, part), fits & (edits == 2)))
    return F.array_compact(F.array(*keys))


def line_words(norm: Column) -> Column:
    """The words of a line, or its letters where it has no spaces to speak of."""
    n = F.length(norm)
    spaced = F.length(F.translate(norm, " ", "")) <= n * (UNSPACED - 1) / UNSPACED
    return F.when(spaced, F.split(norm, " ")).otherwise(F.split(norm, ""))


def run_keys(words: Column) -> Column:
    """Keys of runs of words: the quarters of a line, and its first and last half.

    Edits that leave the number of words as it is leave a quarter whole unless
    there is one in each; edits that do not, leave a half whole if they are in
    the other.  A half of an odd number of words is taken with the middle one
    and without it, so that a word more or less does not matter.
    """
    n = F.size(words)
    keys = []

    def key(kind: int, start: Column, size: Column, where: Column) -> None:
        run = F.slice(words, F.greatest(start, F.lit(0)) + 1, F.greatest(size, F.lit(0)))
        keys.append(F.when(where & (size > 0), F.xxhash64(F.lit(kind), run)))

    for i in range(4):
        start = F.floor(n * i / 4).cast("int")
        key(2 + i, start, F.floor(n * (i + 1) / 4).cast("int") - start, n >= QUARTERS)
    for size in (F.floor(n / 2).cast("int"), F.ceil(n / 2).cast("int")):
        key(0, F.lit(0), size, n > 1)
        key(1, n - size, size, n > 1)
    return F.array_distinct(F.array_compact(F.array(*keys)))


def word_hashes(words: Column) -> list[Column]:
    """Of every word as many hashes as the bits of a SimHash take, in an array each."""

    def hashed(seed: int) -> Column:
        return F.transform(words, lambda word: F.xxhash64(F.lit(seed), word))

    return [hashed(seed) for seed in range(HASHES)]


def block_keys(bits: list[Column]) -> Column:
    """The blocks of a SimHash, each with its number: two that differ in fewer bits than blocks share one."""
    keys = []
    for block in range(BLOCKS):
        at, shift = divmod(block * BLOCK_BITS, 64)
        part = F.shiftrightunsigned(bits[at], shift)
        if shift + BLOCK_BITS > 64:
            part = part.bitwiseOR(F.shiftleft(bits[at + 1], 64 - shift))
        mask = F.lit((1 << BLOCK_BITS) - 1).cast("bigint")
        keys.append(F.lit(block << BLOCK_BITS).cast("bigint").bitwiseOR(part.bitwiseAND(mask)))
    return F.array(*keys)


def simhash_keys(lines: DataFrame) -> DataFrame:
    """``lines`` with ``blocks``, those of the SimHash of each line's set of ``words``.

    A word counts once, or the frequent words of a language would make all its
    long lines alike.  All words of a line are counted, however many it has.
    """
    names = [f"_h{i}" for i in range(HASHES)]
    own = lines.withColumn("_own", F.array_distinct("words"))
    hashed = own.select(*lines.columns, *[h.alias(n) for h, n in zip(word_hashes(F.col("_own")), names)])
    bits = hashed.select(*lines.columns, *[simhash(F.col(n)).alias(n) for n in names])
    return bits.select(*lines.columns, block_keys([F.col(n) for n in names]).alias("blocks"))


def line_keys(lines: DataFrame) -> DataFrame:
    """``item, norm, keys``: the buckets in which the lines ``item, norm`` meet their like."""
    length, none = F.length("norm"), F.array().cast("array<bigint>")
    long = F.when(length >= LONG, line_words(F.col("norm"))).otherwise(F.array().cast("array<string>"))
    blocks = simhash_keys(lines.select("item", "norm", long.alias("words")))
    whole = F.when(length >= LONG, F.concat("blocks", run_keys(F.col("words")))).otherwise(none)
    parts = F.when(length <= SHORT, part_keys(F.col("norm"))).otherwise(none)
    return blocks.select("item", "norm", F.concat(whole, parts).alias("keys"))


def letter_counts(norm: Column) -> list[Column]:
    """How often the line has each of ``COUNTED``, and how often any other letter."""
    counts = [F.length(norm) - F.length(F.replace(norm, F.lit(letter), F.lit(""))) for letter in COUNTED]
    others = F.length(F.translate(norm, "".join(COUNTED), ""))
    return [c.alias(f"n{i}") for i, c in enumerate([*counts, others])]


def least_edits(x: Side, y: Side) -> Column:
    """Edits that two lines are apart at least: one edit takes one letter away and adds one at most."""
    apart = [x(f"n{i}") - y(f"n{i}") for i in range(len(COUNTED) + 1)]
    more, fewer = F.lit(0), F.lit(0)
    for d in apart:
        more, fewer = more + F.greatest(d, F.lit(0)), fewer + F.greatest(-d, F.lit(0))
    return F.greatest(more, fewer)


def with_slots(items: DataFrame) -> DataFrame:
    """``items`` with ``slot``: the part that a shuffle by ``item`` puts each in."""
    return items.withColumn("slot", F.pmod(F.hash("item"), F.lit(slots(items.sparkSession))))


def slots(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def wanted_texts(lines: DataFrame, wanted: DataFrame, count: int) -> list[DataFrame]:
    """``item, norm`` of the ``count`` wanted items, in parts that take a small broadcast each.

    ``lines`` has each item once.  As it was written after a shuffle by item, a
    part's slots are in few of its files, so each text is read for one part,
    and no text is shuffled.
    """
    spark = lines.sparkSession
    most, last = max(broadcast_limit(spark) // ITEM_BYTES, 1), slots(spark)
    parts = min(-(-count // most), last) or 1
    wanted = with_slots(wanted)
    found = []
    for part in range(parts):
        own = F.col("slot").between(last * part // parts, last * (part + 1) // parts - 1)
        asked = F.broadcast(wanted.where(own).select("item"))
        found.append(lines.where(own).select("item", "norm").join(asked, "item", "left_semi"))
    return found


def near_line_places(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``_id``, ``_hash`` and ``_gone``, the places of lines to remove, of rows that have any."""
    rows = keyed(docs, id_column, text_column).select("_id", "_hash", F.posexplode("_lines").alias("at", "line"))
    rows = rows.where(F.col("line").rlike(f"[^{BLANK}]")).withColumn("norm", normal_line(F.col("line")))
    raw = F.when(F.col("norm") == "", F.regexp_replace("line", f"^[{BLANK}]+|[{BLANK}]+$", ""))
    rows = rows.withColumn("item", F.when(raw.isNull(), F.xxhash64("norm")).otherwise(F.xxhash64(F.lit("raw"), raw)))
    with Written(docs.sparkSession) as tables:
        kept = rows.select("_id", "_hash", "at", "item", "norm")
        lines = tables.keep(kept, "lines", compression="zstd")
        distinct = lines.select("item", "norm").dropDuplicates(["item"])
        keys = tables.keep(with_slots(line_keys(distinct)), "line-keys", compression="zstd")
        members, _ = settled(shared_buckets(keys.select(F.explode("keys").alias("bucket"), "item")))
        wanted, count = settled(members.select("item").distinct())
        texts = tables.keep_all(wanted_texts(keys, wanted, count), "candidate-lines", compression="zstd")
        traits = durable(texts.select("item", F.length("norm").alias("length"), *letter_counts(F.col("norm"))))

        def possible(x: Side, y: Side) -> Column:
            most = (1 - SIMILARITY) * F.greatest(x("length"), y("length")) + 1e-9
            return (F.abs(x("length") - y("length")) <= most) & (least_edits(x, y) <= most)

        def similar(pairs: DataFrame) -> DataFrame:
            both = both_sides(pairs, texts)
            return both.where(edit_similar(F.col("of_a"), F.col("of_b"), SIMILARITY))

        groups = link_groups(members, traits, possible, similar).withColumnRenamed("node", "item")
        found = lines.select("_id", "_hash", "at", "item")
        return durable(places_gone(found, groups))


def drop_near_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with ``kept_text``, ``n_lines`` and ``n_removed``: repeated lines are removed.

    Lines end at line feeds and are compared by their letters in lower case.
    Lines that are equal so, or whose edit similarity is at least 0.9, belong
    together; of each connected group the occurrence of the smallest (id,
    line) stays and all others go.  Lines without letters belong together when
    they are equal but for space around them.  Blank lines always stay.  There
    is no limit of words: lines of fewer than ten letters can only be equal.

    Lines of up to 29 letters are cut into parts, of which all similar ones
    share one.  Longer ones meet where a block of their SimHashes is equal, and
    where a half or quarter of their words is.  So lines whose edits lie in one
    half, or leave a quarter's words whole, always meet; edits all over a line
    are the surer to be missed the more there are.  Pairs go before their edit
    distance is found only if their lengths or the numbers of their letters
    rule it out.  Candidates are stars (``link_groups``).  The edit distance
    decides on lines of any length; a way piece by piece that has few enough
    edits only saves finding the least.

    A null text is one blank line and becomes empty.  Rows without an id come
    last; rows repeated in id and text are one document and lose the same
    lines.  Columns of ``docs`` named like an added one are replaced.  No rows
    give no rows.
    """
    added = ["kept_text", "n_lines", "n_removed"]
    given = docs.drop(*added)
    return without_gone(given, near_line_places(given, id_column, text_column), id_column, text_column)
