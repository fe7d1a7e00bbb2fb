"""Benchmark decontamination: a prefix-filtered set join of word shingles; columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablog.llm.columns import named, whole_text
from tablog.llm.tables import Written
from tablog.plans.durable import attach, durable

WINDOW = 10
SHINGLE = 5
# Words of a text that are laid out together: rows carry so many, not the whole text.
STRETCH = 64

WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def item_words(text: Column) -> Column:
    """ASCII letters (A to Z lower-cased), digits and characters beyond ASCII, in runs."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORDS), F.lit(0))


def _run(words: Column, start: Column, size: Column) -> Column:
    """``size`` words from the 0-based ``start`` on, as one text."""
    return F.array_join(F.slice(words, start + 1, size), " ")


def _token(words: Column, start: Column, size: int) -> Column:
    """The hash by which ``size`` words from ``start`` on are looked up."""
    return F.xxhash64(F.lit(size), *[F.get(words, start + i) for i in range(size)])


def _upto(last: Column) -> Column:
    """0, 1, … ``last``; nothing below 0."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def item_windows(items: DataFrame, id_column: str, text_column: str, window: int) -> DataFrame:
    """``item`` (its id as text) and each ``window`` of it, a text of ``size`` words.

    An item of fewer words is one window; one without words has none.
    """
    words = item_words(whole_text(text_column))
    rows = items.select(named(id_column).cast("string").alias("item"), words.alias("words"))
    rows = rows.withColumn("size", F.least(F.size("words"), F.lit(window))).where("size > 0")
    placed = rows.select("item", "words", "size", F.explode(_upto(F.size("words") - F.col("size"))).alias("at"))
    return placed.select("item", "size", _run(F.col("words"), F.col("at"), F.col("size")).alias("window")).distinct()


def window_shingles(windows: DataFrame, shingle: int) -> DataFrame:
    """Of each ``window`` of ``size`` words, its shingles of ``length`` words and their ``offset``."""
    rows = windows.select("window", "size", F.split("window", " ").alias("words"))
    rows = rows.withColumn("length", F.least("size", F.lit(shingle)))
    placed = rows.select("*", F.explode(_upto(F.col("size") - F.col("length"))).alias("offset"))
    text = _run(F.col("words"), F.col("offset"), F.col("length"))
    return placed.select("window", "size", "length", "offset", text.alias("shingle"))


def text_tokens(docs: DataFrame, id_column: str, text_column: str, lengths: list[int]) -> DataFrame:
    """Every run of words of one of the ``lengths``: its ``token``, place ``at`` and text ``found``.

    Each row of ``docs`` has one more row, at -1, that says how many words it
    has.  Texts are first cut into overlapping stretches, so that no row that
    is laid out word by word carries a long text.
    """
    text = whole_text(text_column)
    rows = docs.select(
        named(id_column).alias("own"),
        F.concat(F.lit("i"), named(id_column).cast("string")).alias("id"),
        F.xxhash64(text).alias("hash"),
        item_words(text).alias("words"),
    )
    rows = rows.select("own", F.coalesce("id", F.lit("")).alias("id"), "hash", "words", F.size("words").alias("n_words"))
    longest = max(lengths, default=1)
    last = F.floor((F.col("n_words") - 1) / STRETCH).cast("int")
    cut = F.transform(
        _upto(last),
        lambda k: F.struct(
            (k * STRETCH).alias("base"), F.slice("words", k * STRETCH + 1, F.lit(STRETCH + longest - 1)).alias("part")
        ),
    )
    head = F.array(F.struct(F.lit(-1).alias("base"), F.array().cast("array<string>").alias("part")))
    stretches = rows.select("own", "id", "hash", "n_words", F.explode(F.concat(head, cut)).alias("cut"))
    stretches = stretches.select("own", "id", "hash", "n_words", "cut.base", "cut.part")
    own_words = F.greatest(F.least(F.size("part"), F.lit(STRETCH)), F.lit(1))
    placed = stretches.select("*", F.explode(F.sequence(F.lit(0), own_words - 1)).alias("i"))
    if len(lengths) == 1:
        placed = placed.withColumn("length", F.lit(lengths[0]))
    elif lengths:
        every = F.when(F.col("base") < 0, F.array(F.lit(0))).otherwise(F.array(*[F.lit(n) for n in lengths]))
        placed = placed.withColumn("length", F.explode(every))
    else:
        placed = placed.withColumn("length", F.lit(0))
    token = F.lit(None).cast("bigint")
    for n in lengths:
        here = (F.col("length") == n) & (F.col("i") + n <= F.size("part"))
        token = F.when(here, _token(F.col("part"), F.col("i"), n)).otherwise(token)
    return placed.select(
        "own", "id", "hash", "n_words", (F.col("base") + F.col("i")).alias("at"), token.alias("token"),
        _run(F.col("part"), F.col("i"), F.col("length")).alias("found"),
    )


def contained_windows(found: DataFrame, shingles: DataFrame, shingle: int) -> DataFrame:
    """``id, hash, start, size, window`` of every window that occurs, once each.

    ``found`` has each place ``at`` of a ``shingle`` of the items in a text.  A
    window occurs where all its shingles do, so its rarest one is looked up
    alone (a prefix of one is enough when all must be met); where that leaves
    room for the window, the shingles that cover it are asked for in place.
    """
    counts = durable(found.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")))
    # A shingle that no text has rules its window out: the left join keeps it, with count 0.
    ordered = shingles.join(counts, "shingle", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("first")
    prefix = ordered.groupBy("window", "size").agg(rarest).where("first.n > 0")
    prefix = durable(prefix.select("window", "size", "first.shingle", "first.offset"))
    places = found.select("id", "hash", "n_words", "at", "shingle")
    begun = attach(places, prefix, ["shingle"], spread="at", how="inner")
    begun = begun.withColumn("start", F.col("at") - F.col("offset"))
    begun = begun.where("start >= 0 and start + size <= n_words").select("id", "hash", "start", "window", "size")
    last = F.col("size") - F.col("length")
    cover = shingles.where((F.col("offset") % shingle == 0) | (F.col("offset") == last))
    cover = durable(cover.select("window", "offset", "shingle"))
    asked = attach(begun, cover, ["window"], spread="start", how="inner")
    asked = asked.withColumn("at", F.col("start") + F.col("offset"))
    met = asked.join(places.select("id", "hash", "at", "shingle"), ["id", "hash", "at", "shingle"])
    met = met.groupBy("id", "hash", "start", "size", "window").agg(F.count(F.lit(1)).alias("met"))
    needed = F.ceil(F.col("size") / shingle)
    return met.where(F.col("met") == needed).drop("met")


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    shingle: int = SHINGLE,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """Per row of ``docs``: the id, ``n_words``, ``n_hit``, ``items`` and ``spans``.

    A word is hit inside any occurrence of ``window`` consecutive words of an
    item (an item of fewer words counts whole).  ``items`` has the ids, as text
    and sorted, of items with a window that occurs; ``spans`` the first word
    and number of words of each stretch that is hit.

    All texts are read once: each place of a ``shingle`` of some item, compared
    as text, is written to a table, and everything else works on that.  Windows
    are joined by the shingle that fewest places have and confirmed by
    shingles that cover them.  The items' shingles are broadcast while their
    measured size allows, and joined by a salted shuffle beyond it; a passage
    that very many documents hold is spread by its places.

    A null or empty text has no words and is not hit; an item without words
    marks nothing.  Rows repeated in id and text share their result; rows of
    one id with other texts, and rows without an id, each have their own.
    Items that share an id are one; items without an id mark words but are not
    listed.  Without items nothing is hit; no rows give no rows.
    """
    if not 0 < shingle <= window:
        raise ValueError(f"a shingle has between 1 and {window} words: {shingle}")
    spark = docs.sparkSession
    with Written(spark) as tables:
        owned = tables.keep(item_windows(items, item_column, item_text_column, window), "windows")
        shingles = tables.keep(window_shingles(owned.select("window", "size").distinct(), shingle), "shingles")
        lengths = [r["length"] for r in shingles.select("length").distinct().orderBy("length").collect()]
        words = F.split("shingle", " ")
        known = shingles.select("length", "shingle").distinct()
        token = F.lit(None).cast("bigint")
        for n in lengths:
            token = F.when(F.col("length") == n, _token(words, F.lit(0), n)).otherwise(token)
        lookup = durable(known.select(token.alias("token"), "shingle"))
        tokens = text_tokens(docs, id_column, text_column, lengths)
        met = attach(tokens, lookup, ["token"], spread="at")
        met = met.where((F.col("at") < 0) | (F.col("found") == F.col("shingle")))
        scan = tables.keep(met.select("own", "id", "hash", "n_words", "at", "shingle"), "places")
        found = scan.where("at >= 0").select("id", "hash", "n_words", "at", "shingle").distinct()
        hits = tables.keep(contained_windows(found, shingles, shingle), "hits")
        stretches = _stretches(hits)
        listed = attach(hits.select("id", "hash", "window"), owned.select("window", "item"), ["window"], spread="hash", how="inner")
        listed = listed.where("item is not null").groupBy("id", "hash").agg(F.collect_set("item").alias("items"))
        told = stretches.join(listed, ["id", "hash"], "left")
        none = F.array().cast("array<string>")
        rows = scan.where("at < 0").select("own", "id", "hash", "n_words").join(told, ["id", "hash"], "left")
        return durable(
            rows.select(
                F.col("own").alias(id_column),
                F.col("n_words").cast("bigint").alias("n_words"),
                F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
                F.array_sort(F.coalesce("items", none)).alias("items"),
                F.coalesce("spans", F.array().cast("array<struct<start:int,words:int>>")).alias("spans"),
            )
        )


def _stretches(hits: DataFrame) -> DataFrame:
    """``id, hash``, the stretches of words that are hit (``spans``) and their sum ``n_hit``."""
    longest = hits.groupBy("id", "hash", "start").agg(F.max("size").alias("size"))
    here = Window.partitionBy("id", "hash").orderBy("start")
    before = F.max(F.col("start") + F.col("size")).over(here.rowsBetween(Window.unboundedPreceding, -1))
    opens = (before.isNull() | (F.col("start") > before)).cast("int").alias("opens")
    marked = longest.select("id", "hash", "start", "size", opens)
    marked = marked.withColumn("number", F.sum("opens").over(here))
    ends = F.max(F.col("start") + F.col("size"))
    merged = marked.groupBy("id", "hash", "number").agg(F.min("start").alias("start"), ends.alias("stop"))
    span = F.struct("start", (F.col("stop") - F.col("start")).alias("words"))
    return merged.groupBy("id", "hash").agg(
        F.sum(F.col("stop") - F.col("start")).alias("n_hit"), F.array_sort(F.collect_list(span)).alias("spans")
    )
