"""Secrets in texts, and how widely each candidate is copied among owners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablog.llm.columns import named, whole_text
from tablog.plans.durable import durable

# Kinds in order: pattern of the match with the value in a group of its own, and its least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))"""
KINDS = {
    "assign": (ASSIGN, 8),
    "access": (r"((AKIA[A-Z0-9]+))", 16),
    "hex": (r"(([0-9a-f]+))", 32),
    "owned": (r"(([A-Za-z0-9+/_=-]{20,}))", 20),
}
BASE = ("assign", "access", "hex")
# A value seen at so many owners is an example that people copy.
EXAMPLE_OWNERS = 3
# Different characters in a value that looks live.
LIVE_CHARACTERS = 10


def may_match(kind: str, text: Column) -> Column:
    """False only where the kind surely has no match that counts; cheap."""
    if kind == "assign":
        low = F.lower(text)
        words = ("passw", "secret", "token", "apikey", "api_key")
        out = F.lit(False)
        for word in words:
            out = out | low.contains(word)
        return out
    if kind == "access":
        return text.contains("AKIA")
    if kind == "hex":
        return text.rlike("[0-9a-f]{32}")
    return text.rlike(r"[A-Za-z0-9+/_=-]{20}")


def pieces(text: Column) -> Column:
    """All matches of all kinds, each with its kind, its number among them, the lengths
    of the text before it (from the match before) and of itself, and its value."""
    found = []
    for rank, (kind, (pattern, _)) in enumerate(KINDS.items()):
        whole = F.lit(rf"\G(?s)(.*?){pattern}")
        gap, match, value = (F.regexp_extract_all(text, whole, F.lit(i)) for i in (1, 2, 3))
        zipped = F.zip_with(
            F.transform(gap, lambda g: F.length(g)),
            F.zip_with(match, value, lambda m, v: F.struct(F.length(m).alias("size"), v.alias("value"))),
            lambda g, m: F.struct(g.alias("gap"), m["size"].alias("size"), m["value"].alias("value")),
        )
        numbered = F.transform(zipped, _numbered(rank))
        none = F.array().cast("array<struct<rank: int, number: int, gap: int, size: int, value: string>>")
        found.append(F.when(may_match(kind, text), numbered).otherwise(none))
    return F.concat(*found)


def _numbered(rank: int):
    def numbered(piece: Column, number: Column) -> Column:
        parts = [piece[name].alias(name) for name in ("gap", "size", "value")]
        return F.struct(F.lit(rank).alias("rank"), number.alias("number"), *parts)

    return numbered


def looks_live(value: Column) -> Column:
    """Letters and digits, and many different characters."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (different >= LIVE_CHARACTERS)


def find_secrets(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    repository: Sequence[str] = ("source", "lang"),
    owner: Sequence[str] = ("source",),
    example_owners: int = EXAMPLE_OWNERS,
) -> DataFrame:
    """Per row: the id and ``secrets``, an array in order of start and kind.

    Each has ``kind``, ``start`` and ``end`` (code points, end exclusive),
    ``value_hash``, ``n_repositories``, ``n_owners`` and ``status``: a value
    found at ``example_owners`` owners or more is an ``example``, others are
    ``owner_specific``.  Kinds assign, access and hex are always given; those
    of kind ``owned`` are other long tokens that look live, touch none of the
    others and are specific to few owners.  Repositories and owners are told
    apart by the named columns (null is a name like any other).

    Matches of a kind are leftmost and don't overlap.  Only matches leave the
    scan; their places are running sums of lengths.  A value that a third of
    all rows hold is counted within the tasks first, and the join of the counts
    is one that Spark splits if it is skewed.  A null text is empty.
    """
    text = whole_text(text_column)

    def name(columns: Sequence[str]) -> Column:
        return F.to_json(F.struct(*[named(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)]))

    scanned = durable(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            named(id_column).alias("id"),
            name(repository).alias("repository"),
            name(owner).alias("owner"),
            pieces(text).alias("pieces"),
        )
    )
    one = scanned.select("row", "repository", "owner", F.explode("pieces").alias("p")).select(
        "row", "repository", "owner", "p.*"
    )
    along = Window.partitionBy("row", "rank").orderBy("number")
    end = F.sum(F.col("gap") + F.col("size")).over(along)
    least = F.element_at(F.array(*[F.lit(n) for _, n in KINDS.values()]), F.col("rank") + 1)
    generic = F.lit(len(BASE))
    placed = one.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    # What counts is the value of an assignment, and the whole match otherwise.
    spans = placed.where((F.length("value") >= least) & ((F.col("rank") < generic) | looks_live(F.col("value"))))
    before = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy("start", "rank").rowsBetween(1, Window.unboundedFollowing)
    base = F.col("rank") < generic
    touched = (F.coalesce(F.max(F.when(base, F.col("end"))).over(before), F.lit(0)) > F.col("start")) | (
        F.coalesce(F.min(F.when(base, F.col("start"))).over(after), F.col("end")) < F.col("end")
    )
    spans = spans.withColumn("touched", touched).where(base | ~F.col("touched"))
    spans = durable(
        spans.select(
            "row", "repository", "owner", "rank", "start", "end",
            F.unhex(F.md5("value")).alias("value_hash"),
        )
    )
    owners = (
        spans.groupBy("value_hash", "owner", "repository")
        .agg(F.lit(1).alias("one"))
        .groupBy("value_hash", "owner")
        .agg(F.count(F.lit(1)).alias("repositories"))
        .groupBy("value_hash")
        .agg(F.sum("repositories").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))
    )
    known = spans.join(owners, "value_hash").where(base | (F.col("n_owners") < example_owners))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    status = F.when(F.col("n_owners") >= example_owners, "example").otherwise("owner_specific")
    secret = F.struct(
        "start", "rank", F.element_at(kinds, F.col("rank") + 1).alias("kind"), "end",
        "value_hash", "n_repositories", "n_owners", status.alias("status"),
    )
    per_row = known.groupBy("row").agg(F.sort_array(F.collect_list(secret)).alias("secrets"))
    empty = F.array().cast(per_row.schema["secrets"].dataType)
    return scanned.select("row", "id").join(per_row, "row", "left").select(
        F.col("id").alias(id_column), F.coalesce("secrets", empty).alias("secrets")
    )


def span_list(secrets: Column) -> Column:
    """``kind:start:end`` of each, joined by commas."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
