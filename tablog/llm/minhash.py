"""Near duplicates by word shingles: one-permutation sketches, banded buckets, exact links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablog.llm.columns import named, whole_text
from tablog.llm.links import Side, both_sides, link_groups, settled, shared_buckets
from tablog.llm.words import LOWER, Words, mix64, multipliers, text_chunks
from tablog.plans.durable import durable

SHINGLE = 5
PERCENT = 75
# Sketch: bins of the one permutation (a power of two), and bins per band.
BINS = 128
BAND = 4
# Places of the sketch that rules pairs out.
ODD_BITS = 1024
SEED = 23


def shingle_sets(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """Each text's distinct shingles as ascending hashes; a shorter text is one shingle as a whole."""
    words = Words(texts)
    hashed = words.hashes(LOWER)
    shingles, first = words.sequences(hashed, shingle, SEED)
    edges = np.searchsorted(first, words.first)
    factors = multipliers(shingle, SEED)
    out = []
    for i, count in enumerate(words.count.tolist()):
        if 0 < count < shingle:
            own = hashed[words.first[i] : words.first[i + 1]]
            out.append(mix64(np.array([(own * factors[:count]).sum() + np.uint64(count)], np.uint64)))
        else:
            out.append(np.unique(shingles[edges[i] : edges[i + 1]]))
    return out


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit numbers that tell sets apart: sums of two functions of their members."""
    out = np.zeros((len(sets), 2), np.uint64)
    for i, members in enumerate(sets):
        out[i, 0] = members.sum(dtype=np.uint64)
        out[i, 1] = mix64(members ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64)
    return mix64(out.reshape(-1)).reshape(-1, 2).view(np.int64)


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One-permutation minima, empty bins filled by optimal densification; rows of empty sets are 0.

    A hash's top bits are its bin, and the least hash of a bin is its value.
    An empty bin draws other bins, the same sequence in every set, until one
    isn't empty, so filled bins agree as often as the sets are similar.
    """
    count = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate([*sets, np.empty(0, np.uint64)])
    at = np.repeat(np.arange(len(sets)), count) * bins + (flat >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    head = np.flatnonzero(np.diff(at, prepend=-1))
    sketch, filled = np.zeros(len(sets) * bins, np.uint64), np.zeros(len(sets) * bins, bool)
    sketch[at[head]], filled[at[head]] = flat[head], True
    sketch, filled = sketch.reshape(-1, bins), filled.reshape(-1, bins)
    row, place = np.nonzero(~filled & (count > 0)[:, None])
    turn = 0
    while len(row):
        draw = mix64((place + bins * (turn + 1)).astype(np.uint64) * np.uint64(2 * SEED + 1)) % np.uint64(bins)
        draw = draw.astype(np.int64)
        got = filled[row, draw]
        sketch[row[got], place[got]] = sketch[row[got], draw[got]]
        row, place, turn = row[~got], place[~got], turn + 1
    return sketch


def band_hashes(sketch: np.ndarray, band: int) -> np.ndarray:
    """A bucket for every ``band`` bins in a row; the band's number is part of it."""
    bands = sketch.reshape(len(sketch), -1, band)
    mixed = (bands * multipliers(band, SEED + 1)).sum(2, dtype=np.uint64)
    return mix64(mixed + np.arange(bands.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def odd_sketches(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """For each of ``bits`` places whether an odd number of a set's members fall there, 64 to a number.

    Two sketches differ in at most as many places as their sets have members
    that the other lacks.
    """
    count = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = mix64(np.concatenate([*sets, np.empty(0, np.uint64)]) ^ np.uint64(SEED))
    at = np.repeat(np.arange(len(sets)), count) * bits + (flat % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(sets) * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sets), bits), axis=1).view(np.int64)


def differing(left: Side, right: Side, names: list[str]) -> Column:
    """In how many places two odd sketches differ."""
    out = F.lit(0)
    for name in names:
        out = out + F.bit_count(left(name).bitwiseXOR(right(name)))
    return out


def near_groups(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    bins: int = BINS,
    band: int = BAND,
) -> DataFrame:
    """Per row: the id, ``n_shingles``, ``component_id`` and ``kept``.

    Texts are linked when their sets of ``shingle``-word shingles (A-Z lower
    case) overlap by ``percent`` of their union or more, judged on the full
    sets; ``component_id`` is the smallest id reachable by links.  Equal sets
    are one item from the start.  Candidates share a bucket: ``band`` equal
    bins of a sketch of ``bins``.  With the defaults a pair at exactly 75 %
    is missed with probability 0.000006, a more similar one less.  Before sets
    are compared, pairs go whose sizes rule a link out, or whose odd sketches
    differ in more places than linked sets can have members apart; neither
    loses a link.  Candidate pairs are stars first (see ``link_groups``), so a
    large group of near copies costs about its size.

    A text without words has an empty set and no links.  Ids are taken to be
    unique: rows repeating an id and text are alike, and of rows that share an
    id but not the text links are looked for with one of the texts.  Rows
    without an id have no links, a null ``component_id``, and are kept.
    """
    rows = docs.select(named(id_column).cast("bigint").alias("id"), whole_text(text_column).alias("text"))

    parts_of = [f"s{i}" for i in range(ODD_BITS // 64)]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_chunks(batch.column(1)):
                sets = shingle_sets(texts, shingle)
                keys, bands = set_keys(sets), band_hashes(sketches(sets, bins), band)
                parts = odd_sketches(sets, ODD_BITS)
                ends = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * bands.shape[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(keys[:, 0]),
                        pa.array(keys[:, 1]),
                        pa.ListArray.from_arrays(ends, pa.array(bands.reshape(-1))),
                        *[pa.array(np.ascontiguousarray(part)) for part in parts.T],
                    ],
                    ["id", "n", "key1", "key2", "bands", *parts_of],
                )

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_chunks(batch.column(1)):
                sets = shingle_sets(texts, shingle)
                keys = set_keys(sets)
                ends = pa.array(np.cumsum([0, *map(len, sets)], dtype=np.int32))
                values = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.ListArray.from_arrays(ends, values)],
                    ["item", "key1", "key2", "members"],
                )

    schema = "id bigint, n bigint, key1 bigint, key2 bigint, bands array<bigint>"
    schema += "".join(f", {name} bigint" for name in parts_of)
    sketched = durable(rows.mapInArrow(sketch, schema))
    usable = sketched.where("n > 0 and id is not null")
    items = usable.groupBy("key1", "key2").agg(F.min("id").alias("item"))
    # Of an item's rows the first stands for all.
    first = usable.join(items.withColumnRenamed("item", "id"), ["key1", "key2", "id"])
    first = durable(first.drop("key1", "key2").dropDuplicates(["id"]).withColumnRenamed("id", "item"))
    members, _ = settled(shared_buckets(first.select(F.explode("bands").alias("bucket"), "item")))
    shared = members.select("item").distinct()
    traits = durable(first.select("item", "n", *parts_of).join(shared, "item"))
    wanted = traits.select(F.col("item").alias("id"))
    texts = rows.join(wanted, "id")
    sets = texts.mapInArrow(full_sets, "item bigint, key1 bigint, key2 bigint, members array<bigint>")
    of_item = items.select("key1", "key2", "item")
    sets = durable(sets.dropDuplicates(["item", "key1", "key2"]).join(of_item, ["key1", "key2", "item"], "left_semi"))

    def confirm(pairs: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("of_a", "of_b"))
        either = F.size("of_a") + F.size("of_b") - both
        return both_sides(pairs, sets.select("item", "members")).where(both * 100 >= either * percent)

    def possible(x: Side, y: Side) -> Column:
        small, large = F.least(x("n"), y("n")), F.greatest(x("n"), y("n"))
        # Of n + m members of two linked sets at most this share is in one set only.
        apart = (x("n") + y("n")) * (100 - percent)
        near = differing(x, y, parts_of) * (100 + percent) <= apart
        return (small * 100 >= large * percent) & near

    found = link_groups(members, traits, possible, confirm)
    grouped = of_item.join(found.withColumnRenamed("node", "item"), "item", "left").select(
        "key1", "key2", F.coalesce("component", "item").alias("component")
    )
    linked = sketched.select("id", "n", "key1", "key2").join(grouped, ["key1", "key2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component")), F.col("id")))
    kept = F.col("id").isNull() | (F.col("id") == component)
    return linked.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        kept.alias("kept"),
    )


def drop_near(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one document of each group, all columns as they were."""
    gone = near_groups(docs, id_column, text_column, **options).where("not kept")
    gone = gone.select(F.col(id_column).alias("_gone")).distinct()
    return docs.join(gone, named(id_column) == gone["_gone"], "left_anti")
