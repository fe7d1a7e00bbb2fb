"""Importance resampling towards a target: hashed n-grams, their CRC-32 read off running CRCs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from re import compile as pattern
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablog.llm.columns import named, whole_text
from tablog.llm.tables import Written
from tablog.llm.words import text_bytes
from tablog.operators.numbering import sorted_table

LONGEST = 1
BUCKETS = 10_000
PERCENT = 10
MIN_WORDS = 20
SEED = 2024
# Words of texts that are handled at once; a longer text is handled alone.
CHUNK_WORDS = 1 << 20

# Bytes of a word stay, A to Z as a to z; all others are separators.  Every byte
# of a character beyond ASCII is a word's.
_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_PIECE = pattern(rb" ?[^ ]+")


@lru_cache
def _shift_table(bit: int) -> np.ndarray:
    """What each byte of a CRC becomes when 2^bit zero bytes follow: 4 x 256 values.

    Appending zeros is linear over GF(2): it is known from what becomes of each
    of the 32 bits, and doing it twice doubles the number of zeros.
    """
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if bit:
        images = _apply(_shift_table(bit - 1), _apply(_shift_table(bit - 1), bits))
    else:
        none = crc32(b"\0", 0)
        images = np.array([crc32(b"\0", int(b)) ^ none for b in bits], np.uint32)
    table = np.zeros((4, 256), np.uint32)
    values = np.arange(256)
    for place in range(4):
        for b in range(8):
            table[place, values >> b & 1 == 1] ^= images[8 * place + b]
    return table


def _apply(table: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    out = table[0][crcs & 0xFF]
    for place in range(1, 4):
        out ^= table[place][crcs >> np.uint32(8 * place) & 0xFF]
    return out


def shifted(crcs: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The part of each CRC that is left in it after so many further bytes."""
    out = crcs.copy()
    most = int(zeros.max()) if len(zeros) else 0
    for bit in range(most.bit_length()):
        on = np.flatnonzero(zeros >> bit & 1)
        out[on] = _apply(_shift_table(bit), out[on])
    return out


def running_crcs(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """CRC of the normalised text up to each word's end, and each word's bytes.

    Normalised, words are lower-cased and joined by one space.
    """
    normal = b" ".join(text.translate(_BYTES).split())
    pieces = _PIECE.findall(normal)
    ends = accumulate(pieces, lambda crc, piece: crc32(piece, crc), initial=0)
    crcs = np.fromiter(ends, np.uint32, len(pieces) + 1)[1:]
    sizes = np.fromiter(map(len, pieces), np.uint32, len(pieces))
    sizes[1:] -= 1
    return crcs, sizes


class Runs:
    """Running CRCs of several texts, from which any run of words has its CRC."""

    def __init__(self, crcs: list[bytes], sizes: list[bytes]) -> None:
        self.ends = np.frombuffer(b"".join(crcs), np.uint32)
        self.sizes = np.frombuffer(b"".join(sizes), np.uint32).astype(np.int64)
        self.count = np.fromiter((len(c) // 4 for c in crcs), np.int64, len(crcs))
        first = np.concatenate([[0], np.cumsum(self.count)])
        self.left = np.repeat(first[1:], self.count) - np.arange(len(self.ends))
        # Before a word stands what ends the word before it, and a space; before the first nothing.
        self.starts = np.zeros_like(self.ends)
        self.starts[1:] = shifted(self.ends[:-1], np.ones(len(self.ends[1:]), np.int64)) ^ np.uint32(crc32(b" "))
        self.starts[first[:-1][self.count > 0]] = 0
        self.stop = np.cumsum(self.sizes + 1) - 1

    def buckets(self, length: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each run of ``length`` words of one text, and its first word.

        The CRC up to the run's end, less what is left in it of the CRC up to
        its start, is the CRC of the run alone.
        """
        first = np.flatnonzero(self.left >= length)
        last = first + length - 1
        sizes = self.stop[last] - self.stop[first] + self.sizes[first]
        return (self.ends[last] ^ shifted(self.starts[first], sizes)) % np.uint32(buckets), first


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, Runs]]:
    """Ranges of rows and their :class:`Runs`, about ``CHUNK_WORDS`` at a time."""
    crcs, sizes = batch.column("crcs").to_pylist(), batch.column("sizes").to_pylist()
    start = words = 0
    for i, value in enumerate([*crcs, None]):
        more = 0 if value is None else len(value) // 4
        if value is None or i > start and words + more > CHUNK_WORDS:
            if i > start:
                yield start, i, Runs(crcs[start:i], sizes[start:i])
            start, words = i, 0
        words += more


def scanned(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``id``, ``hash`` of the text, ``crcs`` and ``sizes`` of its words (uint32 each), of every row."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs, sizes = [], []
            for text in text_bytes(batch.column(2)):
                own, long = running_crcs(text)
                crcs.append(own.tobytes())
                sizes.append(long.tobytes())
            own = [pa.array(crcs, pa.binary()), pa.array(sizes, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *own], ["id", "hash", "crcs", "sizes"]
            )

    text = whole_text(text_column)
    rows = docs.select(named(id_column).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"id {kind}, hash bigint, crcs binary, sizes binary")


def bucket_counts(scans: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """How many features fall in each bucket; tasks add up their own before anything is sent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, runs in _chunks(batch):
                for length in range(1, longest + 1):
                    total += np.bincount(runs.buckets(length, buckets)[0], minlength=buckets)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(total[found])], ["bucket", "n"])

    counted = scans.select("crcs", "sizes").mapInArrow(count, "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, a thousand times the log of how much likelier the target has it, whole."""
    buckets = float(len(source))
    here, there = source.astype(float), target.astype(float)
    ratio = ((there + 1) * (here.sum() + buckets)) / ((here + 1) * (there.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def _weighed(scans: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """``id, hash, n_words, n_features, weight`` of every scanned row."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, runs in _chunks(batch):
                text = np.repeat(np.arange(b - a), runs.count)
                features = np.zeros(b - a, np.int64)
                weight = np.zeros(b - a, np.int64)
                for length in range(1, longest + 1):
                    bucket, first = runs.buckets(length, len(gain))
                    features += np.bincount(text[first], minlength=b - a)
                    np.add.at(weight, text[first], gain[bucket])
                own = [pa.array(runs.count), pa.array(features), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], *own],
                    ["id", "hash", "n_words", "n_features", "weight"],
                )

    kind = scans.schema["id"].dataType.simpleString()
    return scans.mapInArrow(weigh, f"id {kind}, hash bigint, n_words bigint, n_features bigint, weight bigint")


def _ranked(
    docs: DataFrame,
    target: DataFrame,
    longest: int,
    buckets: int,
    percent: int,
    min_words: int,
    seed: int,
    id_column: str,
    text_column: str,
    target_text_column: str,
) -> DataFrame:
    spark = docs.sparkSession
    with Written(spark) as tables:
        scans = tables.keep(scanned(docs, id_column, text_column), "running-crcs")
        wanted = scanned(target.select(F.lit(0).alias("id"), named(target_text_column).alias("text")), "id", "text")
        gain = gains(bucket_counts(scans, longest, buckets), bucket_counts(wanted, longest, buckets))
        drawn = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
        number = F.conv(F.substring(F.sha2(drawn, 256), 1, 8), 16, 10).cast("bigint")
        luck = F.floor(-1000 * F.log(-F.log((number + F.lit(0.5)) / F.lit(4294967296.0))))
        scored = _weighed(scans, gain, longest).withColumn("score", F.col("weight") + luck)
        scored = scored.withColumn("eligible", F.col("n_words") >= min_words)
        order = [
            F.desc("eligible"), F.desc("score"), F.asc_nulls_last("id"), F.asc("weight"), F.asc("n_features"), F.asc("hash")
        ]
        table = sorted_table(scored, order, scored.columns)
    number = table.frame.where("eligible").count()
    rank = F.when(F.col("eligible") & (F.col("place") < number * percent // 100), F.col("place") + 1)
    return table.positions("place").select("id", "hash", "n_features", "weight", "score", rank.alias("rank"))


def importance_scores(
    docs: DataFrame,
    target: DataFrame,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    target_text_column: str = "text",
) -> DataFrame:
    """Per row of ``docs``: the id, ``n_features``, ``weight``, ``score`` and ``rank`` in the draw.

    Words are lower-cased (A to Z) runs of ASCII letters, digits and characters
    beyond ASCII.  Features are all runs of 1 to ``longest`` words, hashed into
    ``buckets`` by CRC-32.  A bucket's gain is the scaled log of how much
    likelier it is in all of ``target`` than in all of ``docs``; ``weight`` adds
    up a text's gains, ``score`` adds a fixed Gumbel number drawn from the id.
    Of the rows with ``min_words`` words or more, ``percent`` in a hundred with
    the highest scores are drawn; ``rank`` is 1, 2, … there and null elsewhere.

    Each text is scanned once.  What is kept of it, in a table, is the CRC of
    its normalised form up to each word's end; the CRC of any run of words
    follows from two of these.  Counts are added up in the tasks, and the
    driver sees one number per bucket.  The draw is one distributed sort of
    narrow rows.

    A null text has no words, no features and weight 0; a null id draws like an
    empty one and comes last among equal scores.  Rows that share an id draw
    the same number; rows repeated in all are ranked one after another.  No rows
    give no rows, and an empty ``target`` makes every gain that of one unseen.
    """
    rows = _ranked(
        docs, target, longest, buckets, percent, min_words, seed, id_column, text_column, target_text_column
    )
    return rows.select(F.col("id").alias(id_column), "n_features", "weight", "score", "rank")


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = LONGEST,
    buckets: int = BUCKETS,
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    target_text_column: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that :func:`importance_scores` draws, all columns as they were.

    Rows repeated in id and text are one document and come or stay together,
    so the draw may be larger by such repeats.
    """
    rows = _ranked(
        docs, target, longest, buckets, percent, min_words, seed, id_column, text_column, target_text_column
    )
    drawn = rows.where("rank is not null").select(F.col("id").alias("_drawn_id"), F.col("hash").alias("_drawn_hash"))
    same = named(id_column).eqNullSafe(drawn["_drawn_id"]) & (
        F.xxhash64(whole_text(text_column)) == drawn["_drawn_hash"]
    )
    return docs.join(drawn, same, "left_semi")
