"""Repeated passages: documents parsed against blocks of an index of earlier passages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablog.llm.columns import named, whole_text
from tablog.llm.words import Words, joined, text_chunks

WINDOW = 13
SEED = 11
# Rows without an id count as later than all others.
NO_ID = (1 << 63) - 1


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers byte by byte: first all lowest bytes, and so on.  Equal planes compress away."""
    return values.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)


def _first_ids(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each row (sorted by hash) is the first of its hash, and the least id of its hash."""
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    least = np.minimum.reduceat(ids, np.flatnonzero(new)) if len(ids) else ids
    return new, least[np.cumsum(new) - 1]


def repeated_windows(
    docs: DataFrame, id_column: str, text_column: str, window: int, blocks: int
) -> DataFrame:
    """Windows that start in a document with a smaller id: rows of ``_id`` and ``_hash``.

    Each task sends a window once, for the smallest of its own ids that has it,
    to the block of the index that covers its hash; the others it reports at
    once.  So a passage found in a third of all documents reaches its block
    once per chunk of text, not once per document.  A block knows each window's
    first document and reports the rest.
    """

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["block", "ids", "hashes"]
        edges = (np.arange(1, blocks, dtype=object) * (1 << 64) // blocks).astype(np.uint64)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, texts in text_chunks(batch.column(1)):
                words = Words(texts)
                hashes, first = words.sequences(words.hashes(), window, SEED)
                own = np.searchsorted(words.first, first, "right") - 1
                order = np.argsort(hashes)
                hashes, of = hashes[order], ids[a:b][own[order]]
                _, least = _first_ids(hashes, of)
                late = of > least
                rows = []
                for first_block, part in ((0, ~late), (-blocks, late)):  # below 0: found already
                    part_hashes, part_ids = hashes[part], of[part]
                    cuts = [0, *np.searchsorted(part_hashes, edges).tolist(), len(part_hashes)]
                    rows += [
                        (first_block + k, _planes(part_ids[x:y]), _planes(part_hashes[x:y]))
                        for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:]))
                        if y > x
                    ]
                columns = list(zip(*rows)) or [[]] * 3
                kinds = [pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    def look_up(table: pa.Table) -> pa.Table:
        ids = np.concatenate([_unplanes(x) for x in table.column("ids").to_pylist()]).view(np.int64)
        hashes = np.concatenate([_unplanes(x) for x in table.column("hashes").to_pylist()])
        if table.column("block")[0].as_py() >= 0:
            order = np.argsort(hashes)
            hashes, ids = hashes[order], ids[order]
            late = ids > _first_ids(hashes, ids)[1]
            hashes, ids = hashes[late], ids[late]
        return pa.table({"id": ids, "hash": hashes.view(np.int64)})

    rows = docs.select(order_id(id_column).alias("id"), whole_text(text_column).alias("text"))
    sent = rows.mapInArrow(index, "block int, ids binary, hashes binary")
    found = sent.groupBy("block").applyInArrow(look_up, "id bigint, hash bigint")
    return found.select(F.col("id").alias("_id"), F.col("hash").alias("_hash"))


def order_id(id_column: str):
    return F.coalesce(named(id_column).cast("bigint"), F.lit(NO_ID))


def drop_repeated(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    window: int = WINDOW,
    blocks: int | None = None,
) -> DataFrame:
    """Per row of ``docs``: the id, ``n_words``, ``n_removed``, ``spans`` and the ``kept`` text.

    A document is parsed from left to right into factors, runs of words that
    occur in documents with a smaller id.  A factor of ``window`` words or more
    is removed.  The index is cut into ``blocks`` by the hash of a window, so
    every window of a document is looked up in the one block that can hold it,
    and a factor is a maximal run of windows found; windows across the boundary
    of two factors are looked up like any other, so what only matches there is
    not lost.  ``spans`` has the factors' first words and lengths, joined where
    they overlap; ``kept`` has the other words, joined by one space.

    Windows are compared by 64-bit hashes of their words.  Null texts have no
    words.  Rows that share an id are one document to the others and never
    repeat each other; rows without an id come after all others.  ``blocks``
    should grow with the input; by default there are two for every shuffle
    partition.
    """
    if blocks is None:
        blocks = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = repeated_windows(docs, id_column, text_column, window, blocks)
    per_id = found.groupBy("_id").agg(F.collect_list("_hash").alias("_late"))
    rows = docs.select(
        order_id(id_column).alias("_id"), named(id_column).alias("_own"), whole_text(text_column).alias("_text")
    )
    kind = rows.schema["_own"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            late = batch.column(2)
            for a, b, texts in text_chunks(batch.column(1)):
                words = Words(texts)
                hashes, first = words.sequences(words.hashes(), window, SEED)
                hit = np.zeros(len(words.start) + 1, np.int32)
                edges = np.searchsorted(first, words.first)
                for i, known in enumerate(late[a:b]):
                    if known.is_valid:
                        own = slice(edges[i], edges[i + 1])
                        known = known.values.to_numpy().view(np.uint64)
                        starts = first[own][np.isin(hashes[own], known)]
                        np.add.at(hit, starts, 1)
                        np.add.at(hit, starts + window, -1)
                keep = np.cumsum(hit[:-1]) == 0
                gone = np.concatenate([[0], np.cumsum(~keep)])
                removed = np.diff(gone[words.first])
                spans, ends = _runs(~keep, words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[a:b],
                        pa.array(words.count.astype(np.int64)),
                        pa.array(removed.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), spans),
                        pa.array(map(bytes, joined(words, keep)), pa.binary()),
                    ],
                    ["id", "n_words", "n_removed", "spans", "kept"],
                )

    given = rows.join(per_id, "_id", "left").select("_own", "_text", "_late")
    spans = "array<struct<start: bigint, words: bigint>>"
    parsed = given.mapInArrow(parse, f"id {kind}, n_words bigint, n_removed bigint, spans {spans}, kept binary")
    return parsed.select(
        F.col("id").alias(id_column), "n_words", "n_removed", "spans", F.col("kept").cast("string").alias("kept")
    )


def _runs(gone: np.ndarray, words: Words) -> tuple[pa.Array, np.ndarray]:
    """Runs of removed words within each text, and the texts' offsets among them."""
    start = gone.copy()
    start[1:] &= ~gone[:-1]
    heads = words.first[:-1][words.count > 0]
    start[heads] = gone[heads]
    last = gone.copy()
    last[:-1] &= ~gone[1:]
    tails = words.first[1:][words.count > 0] - 1
    last[tails] = gone[tails]
    begin, end = np.flatnonzero(start), np.flatnonzero(last)
    text = np.searchsorted(words.first, begin, "right") - 1
    spans = pa.StructArray.from_arrays(
        [pa.array(begin - words.first[text], pa.int64()), pa.array(end - begin + 1, pa.int64())],
        ["start", "words"],
    )
    return spans, np.searchsorted(begin, words.first).astype(np.int32)
