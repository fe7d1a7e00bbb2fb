"""A Merkle manifest of a dataset: every row's witness, grown by streaming appends block by block."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablog.llm.columns import named
from tablog.llm.tables import Written
from tablog.operators.numbering import sorted_table
from tablog.plans.durable import attach, durable

FANOUT = 3
# Levels of a tree that one task builds: a block has FANOUT ** LEVELS nodes at most.
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined_hash(digests: list[bytes]) -> bytes:
    """The digest of digests, put together as hexadecimal text."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


@dataclass
class Subtree:
    """A complete subtree whose siblings are still to come: its digest and its appended nodes."""

    digest: bytes
    first: int
    stop: int


class Appender:
    """Nodes appended one after another; each one's witness grows as its siblings are completed.

    ``open[k]`` holds the subtrees of height k whose run is not full.  A run of
    ``fanout`` subtrees becomes one subtree of the next height, and every node
    below takes the digests of the others in the run, left to right, into its
    witness.
    """

    def __init__(self, fanout: int = FANOUT) -> None:
        self.fanout = fanout
        self.open: list[list[Subtree]] = [[]]
        self.witness: list[bytearray] = []

    def append(self, digest: bytes) -> None:
        at = len(self.witness)
        self.witness.append(bytearray())
        self._place(0, Subtree(digest, at, at + 1))

    def _place(self, height: int, tree: Subtree) -> None:
        if height == len(self.open):
            self.open.append([])
        self.open[height].append(tree)
        if len(self.open[height]) == self.fanout:
            self._place(height + 1, self._close(height))

    def _close(self, height: int) -> Subtree:
        run, self.open[height] = self.open[height], []
        for tree in run:
            others = b"".join(t.digest for t in run if t is not tree)
            if others:
                for at in range(tree.first, tree.stop):
                    self.witness[at] += others
        return Subtree(joined_hash([t.digest for t in run]), run[0].first, run[-1].stop)

    def seal(self, height: int | None = None) -> bytes:
        """Close what is open, up to ``height`` or until one node is left; the last node's digest."""
        level = 0
        while True:
            run = self.open[level]
            above = any(self.open[level + 1 :])
            if (level == height) if height is not None else (not above and len(run) == 1):
                return run[0].digest
            if run:
                self._place(level + 1, self._close(level))
            level += 1


def climbed(digest: bytes, at: int, count: int, witness: bytes, fanout: int = FANOUT) -> bytes:
    """The root that a node leads to, as number ``at`` of ``count``, with its siblings."""
    taken = 0
    while count > 1:
        place = at % fanout
        others = min(fanout, count - (at - place)) - 1
        run = [witness[taken + 32 * i : taken + 32 * (i + 1)] for i in range(others)]
        taken += 32 * others
        digest = joined_hash([*run[:place], digest, *run[place:]])
        at, count = at // fanout, -(-count // fanout)
    return digest


def grown(nodes: DataFrame, fanout: int, levels: int, tables: Written) -> tuple[DataFrame, DataFrame]:
    """Trees over ``nodes`` (``tree, at, count, digest``): each node's witness, and each tree's root.

    ``at`` is the node's number in its tree, ``count`` the tree's size.  Aligned
    blocks of nodes are appended in tasks of their own; their roots are the
    nodes that are appended next, and what those are given as a witness is
    added to that of all nodes below.  Returns ``tree, at, witness`` and
    ``tree, root``.
    """
    size = fanout**levels

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        tree, count = table.column("tree")[0].as_py(), table.column("count")[0].as_py()
        appender = Appender(fanout)
        for digest in table.column("digest").to_pylist():
            appender.append(digest)
        root = appender.seal(levels if count > size else None)
        at = table.column("at").to_pylist()
        n = len(at)
        return pa.table(
            {
                "tree": [tree] * n,
                "at": pa.array(at, pa.int64()),
                "count": [count] * n,
                "witness": pa.array(map(bytes, appender.witness), pa.binary()),
                "root": pa.array([root] + [None] * (n - 1), pa.binary()),
            }
        )

    layers = []
    while True:
        blocks = nodes.groupBy("tree", F.floor(F.col("at") / size).alias("block"))
        built = blocks.applyInArrow(build, "tree bigint, at bigint, count bigint, witness binary, root binary")
        built = tables.keep(built, "witnesses")
        layers.append(built)
        roots = built.where("root is not null").select(
            "tree",
            F.floor(F.col("at") / size).alias("at"),
            F.ceil(F.col("count") / size).alias("count"),
            F.col("root").alias("digest"),
        )
        if roots.where("count > 1").isEmpty():
            break
        nodes = roots
    # From the top: what a block's root has above it is also above its nodes.
    above = layers[-1].select("tree", "at", "witness")
    for layer in reversed(layers[:-1]):
        own = layer.select("tree", "at", F.col("witness").alias("own"), F.floor(F.col("at") / size).alias("block"))
        upper = above.select("tree", F.col("at").alias("block"), F.col("witness").alias("upper"))
        both = attach(own, upper, ["tree", "block"], spread="at", how="inner")
        above = both.select("tree", "at", F.concat("own", "upper").alias("witness"))
    return above, roots.select("tree", F.col("digest").alias("root"))


def field_text(value: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else its bytes' number, a colon and itself."""
    text = value.cast("string")
    size = F.octet_length(text).cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(size, F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of a row's fields put together."""
    return F.unhex(F.sha2(F.concat(*[field_text(v) for v in values]).cast("binary"), 256))


def merkle_manifest(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    id_column: str = "doc_id",
    tree_column: str = "source",
    fanout: int = FANOUT,
    levels: int = LEVELS,
    changed: dict[str, Column] | None = None,
) -> DataFrame:
    """Per row of ``docs``: the id, its ``leaf``, ``subroot``, ``root``, ``proof``, ``folded`` and ``verified``.

    Leaves are hashes of ``fields``.  Within a ``tree_column`` value they ascend
    by id; every ``fanout`` nodes in a row become one until one is left, the
    subroot, and the subroots, null first and else by their bytes, become the
    root in the same way.  Digests are binary.  ``proof`` has the siblings on
    the way from the leaf to the root, 32 bytes each; ``folded`` is the root
    that the row leads to with these siblings, where ``changed`` replaces
    fields of the row as it is now; ``verified`` says whether that is the root.

    Rows are sorted once, as digests; a tree of any size is cut into aligned
    blocks of ``fanout ** levels`` nodes that are appended in tasks of their
    own, then blocks of block roots, and so on.  No task or driver meets more
    than a block.

    Null fields hash as ``-``, an empty text as ``0:``.  Rows without an id come
    first in their tree; rows that share one are ordered by their leaves, and
    repeated rows are leaves of their own, with a proof each.  No rows give no
    rows.  Other columns of ``docs`` are not read.
    """
    now = changed or {}
    rows = docs.select(
        named(id_column).alias("id"),
        named(tree_column).cast("string").alias("name"),
        leaf_digest([named(f) for f in fields]).alias("leaf"),
        leaf_digest([now.get(f, named(f)) for f in fields]).alias("seen"),
    )
    order = [F.asc_nulls_first("name"), F.asc_nulls_first("id"), F.asc("leaf"), F.asc("seen")]
    with Written(docs.sparkSession) as tables:
        placed = sorted_table(rows, order, rows.columns).positions("place")
        sizes = placed.groupBy("name").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("count"))
        key = F.coalesce(F.concat(F.lit("n"), "name"), F.lit("")).alias("key")
        # Trees are told by the place of their first leaf, which also puts them in order.
        trees = durable(sizes.select(key, F.col("first").alias("tree"), "count"))
        leaves = attach(placed.withColumn("key", key), trees, ["key"], spread="place", how="inner")
        leaves = tables.keep(
            leaves.select("tree", (F.col("place") - F.col("tree")).alias("at"), "count", "id", "leaf", "seen"), "leaves"
        )
        witness, subroots = grown(leaves.select("tree", "at", "count", F.col("leaf").alias("digest")), fanout, levels, tables)
        subroots = durable(subroots)
        ranked = durable(sorted_table(subroots, [F.col("tree")], subroots.columns).positions("place"))
        number = ranked.count()
        tops = ranked.select(
            F.lit(0).cast("bigint").alias("tree"), F.col("place").alias("at"),
            F.lit(number).cast("bigint").alias("count"), F.col("root").alias("digest"),
        )
        above, roots = grown(tops, fanout, levels, tables) if number else (tops.withColumnRenamed("digest", "witness"), None)
        top = roots.first()["root"] if number else b""
        upper = ranked.join(above.select(F.col("at").alias("place"), F.col("witness").alias("upper")), "place")
        upper = durable(upper.select("tree", F.col("root").alias("subroot"), "place", "upper"))
        proven = leaves.join(witness, ["tree", "at"])
        proven = attach(proven, upper, ["tree"], spread="at", how="inner")

        def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                roots = [
                    climbed(climbed(seen, at, count, witness, fanout), place, number, above, fanout)
                    for at, count, place, seen, witness, above in zip(*[c.to_pylist() for c in batch.columns[1:7]])
                ]
                kept = [*batch.columns[:1], *batch.columns[7:], pa.array(roots, pa.binary())]
                yield pa.RecordBatch.from_arrays(kept, ["id", "leaf", "subroot", "proof", "folded"])

        kind = rows.schema["id"].dataType.simpleString()
        folded = proven.select(
            "id", "at", "count", "place", "seen", "witness", "upper", "leaf", "subroot",
            F.concat("witness", "upper").alias("proof"),
        ).mapInArrow(fold, f"id {kind}, leaf binary, subroot binary, proof binary, folded binary")
        root = F.lit(bytearray(top)).alias("root")
        return durable(
            folded.select(
                F.col("id").alias(id_column), "leaf", "subroot", root, "proof", "folded",
                (F.col("folded") == F.lit(bytearray(top))).alias("verified"),
            )
        )
