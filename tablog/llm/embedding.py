"""Near-duplicate vectors: int8 tile products, full precision only where the bounds leave doubt."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablog.llm.columns import named
from tablog.llm.links import components
from tablog.plans.durable import durable

THRESHOLD = 0.9
# Vectors of a group; two groups meet in a task.  Rows of a tile product made at once.
GROUP = 8192
TILE = 1024
# Above what single-precision sums of the scaled products and the bounds themselves can be off.
SLACK = 1e-4


def quantised(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors as int8 codes, a scale per vector, and the length of what the codes leave out."""
    scale = np.maximum(np.abs(vectors).max(1), 1e-300) / 127
    codes = np.rint(vectors / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(vectors - codes * scale[:, None], axis=1)
    return codes, scale, error


def linked_pairs(
    x: np.ndarray, y: np.ndarray, threshold: float, same: bool
) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all rows of ``x`` and ``y`` (unit vectors) whose product reaches the threshold.

    With x = s·q + e, the product of two vectors differs from that of their
    codes by at most |e| + |f| + |e||f|.  Pairs surely below or surely above
    are settled by the codes; the others are multiplied in double precision.
    ``same``: x is y, and each pair is wanted once.
    """
    (qx, sx, ex), (qy, sy, ey) = quantised(x), quantised(y)
    right = np.ascontiguousarray((qy * sy[:, None]).astype(np.float32).T)
    most = ey.max(initial=0.0)
    found = []
    for a in range(0, len(x), TILE):
        tile = (qx[a : a + TILE] * sx[a : a + TILE, None]).astype(np.float32) @ right
        e = ex[a : a + TILE]
        near = tile >= (threshold - e - most - e * most - SLACK).astype(np.float32)[:, None]
        i, j = np.nonzero(near)
        if same:
            i, j = i[j > i + a], j[j > i + a]
        for k in range(0, len(i), 1 << 18):
            ik, jk = i[k : k + (1 << 18)], j[k : k + (1 << 18)]
            value = tile[ik, jk].astype(np.float64)
            doubt = e[ik] + ey[jk] + e[ik] * ey[jk] + SLACK
            sure = value - doubt >= threshold
            open_ = np.flatnonzero(~sure & (value + doubt >= threshold))
            exact = np.einsum("ij,ij->i", x[a + ik[open_]], y[jk[open_]])
            sure[open_] = exact >= threshold
            found.append((a + ik[sure], jk[sure]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def forest(count: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For every node the smallest index it reaches over the pairs."""
    root = np.arange(count)
    while len(i):
        low, high = np.minimum(root[i], root[j]), np.maximum(root[i], root[j])
        apart = low < high
        i, j = i[apart], j[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root[root] != root).any():
            root = root[root]
    return root


def near_vectors(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    threshold: float = THRESHOLD,
    group: int = GROUP,
) -> DataFrame:
    """Per row: the id, ``n_links``, ``component_id`` and ``kept``.

    All pairs of vectors of one dimension are compared; they link when their
    cosine, in double precision, is at least ``threshold``.  Equal vectors are
    one item with a count.  Items fall into groups of about ``group``, and
    every two groups meet in a task, whose products are tiles of int8 codes.
    A task returns a link count per item and a spanning forest of its links,
    never the links themselves, so large groups of near copies stay small.

    Vectors that are null, empty or zero, or hold null or non-finite numbers,
    link with nothing, like rows without an id, whose ``component_id`` is null
    and which are kept.  Rows repeating an id and vector count as further
    vectors; different vectors of one id are one item.
    """
    wide = F.transform(named(vector_column), lambda v: v.cast("double"))
    rows = vectors.select(named(id_column).cast("bigint").alias("id"), wide.alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.col("id").isNotNull() & F.coalesce(finite & F.exists("vec", lambda v: v != 0), F.lit(False))
    rows = rows.withColumn("ok", usable)
    items = durable(
        rows.where("ok").groupBy("vec").agg(F.min("id").alias("item"), F.count(F.lit(1)).alias("size"))
    )
    groups = items.count() // group + 1
    mine = F.pmod(F.xxhash64("item"), F.lit(groups))
    dealt = items.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint"))))
    dealt = dealt.select(
        F.size("vec").alias("dim"),
        F.least("mine", "other").alias("first"),
        F.greatest("mine", "other").alias("second"),
        "mine", "item", "size", "vec",
    )

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
        mine, item = table.column("mine").to_numpy(), table.column("item").to_numpy()
        size = table.column("size").to_numpy()
        vec = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(item), -1)
        # Scaled first, so that no square overflows.
        vec = vec / np.abs(vec).max(1, keepdims=True)
        vec = vec / np.linalg.norm(vec, axis=1, keepdims=True)
        left = np.flatnonzero(mine == first)
        right = left if first == second else np.flatnonzero(mine == second)
        i, j = linked_pairs(vec[left], vec[right], threshold, first == second)
        i, j = left[i], right[j]
        links = np.bincount(i, size[j], len(item)) + np.bincount(j, size[i], len(item))
        by_item = np.argsort(item, kind="stable")
        place = np.empty(len(item), np.int64)
        place[by_item] = np.arange(len(item))
        root = by_item[forest(len(item), place[i], place[j])[place]]
        told = np.flatnonzero(links)
        return pa.table({"item": item[told], "root": item[root[told]], "links": links[told].astype(np.int64)})

    met = durable(
        dealt.groupBy("dim", "first", "second").applyInArrow(meet, "item bigint, root bigint, links bigint")
    )
    linked = components(met.select(F.col("item").alias("a"), F.col("root").alias("b")))
    counts = met.groupBy("item").agg(F.sum("links").alias("links"))
    told = (
        items.join(counts, "item", "left")
        .join(linked.withColumnRenamed("node", "item"), "item", "left")
        .select("vec", F.coalesce("component", "item").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("links"))
    )
    given = rows.select("id", F.when(F.col("ok"), F.col("vec")).alias("vec"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return given.join(told, "vec", "left").select(
        F.col("id").alias(id_column),
        F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"),
        (F.col("id").isNull() | (F.col("id") == component)).alias("kept"),
    )
