"""Signs along the minimum spanning forest of a weighted graph, by Boruvka rounds.

Each component takes its least edge (of equal weight the one of smaller ids, so the order is total and the forest
one), components so joined become one, and each carries the sign between it and its new root. A round is a grouping and
a few joins over components; edges inside a component go, and of those between two components the least stays. Before the first
round, edges that are the longest of a cycle among some hundred thousand neighbouring ones are left out, since
no forest of the whole has them. What is left below ``SMALL`` edges is finished in one task by the same rounds in arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, written

#: Edges of one task's arrays, and edges that one task finishes.
LOT, SMALL = 400_000, 400_000
EDGE = "a long, b long, w double, s int"


def forest(a: np.ndarray, b: np.ndarray, s: np.ndarray, order: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which edges are in the forest, each node's root, and its sign against the root; ``order``: edges from the least on."""
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    root, sign, taken = np.arange(n), np.ones(n, np.int64), np.zeros(len(a), bool)
    live = np.arange(len(a))
    while True:
        live = live[root[a[live]] != root[b[live]]]
        if not len(live):
            return taken, root, sign
        best = np.full(n, len(a), np.int64)
        for end in (a, b):
            np.minimum.at(best, root[end[live]], rank[live])
        parts = np.flatnonzero(best < len(a))
        e = order[best[parts]]
        taken[e] = True
        parent, turn = np.arange(n), np.ones(n, np.int64)
        parent[parts] = np.where(root[a[e]] == parts, root[b[e]], root[a[e]])
        turn[parts] = s[e] * sign[a[e]] * sign[b[e]]
        first = parts[(parent[parent[parts]] == parts) & (parts < parent[parts])]
        parent[first], turn[first] = first, 1
        while (parent[parent] != parent).any():
            turn, parent = turn * turn[parent], parent[parent]
        sign, root = sign * turn[root], parent[root]


def _local(columns: list[np.ndarray], ends: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node names, and the ends as numbers of them."""
    u, v = columns[ends[0]], columns[ends[1]]
    ids, place = np.unique(np.r_[u, v], return_inverse=True)
    return ids, place[: len(u)], place[len(u) :]


def _pruned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b, w, s) less those that no forest has."""

    def kept(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        columns = [c.to_numpy() for c in table.columns]
        ids, a, b = _local(columns, (0, 1))
        taken, _, _ = forest(a, b, columns[3].astype(np.int64), np.lexsort((columns[1], columns[0], columns[2])), len(ids))
        return pa.RecordBatch.from_arrays([pa.array(c[taken]) for c in columns], schema=table.schema)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= LOT:
            yield kept(held)
            held = []
    if held and sum(x.num_rows for x in held):
        yield kept(held)


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges that are left (u, v, w, a, b, s) to u, root, turn."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    columns = [c.to_numpy() for c in pa.Table.from_batches(held).columns]
    ids, u, v = _local(columns, (0, 1))
    _, root, sign = forest(u, v, columns[5].astype(np.int64), np.lexsort((columns[4], columns[3], columns[2])), len(ids))
    yield pa.record_batch([pa.array(ids), pa.array(ids[root]), pa.array(sign.astype(np.int32))], names=["u", "root", "turn"])


def _joined(edges: DataFrame) -> DataFrame:
    """u, root, turn: where each component goes in one round."""
    ways = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w", "a", "b", "s"))
    least = written(ways.groupBy("u").agg(F.min(F.struct("w", "a", "b", "v", "s")).alias("e")).select("u", F.col("e.v").alias("root"), F.col("e.s").alias("turn")), "least")
    # Two that chose the same edge point at each other: the smaller is the root.
    other = least.select(F.col("u").alias("root"), F.col("root").alias("back"))
    first = (F.col("back") == F.col("u")) & (F.col("u") < F.col("root"))
    now = written(least.join(other, "root").select("u", F.when(first, F.col("u")).otherwise(F.col("root")).alias("root"), F.when(first, 1).otherwise(F.col("turn")).alias("turn")), "pointers")
    while True:
        up = now.select(F.col("u").alias("root"), F.col("root").alias("up"), F.col("turn").alias("more"))
        now = written(now.join(up, "root").select("u", F.col("up").alias("root"), (F.col("turn") * F.col("more")).alias("turn"), (F.col("up") != F.col("root")).alias("moved")), "pointers")
        if now.where("moved").isEmpty():
            return now.drop("moved")


def _between(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The least edge between each two of the new components."""
    for end in "uv":
        edges = edges.join(roots.select(F.col("u").alias(end), F.col("root").alias(f"to_{end}"), F.col("turn").alias(f"turn_{end}")), end)
    s = F.col("s") * F.col("turn_u") * F.col("turn_v")
    met = edges.where("to_u <> to_v").groupBy(F.least("to_u", "to_v").alias("u"), F.greatest("to_u", "to_v").alias("v")).agg(F.min(F.struct("w", "a", "b", s.alias("s"))).alias("e"))
    return met.select("u", "v", "e.w", "e.a", "e.b", "e.s")


def signs(edges: DataFrame, near: list, small: int | None = None) -> DataFrame:
    """node, root, sign for each node of a graph of edges (a, b, w, s): s is 1 or -1, and the sign is their product along the forest's path from the node to its component's root. ``near``: columns by which edges close to each other come into one task."""
    ship_package(edges.sparkSession)
    small = SMALL if small is None else small
    close = edges.repartitionByRange(*near).sortWithinPartitions(*near).select("a", "b", "w", "s")
    left = written(close.mapInArrow(_pruned, EDGE).select(F.col("a").alias("u"), F.col("b").alias("v"), "w", "a", "b", "s"), "forest-edges")
    roots: DataFrame | None = None
    while True:
        n = left.count()
        if n <= small:
            turned = written(left.coalesce(1).mapInArrow(_finished, "u long, root long, turn int"), "roots")
        else:
            turned = _joined(left)
            left = written(_between(left, turned), "forest-edges")
        if roots is None:
            roots = turned
        else:
            more = turned.select(F.col("u").alias("root"), F.col("root").alias("up"), F.col("turn").alias("more"))
            met = roots.join(more, "root", "left")
            roots = written(met.select("u", F.coalesce("up", "root").alias("root"), (F.col("turn") * F.coalesce("more", F.lit(1))).alias("turn")), "roots")
        if n <= small:
            return roots.select(F.col("u").alias("node"), "root", F.col("turn").alias("sign"))
