"""Connected components of an edge table, labelled by the smallest node.

Every partition first replaces its edges by a spanning star per local component. What is left
goes through alternating large-star and small-star rounds (min per node, joined back; a node of
very high degree is a skewed join with one row per key on the other side, which Spark splits),
each written to the shared folder, until a round changes nothing. Up to `one_task` edges, a
bounded number, a single task finishes at once; the result is the same.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm._common import Scratch

ONE_TASK = 400_000


#: Nodes that a task holds at a time; beyond them it sends its stars on and begins anew.
HELD_NODES = 1_000_000


class Forest:
    """Union-find: every component's root is its smallest node."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent, root = self.parent, x
        while (p := parent[root]) != root:
            root = p
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    def add(self, edges) -> None:
        parent = self.parent
        for u, v in edges:
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = self.find(u), self.find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)

    def roots(self) -> dict[int, int]:
        return {x: self.find(x) for x in self.parent}


def forest(edges) -> dict[int, int]:
    """node -> smallest node of its component, for an iterable of pairs."""
    f = Forest()
    f.add(edges)
    return f.roots()


def _contract(batches):
    """Arrow batches of (u, v) -> stars (u, root), u > root, over HELD_NODES nodes of the partition at a time."""

    def stars(f: Forest):
        rows = [(u, r) for u, r in f.roots().items() if u != r]
        for i in range(0, len(rows), 50_000):
            u, r = zip(*rows[i : i + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(r, pa.int64())], names=["u", "v"])

    held = Forest()
    for batch in batches:
        held.add(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        if len(held.parent) > HELD_NODES:
            yield from stars(held)
            held = Forest()
    yield from stars(held)


def connected_components(edges: DataFrame, scratch: Scratch, one_task: int = ONE_TASK) -> DataFrame:
    """edges(u long, v long) -> (node, component) for every node of an edge between different nodes."""
    stars = scratch.keep(edges.select("u", "v").where("u <> v").mapInArrow(_contract, "u long, v long"), "stars", narrow=True)
    if stars.count() <= one_task:
        stars = scratch.keep(stars.coalesce(1).mapInArrow(_contract, "u long, v long"), "star_forest")
        scratch.drop("stars")
    else:
        last, name, k = None, "stars", 0
        while True:
            both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
            large = both.join(low, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
            down = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
            small = large.join(down, F.col("u") == F.col("w")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
            k += 1
            stars = scratch.keep(small, f"stars{k}", narrow=True)
            scratch.drop(name)
            name = f"stars{k}"
            now = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if now == last:
                break
            last = now
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
