"""Connected components of an edge table, by alternating large-star and small-star joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import materialize

#: A forest of so many links at most is joined by one task, which needs no rounds.
ONE_TASK = 200_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of those edges and the smallest node that each is joined to by them; only nodes that aren't their own."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    roots = nodes[[root(x) for x in range(len(nodes))]] if len(nodes) else nodes
    return nodes[roots != nodes], roots[roots != nodes]


def _local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch of edges becomes a forest of stars: the same connections in fewer edges."""
    for b in batches:
        u, v = forest(np.asarray(b.column(0)), np.asarray(b.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _whole_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges of a partition, at once, as one forest of stars."""
    if held := list(batches):
        yield from _local_forests(iter(pa.Table.from_batches(held).combine_chunks().to_batches()))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge to another; component is its smallest node.

    Node ids are longs. Every batch of edges is cut to a forest first; forests
    of up to ONE_TASK edges together are joined by one task. Larger ones go by
    rounds, each of a dozen shuffles that the driver plans and follows. Every
    round joins each node's neighbours to the smallest of them, larger neighbours
    first, and is written to the shared folder; the loop ends when a round changes
    nothing. Loops and repeated edges are fine, null ends are ignored; no edges
    give no rows.
    """
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    star = materialize(pairs.mapInArrow(_local_forests, "u long, v long").distinct(), "components")
    if star.count() <= ONE_TASK:
        star = materialize(star.coalesce(1).mapInArrow(_whole_forest, "u long, v long"), "components")
        return star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    for _ in range(max_rounds):
        both = star.union(star.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        now = star.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == before:
            return star.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
