"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bagspark.session import materialise


LOCAL_EDGES = 1 << 20
"""A graph of at most this many edges (16 MiB) is finished in one task by union-find; the result is the same."""


def _united(batches):
    """(node, component) of all edges of a partition."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["node", "component"])


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with b < a.

    Large: every neighbour above a node moves to the least of the node and its neighbours. Small: a node and
    its neighbours below it move to the least of them.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        moved = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        low = edges.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = low.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where("b < a").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (a, b): the smallest node that it reaches.

    Large graphs take rounds; each is written to the shared folder, and they end when one changes nothing. Loops,
    repeated edges and either direction are allowed; no edges give no rows.
    """
    state = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    current = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = state(current)
    if 0 < seen[0] <= LOCAL_EDGES:
        return current.coalesce(1).mapInArrow(_united, "node long, component long")
    while seen[0]:
        current = materialise(_stars(_stars(current, large=True), large=False), "edges")
        now = state(current)
        if now == seen:
            break
        seen = now
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
