"""Connected components of an edge table, by alternating large and small stars.

Every round is a minimum by node and a join on the node, so a node with very many links is summed before the shuffle
and its join side is one row; Spark splits the other side.  Tasks first reduce their own edges to a forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


class Forest:
    """Union-find over any hashable ids; the least id of a tree is its root."""

    def __init__(self) -> None:
        self.up: dict = {}

    def root(self, x):
        up = self.up
        top = x
        while (y := up.get(top, top)) != top:
            top = y
        while (y := up.get(x, x)) != top:
            up[x] = top
            x = y
        return top

    def join(self, a, b) -> bool:
        """Whether a and b were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        return True


#: Edges that a task reduces to a forest at a time.
EDGES_AT_ONCE = 200_000


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()

    def out() -> pa.RecordBatch:
        nodes = np.fromiter(forest.up, np.int64, len(forest.up))
        roots = np.fromiter((forest.root(x) for x in nodes.tolist()), np.int64, len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.up) > EDGES_AT_ONCE:
            yield out()
            forest = Forest()
    yield out()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge (a, b) to another; root is the component's least node.

    Ids are integers.  Null ends, loops and repeated edges count for nothing; no edges give no rows.
    """
    now = edges.where("a <> b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).mapInArrow(_reduce, "a long, b long")
    now = cut(now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        now = _large_star(now)
        now = cut(_small_star(now))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked with its least neighbour, or with the node itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked with the least of them.  Edges are (larger, smaller)."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return (edges.join(least, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
