"""Connected components of a graph given as a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import written


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """From links (a, b) between long numbers: node, root, where root is the smallest node reachable.

    Alternating star contraction: first every node hangs its larger neighbours on
    its smallest one, then every node hangs itself and its smaller neighbours on the
    smallest. The number of rounds grows with the logarithm of the longest chain.
    Groups are only ever reduced by min(), and each round is written to the shared
    folder. Links that are stars already need no round. Nodes without links don't
    appear. Links of a node to itself are ignored.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        if _are_stars(edges):
            break
        # In every edge a > b.
        low = edges.union(edges.select("b", "a")).groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
        large = edges.join(low, "b").select("a", F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = written(small.select("e.a", "e.b").where("a <> b").distinct())
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end of an edge has one edge only, and is no smaller end of another."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("a").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up + down > 1").isEmpty()


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the links (a, b) between n places are enough to connect what all of them connect."""
    root, used = np.arange(n), np.zeros(len(a), bool)
    while True:  # every tree takes one link to another tree, the smallest of its links
        apart = np.flatnonzero(root[a] != root[b])
        if not len(apart):
            return used
        first = np.full(n, len(a))
        np.minimum.at(first, root[a[apart]], apart)
        np.minimum.at(first, root[b[apart]], apart)
        used[chosen := np.unique(first[first < len(a)])] = True
        low, high = np.minimum(root[a[chosen]], root[b[chosen]]), np.maximum(root[a[chosen]], root[b[chosen]])
        parent = np.arange(n)
        np.minimum.at(parent, high, low)
        while (parent != parent[parent]).any():
            parent = parent[parent]
        root = parent[root]
