"""Connected components over an edge table.

Edges are contracted inside partitions first: a partition's edges become a forest of stars, the smallest node of each of its components in the middle, so as many edges are left as it
has nodes, less its components. While more edges are left than one task may hold, alternating large-star and small-star rounds bring them
together (a groupBy(min) and a join on the node each; their number grows with the logarithm of a component's size), on as many partitions as the edges need, and each round is contracted
again. What fits is contracted once more as a whole. Each round is checkpointed in the shared folder; a count and a sum per round come to the driver.

Defined cases: links of a node to itself and nulls are left out; repeated links count once; no edges give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, thrifty

#: Edges that one task contracts at a time: two numbers of 8 bytes each, and some arrays of as many.
MOST_EDGES = 1 << 20


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of every node that isn't the smallest: hooking to smaller parents and pointer jumping."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        x, y = parent[u], parent[v]
        apart = x != y
        if not apart.any():
            break
        u, v = u[apart], v[apart]
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (parent != (up := parent[parent])).any():
            parent = up
    low = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[low], nodes[parent[low]]


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (a, b) -> stars of each MOST_EDGES of them."""
    rest, n = [], 0

    def drawn() -> pd.DataFrame:
        a, b = stars(*(np.concatenate([x[c].to_numpy(np.int64) for x in rest]) for c in "ab"))
        return pd.DataFrame({"a": a, "b": b})

    for batch in batches:
        rest.append(batch)
        n += len(batch)
        if n >= 2 * MOST_EDGES:
            rest = [drawn()]
            n = len(rest[0])
            if n >= MOST_EDGES:  # a forest this large is passed on
                yield rest[0]
                rest, n = [], 0
    if n:
        yield drawn()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b). Large star: neighbours above a node go to the smallest of all; small star: those below, and the node itself."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = both if large else both.where("b < a")
    least = seen.groupBy("a").agg(F.min("b").alias("m"))
    if large:
        moved = both.join(least.withColumn("m", F.least("a", "m")), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = seen.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))
    return moved.distinct()


def components(edges: DataFrame, most_rounds: int = 60, most_edges: int = MOST_EDGES) -> DataFrame:
    """edges (a, b), bigints -> (node, root), root the smallest node reachable; only nodes with links."""
    contracted = lambda e: e.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b").mapInPandas(thrifty(_contract), "a bigint, b bigint")
    sums = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
    edges = cut(contracted(edges))
    was = sums(edges)
    for _ in range(most_rounds):
        if was[0] <= most_edges:
            edges = cut(contracted(edges.coalesce(1)))
            break
        # on no more partitions than they need
        needed = -(-4 * was[0] // most_edges)
        edges = cut(_star(_star(contracted(edges.coalesce(needed)), large=True), large=False))
        now = sums(edges)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components: no end of rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
