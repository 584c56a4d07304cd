"""Connected components of a graph of links, by alternating large-star and small-star rounds.

Links never reach the driver: each round is two group-bys and two joins, and its edges are written to the working
folder. A node with very many links is aggregated map-side first; its join is an inner join of exchanges, which adaptive
execution splits. The rounds end when no node has two links and no chain is left, which is checked on the links themselves.

Results: a link of a node with itself is left out, repeated links count once; an empty table gives an empty result. Links with a
null end are left out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffled


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) as a forest: (node, smallest node of its component) for each node but the smallest."""
    if not len(a):
        return a, b
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        while not np.array_equal(up := root[root], root):
            root = up
        if np.array_equal(root, before):
            break
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))


def _are_stars(links: DataFrame) -> bool:
    """Whether each node has one link, to a node that has none down itself: then b is the smallest node of a's component."""
    several = links.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    chained = links.select(F.col("b").alias("a")).distinct().join(shuffled(links.select("a")), "a", "left_semi")
    return several.unionByName(chained).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node that is not itself the smallest. edges: (a, b) of one ordered type."""
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = materialize(links, "links")
    while not _are_stars(links):
        both = _both_ways(links)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(shuffled(least), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(shuffled(least), "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        links = materialize(small, "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
