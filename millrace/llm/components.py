"""Connected components of a graph of links, by repeated contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import stage


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, root) that join the same nodes as the links (a, b), at most one for each node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        # hook the roots as well as the nodes, then let everything point past its parent
        for side in (label[u], label[v], u, v):
            np.minimum.at(new, side, least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    linked = label != np.arange(len(nodes))
    return nodes[linked], nodes[label[linked]]


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a long, b long); the component is its smallest node.

    Each round points every node at its smallest neighbour, follows the pointers to their ends, and replaces the links
    by those between the ends; at least half of the remaining nodes go away. Nothing but link counts reaches the driver. A hub
    with very many links is one key of partial aggregates and of joins whose skewed side Spark splits.
    """
    rest = stage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    found: DataFrame | None = None
    while not rest.isEmpty():
        both = rest.select(F.col("a").alias("node"), F.col("b").alias("to")).union(rest.select(F.col("b").alias("node"), F.col("a").alias("to")))
        ends = _follow(stage(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("to")), "ends"))
        found = ends if found is None else _through(found, ends)
        left, right = ends.select(F.col("node").alias("a"), F.col("to").alias("a_end")), ends.select(F.col("node").alias("b"), F.col("to").alias("b_end"))
        moved = rest.join(left, "a").join(right, "b").where("a_end <> b_end")
        rest = stage(moved.select(F.least("a_end", "b_end").alias("a"), F.greatest("a_end", "b_end").alias("b")).distinct(), "links")
    if found is None:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.select("node", F.col("to").alias("component"))


def _follow(ends: DataFrame) -> DataFrame:
    """Replace each pointer by the end of its chain; the length of what is left of a chain halves every time."""
    while True:
        further = ends.select(F.col("node").alias("to"), F.col("to").alias("_next"))
        jumped = stage(ends.join(further, "to").select("node", F.col("_next").alias("to"), (F.col("_next") != F.col("to")).alias("_moved")), "ends")
        ends = jumped.select("node", "to")
        if jumped.where("_moved").isEmpty():
            return ends


def _through(found: DataFrame, ends: DataFrame) -> DataFrame:
    """Earlier pointers, led on by those of a later round."""
    later = ends.select(F.col("node").alias("to"), F.col("to").alias("_next"))
    return stage(found.join(later, "to", "left").select("node", F.coalesce("_next", "to").alias("to")), "ends")
