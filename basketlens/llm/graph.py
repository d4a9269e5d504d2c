"""Connected components of an edge frame, as Spark jobs, and of small arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.runtime import checkpoint


def local_components(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest member of the component of each of n nodes, by edges (i, j)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of its component, for each node of an edge (a, b).

    Alternates two steps until every node points at its root: each node's
    larger neighbours are given its smallest neighbour, then each node's
    smaller neighbours are.  Both take a minimum per node (combined before
    the shuffle) and a join, so a hub sends one row a task, and its join is
    split when it is skewed.  Each round is checkpointed.  Nulls: an edge
    without both ends is no edge.  No edges: no rows.
    """
    edges = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = checkpoint(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        pulled = small.where("b != low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        stars = checkpoint(pulled.union(low.select("a", F.col("low").alias("b"))).distinct())
        # done when no node has two roots and no root has a root
        rows, nodes = stars.agg(F.count("*"), F.count_distinct("a")).first()
        edges = stars
        if rows == nodes and stars.join(stars.select(F.col("a").alias("b")), "b", "left_semi").isEmpty():
            break
    roots = edges.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
