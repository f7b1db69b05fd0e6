"""Connected components of links, as rounds of joins over stored tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.session import stored


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node linked to it directly or not) for links a-b that one task holds: as few rows as nodes."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = np.minimum(new, new[new])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[other], nodes[label[other]]


def components(links: DataFrame) -> DataFrame:
    """(``node``, ``root``): the smallest node reachable, for every node of ``links`` (``a``, ``b``) but the roots.

    Large-star and small-star rounds: links of a node go to its smallest neighbour, first those to larger nodes,
    then those to smaller ones, until nothing changes. The number of links never grows, and each round is a
    written table. Links of a node to itself count for nothing; without links the result is empty.
    """
    pairs = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = stored(pairs, "links")
    seen = None
    while True:
        # Large star: every larger neighbour of a node moves to the smallest of the node and its neighbours.
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("n"), F.least("a", "least").alias("m"))
        large = both.join(least, both["a"] == least["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: a node and its smaller neighbours move to the smallest of them.
        lower = large.where("a != b").distinct()
        smallest = lower.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "n")
        moved = lower.join(smallest, lower["a"] == smallest["n"])
        small = moved.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(smallest.select(F.col("n").alias("a"), F.col("m").alias("b")))
        following = stored(small.where("a != b").distinct(), "links")
        state = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return following.select(F.col("a").alias("node"), F.col("b").alias("root"))
        current, seen = following, state
