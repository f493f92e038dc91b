"""Connected components over an edge table, by alternating star contractions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import SALTS, materialise, salt


def _star(edges: DataFrame, larger: bool, salts: int = SALTS) -> DataFrame:
    """Join the neighbours of each node to the least of its neighbourhood: the larger neighbours, or the others.

    The least neighbours aggregate before their shuffle; they meet the edges by node and salt, a row for each salt that
    the node's edges have, so that a hub's edges are spread and no table outgrows the edges.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if larger else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    both = both.withColumn("s", salt("v", salts=salts))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("s").alias("held")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"), "held")
    met = both.join(least.select("w", "m", F.explode("held").alias("t")), (F.col("u") == F.col("w")) & (F.col("s") == F.col("t")))
    if larger:
        return met.filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
    moved = met.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("w").alias("b")))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (a, b); the root is the component's least node.

    Each round writes its edges, a table no longer than the last, and ends when they no longer change.
    """
    edges = materialise(edges.select("a", "b").filter("a <> b").distinct())
    state = None
    for _ in range(rounds):
        edges = materialise(_star(_star(edges, larger=True), larger=False))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (root, node) that connect what the given edges connect among n nodes; n - 1 of them at most."""
    label = np.arange(n)
    while len(left):
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        np.minimum.at(label, before[left], low)
        np.minimum.at(label, before[right], low)
        label = label[label]
        if np.array_equal(before, label):
            break
    node = np.flatnonzero(label != np.arange(n))
    return label[node], node
