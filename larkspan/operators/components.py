"""Connected components for graphs of groups: label propagation with path shortening, one join a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.session import shared_dir


def connected(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of the nodes of edges (a, b); the root is the least node of its component.

    Each round is checkpointed, so that plans don't grow and lost executors recompute one round at most. It ends when
    no label changes; a chain of n nodes takes about log n rounds.
    """
    spark = edges.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")).checkpoint()
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        closer = labels.join(near, labels["node"] == near["a"]).select("node", F.least("root", "near").alias("root"))
        up = closer.select(F.col("node").alias("_up"), F.col("root").alias("_over"))
        after = closer.join(up, closer["root"] == up["_up"]).select("node", F.least("root", "_over").alias("root")).checkpoint()
        moved = after.join(labels.select("node", F.col("root").alias("_was")), "node").filter("root <> _was").limit(1).count()
        labels = after
        if not moved:
            return labels
    raise RuntimeError("components did not settle")
