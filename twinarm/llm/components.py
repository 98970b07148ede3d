"""Connected components of a link table, by contraction of nodes to smaller ones that they reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def connected(links: DataFrame) -> DataFrame:
    """links (a, b) -> (node, root) for every node that has a link to another; root is the least node of its component.

    In a round each node hooks to the least of its neighbours and then to what that one hooks to, and links go on between the nodes hooked to. Only nodes without a
    smaller neighbour remain, at most half of them, so rounds grow with the logarithm of the nodes, however long chains are. Each round is
    written to the shared folder; only whether links are left comes to the driver.
    """
    left = materialise(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "links")
    labels = None
    while labels is None or not left.isEmpty():
        near = left.union(left.select("b", "a")).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("r"))
        further = near.select(F.col("a").alias("at"), F.col("r").alias("next"))
        hook = materialise(near.join(further, F.col("r") == F.col("at")).select("a", F.col("next").alias("r")), "hooks")
        if labels is None:
            labels = hook.select(F.col("a").alias("node"), F.col("r").alias("root"))
        else:
            labels = materialise(labels.join(hook, F.col("root") == F.col("a"), "left").select("node", F.coalesce("r", "root").alias("root")), "labels")
        ends = [hook.select(F.col("a").alias(f"_{x}"), F.col("r").alias(f"r_{x}")) for x in "ab"]
        moved = left.join(ends[0], F.col("a") == F.col("_a")).join(ends[1], F.col("b") == F.col("_b")).select("r_a", "r_b")
        left = materialise(moved.select(F.least("r_a", "r_b").alias("a"), F.greatest("r_a", "r_b").alias("b")).where("a <> b").distinct(), "links")
    return labels
