"""Connected components of an edge table: forests within tasks, and contraction of nodes to smaller ones that they reach."""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges that a task joins up at once.
FOREST_EDGES = 2_000_000


def ensure_checkpoints(df: DataFrame) -> None:
    """Set a checkpoint folder only for a local master for which none is named (tests)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir():
        return
    named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="twinarm-"))


def _least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of some edges and the least node that each reaches over them."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    index = index.reshape(2, -1)
    root = np.arange(len(nodes))  # sorted, so the least node is the least place
    while True:
        x, y = root[index[0]], root[index[1]]
        apart = x != y
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]


def forests(edges: DataFrame) -> DataFrame:
    """edges (a, b) as fewer ones that connect the same nodes: each task links the nodes of its edges to the least that they reach."""
    kind = edges.schema["a"].dataType.simpleString()

    def join_up(frames):
        held, size = [], 0
        for f in frames:
            held.append(f)
            size += len(f)
            if size >= FOREST_EDGES:
                held = [_forest(held)]
                size = len(held[0])
                if size >= FOREST_EDGES // 2:  # little to join up here
                    yield held.pop()
                    size = 0
        if held:
            yield _forest(held)

    return edges.mapInPandas(join_up, f"a {kind}, b {kind}")


def _forest(held: list[pd.DataFrame]) -> pd.DataFrame:
    both = pd.concat(held)
    nodes, least = _least_reached(both["a"].to_numpy(), both["b"].to_numpy())
    apart = nodes != least
    return pd.DataFrame({"a": nodes[apart], "b": least[apart]})


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (read_id) and edges (src, dst) -> (read_id, component), component being the least read_id reached; isolated nodes are their own.

    In a round each node hooks to the least of its neighbours and then to what that one hooks to, and edges go on between the nodes hooked to. Only
    nodes without a smaller neighbour remain, at most half of them, so rounds grow with the logarithm of the nodes, however long the paths are.
    """
    ensure_checkpoints(nodes)
    labels = nodes.select("read_id", F.col("read_id").alias("component"))
    left = forests(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).checkpoint()
    while not left.isEmpty():
        near = left.union(left.select("b", "a")).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("r"))
        next_ = near.select(F.col("a").alias("at"), F.col("r").alias("next"))
        hook = near.join(next_, F.col("r") == F.col("at")).select("a", F.col("next").alias("r")).checkpoint()
        labels = labels.join(hook, F.col("component") == F.col("a"), "left").select("read_id", F.coalesce("r", "component").alias("component")).checkpoint()
        ends = [hook.select(F.col("a").alias(f"_{x}"), F.col("r").alias(f"r_{x}")) for x in "ab"]
        moved = left.join(ends[0], F.col("a") == F.col("_a")).join(ends[1], F.col("b") == F.col("_b")).select(F.col("r_a").alias("a"), F.col("r_b").alias("b"))
        left = forests(moved.where("a <> b")).checkpoint()
    return labels
