"""The overlap graph of reads and its clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.intervals import ratio
from .components import components, ensure_checkpoints
from .range_join import rectangle_pairs

PAIR = ["l_gene", "r_gene"]
_ARMS = ["read_id", "l_gene", "r_gene", "l_start", "l_stop", "r_start", "r_stop"]


def _ratios(side: str):
    return ratio(*(F.col(f"{t}.{side}_{e}") for t in "ab" for e in ("start", "stop")))


def overlapping_pairs(reads: DataFrame, width: int = 16) -> DataFrame:
    """Pairs of reads of a gene pair that overlap on both arms: l_gene, r_gene, src < dst, ratio_l, ratio_r."""
    met = rectangle_pairs(reads.select(*_ARMS), PAIR, "read_id", (("l_start", "l_stop"), ("r_start", "r_stop")), width)
    return met.select("a.l_gene", "a.r_gene", F.col("a.read_id").alias("src"), F.col("b.read_id").alias("dst"), _ratios("l").alias("ratio_l"), _ratios("r").alias("ratio_r"))


def edges(reads: DataFrame, t: float, width: int = 16) -> DataFrame:
    """Edges of reads whose arms both overlap by more than t of their span; weight is the sum of both ratios."""
    found = overlapping_pairs(reads, width).where((F.col("ratio_l") > t) & (F.col("ratio_r") > t))
    return found.withColumn("weight", F.col("ratio_l") + F.col("ratio_r"))


def degrees(edge: DataFrame) -> DataFrame:
    """Per node with edges: degree and weighted degree."""
    ends = edge.select(F.explode(F.array("src", "dst")).alias("read_id"), "weight")
    return ends.groupBy("read_id").agg(F.count("*").alias("degree"), F.sum("weight").alias("weighted_degree"))


def with_components(reads: DataFrame, edge: DataFrame) -> DataFrame:
    """reads with the component of each."""
    return reads.join(components(reads, edge), "read_id")


_ENDS = ["l_start", "l_stop", "r_start", "r_stop"]


def quotient(reads: DataFrame) -> DataFrame:
    """Reads of a gene pair with equal arms as one row: their least read_id and read_ord, and n, how many they are.

    Such reads are joined to each other and to the same others, so edges, components and clusters of these rows are those of the reads, and edges grow with the number of
    different arms instead of the square of the reads at one place.
    """
    return reads.groupBy(*PAIR, *_ENDS).agg(F.min("read_id").alias("read_id"), F.min("read_ord").alias("read_ord"), F.count("*").alias("n"))


def of_all_reads(reads: DataFrame, found: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """reads with columns of found, a table by read_id of rows (from :func:`quotient`). One key may hold most reads; Spark splits such a join."""
    each = rows.select("read_id", *_ENDS, *PAIR).join(found.select("read_id", *columns), "read_id").drop("read_id")
    return reads.join(each, [*PAIR, *_ENDS])


def _per_component(placed: DataFrame, edge: DataFrame) -> DataFrame:
    """One row per component, for a kernel: its nodes in order, how many reads each is, and its edges, as arrays."""
    own = F.struct("read_id", F.col("n") if "n" in placed.columns else F.lit(1).cast("bigint").alias("n"))
    nodes = placed.groupBy(*PAIR, "component").agg(F.sort_array(F.collect_list(own)).alias("nodes"), F.min("read_ord").alias("first_ord"))
    at = placed.select(F.col("read_id").alias("src"), "component")
    inner = edge.join(at, "src").groupBy("component").agg(F.collect_list(F.struct("src", "dst", "weight")).alias("links"))
    met = nodes.join(inner, "component", "left")
    return met.select(*PAIR, "component", "first_ord", F.col("nodes.read_id").alias("nodes"), F.col("nodes.n").alias("counts"), *[F.col(f"links.{c}").alias(c) for c in ("src", "dst", "weight")])


def _local(row) -> kernels.Component:
    if row.src is None or not len(row.src):
        return kernels.Component(row.counts, *(np.empty(0),) * 3)
    return kernels.Component(row.counts, np.searchsorted(row.nodes, row.src), np.searchsorted(row.nodes, row.dst), row.weight)


_LABELS = "l_gene string, r_gene string, component {id}, first_ord bigint, read_id {id}, k int, label int"


def _labelled(placed: DataFrame, edge: DataFrame, kernel) -> DataFrame:
    def run(frames):
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                if len(r.counts) == 1 and r.counts[0] == 1:
                    out.append((r.l_gene, r.r_gene, r.component, r.first_ord, 1, r.nodes, np.zeros(1, np.int64)))
                    continue
                k, label = kernel(_local(r))
                kept = label >= 0
                out.append((r.l_gene, r.r_gene, r.component, r.first_ord, k, r.nodes[kept], label[kept]))
            if out:
                *once, nodes, labels = zip(*out)
                sizes = [len(x) for x in labels]
                columns = {n: np.repeat(np.array(v), sizes) for n, v in zip(("l_gene", "r_gene", "component", "first_ord", "k"), once)}
                yield pd.DataFrame(columns | {"read_id": np.concatenate(nodes), "label": np.concatenate(labels)})[["l_gene", "r_gene", "component", "first_ord", "read_id", "k", "label"]]

    kind = placed.schema["read_id"].dataType.simpleString()
    return _per_component(placed, edge).mapInPandas(run, _LABELS.format(id=kind))


def numbered(labelled: DataFrame) -> DataFrame:
    """(l_gene, r_gene, read_id, component, dg): labels shifted by the clusters of the pair's earlier components, in order of their first reads."""
    each = labelled.groupBy(*PAIR, "component").agg(F.min("first_ord").alias("o"), F.max("k").alias("k"))
    order = Window.partitionBy(*PAIR).orderBy("o", "component").rowsBetween(Window.unboundedPreceding, -1)
    base = each.select(*PAIR, "component", F.coalesce(F.sum("k").over(order), F.lit(0)).alias("base"))
    return labelled.join(base, [*PAIR, "component"]).select(*PAIR, "read_id", "component", (F.col("base") + F.col("label")).cast("bigint").alias("dg"))


def spectral_groups(placed: DataFrame, edge: DataFrame, t_eig: float = 5.0, embedding: str = "columns") -> DataFrame:
    """Duplex groups by spectral clustering of each component; placed may have n, how many equal reads a row stands for."""
    return numbered(_labelled(placed, edge, lambda g: kernels.spectral(g, t_eig, embedding)))


def clique_groups(placed: DataFrame, edge: DataFrame) -> DataFrame:
    """Duplex groups by greedy disjoint cliques of each component; reads left over get none. placed may have n, how many equal reads a row stands for."""

    def kernel(g):
        label = kernels.Cliques(g).cover()
        return int(label.max()) + 1, label

    return numbered(_labelled(placed, edge, kernel))


def clustered(reads: DataFrame, t: float, cluster: str = "spectral", t_eig: float = 5.0, embedding: str = "columns") -> DataFrame:
    """(l_gene, r_gene, read_id, component, dg) of all reads that get a group. Edges, components and clusters are those of the different arms (:func:`quotient`)."""
    ensure_checkpoints(reads)
    # Written once each to the shared folder: what follows reads them several times, and a lost executor doesn't repeat the joins before.
    rows = quotient(reads).checkpoint()
    edge = edges(rows, t).checkpoint()
    placed = with_components(rows, edge)
    found = spectral_groups(placed, edge, t_eig, embedding) if cluster == "spectral" else clique_groups(placed, edge)
    return of_all_reads(reads.select("read_id", *PAIR, *_ENDS), found, rows, ["component", "dg"]).select(*PAIR, "read_id", "component", "dg")


def spectra(placed: DataFrame, edge: DataFrame) -> DataFrame:
    """Eigenvalues of each component of two reads or more, by rank: all of them, or the lowest of a component with more than ``kernels.DENSE`` different reads."""

    def values(g: kernels.Component) -> np.ndarray:
        return g.spectrum(g.lowest()[0], None if g.n <= kernels.DENSE else kernels.LOWEST)

    def run(frames):
        for f in frames:
            rows = [(r.component, i, float(x)) for r in f.itertuples(index=False) for i, x in enumerate(values(_local(r)))]
            yield pd.DataFrame(rows, columns=["component", "rank", "eigenvalue"])

    kind = placed.schema["read_id"].dataType.simpleString()
    several = _per_component(placed, edge).where("aggregate(counts, 0L, (a, x) -> a + x) > 1")
    return several.mapInPandas(run, f"component {kind}, rank int, eigenvalue double")
