"""Components, spectra, cliques, colours and coverage of the derived reads against plain Python, pair by pair."""

import itertools
import os
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinarm.functions import kernels
from twinarm.operators import components, graph, groups, range_join
from twinarm.plans import queries, views

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.fixture(scope="module")
def reads(spark):
    return {r["read_id"]: r for r in views.arms(spark, SF).collect()}


def weights(reads, t):
    out = {}
    for a, b in itertools.combinations(sorted(reads), 2):
        x, y = reads[a], reads[b]
        if (x["l_gene"], x["r_gene"]) == (y["l_gene"], y["r_gene"]):
            r = [(min(x[f"{s}_stop"], y[f"{s}_stop"]) - max(x[f"{s}_start"], y[f"{s}_start"]) + 1) / (max(x[f"{s}_stop"], y[f"{s}_stop"]) - min(x[f"{s}_start"], y[f"{s}_start"]) + 1) for s in "lr"]
            if min(r) > t:
                out[a, b] = sum(r)
    return out


def parts(reads, edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    seen, out = set(), []
    for r in sorted(reads):
        if r not in seen:
            reach, todo = set(), [r]
            while todo:
                x = todo.pop()
                if x not in reach:
                    reach.add(x)
                    todo += near[x]
            seen |= reach
            out.append(sorted(reach))
    return out, near


def cliques(own, near):
    found = []

    def grow(clique, more, gone):
        if not more and not gone:
            found.append(tuple(sorted(clique)))
        for v in sorted(more):
            grow([*clique, v], more & near[v], gone & near[v])
            more, gone = more - {v}, gone | {v}

    grow([], set(own), set())
    taken, chosen = set(), []
    for c in sorted(found, key=lambda c: (-len(c), c)):
        if not taken & set(c):
            taken |= set(c)
            chosen.append(c)
    return chosen


def test_clique_groups(spark, reads):
    edges = weights(reads, 0.1)
    found, near = parts(reads, edges)
    want, base = {}, defaultdict(int)
    for own in sorted(found, key=lambda c: min(reads[x]["read_ord"] for x in c)):
        pair, chosen = (reads[own[0]]["l_gene"], reads[own[0]]["r_gene"]), cliques(own, near)
        want |= {x: base[pair] + k for k, c in enumerate(chosen) for x in c}
        base[pair] += len(chosen)
    assert {r["read_id"]: r["dg"] for r in queries.QUERIES["cliques_dg"](spark, SF).collect()} == want


def test_groups_of_cliques_by_hand(spark, reads):
    """The end-to-end run on clique groups: which are valid, their medians, extents, coverage and colours, all in plain Python."""
    edges = weights(reads, 0.1)
    found, near = parts(reads, edges)
    full, base, groups_of = {r["read_id"]: r for r in views.reads(spark, SF).collect()}, defaultdict(int), defaultdict(dict)
    for own in sorted(found, key=lambda c: min(reads[x]["read_ord"] for x in c)):
        pair, chosen = (reads[own[0]]["l_gene"], reads[own[0]]["r_gene"]), cliques(own, near)
        for k, c in enumerate(chosen):
            if len(c) > 1 and len({full[x]["l_seq"] + full[x]["r_seq"] for x in c}) > 1:
                groups_of[pair][base[pair] + k] = [reads[x] for x in c]
        base[pair] += len(chosen)
    want = []
    for pair, own in groups_of.items():
        held, colour = {}, {}
        members = [r for c in own.values() for r in c]
        beyond = lambda a, b: a["l_start"] > b["l_stop"] and a["r_start"] > b["r_stop"]
        if any(beyond(a, b) for c in own.values() for a in c for b in c):
            continue
        for dg in sorted(own):
            lo, hi = min(r["l_start"] for r in own[dg]), max(r["r_stop"] for r in own[dg])
            colour[dg] = next(k for k in itertools.count() if all(min(hi, b) - max(lo, a) <= 0 for a, b in held.get(k, [])))
            held.setdefault(colour[dg], []).append((lo, hi))
            med = {e: int(np.median([r[e] for r in own[dg]])) for e in ("l_start", "l_stop", "r_start", "r_stop")}
            n = [sum(r[f"{s}_start"] <= med[f"{s}_stop"] and med[f"{s}_start"] <= r[f"{s}_stop"] for r in members) for s in "lr"]
            want.append((*pair, dg, *med.values(), len(own[dg]), lo, hi, *n, round(len(own[dg]) / np.sqrt(n[0] * n[1]), 6), colour[dg]))
    got = queries.QUERIES["pipeline_cliques"](spark, SF).collect()
    columns = ["l_gene", "r_gene", "dg", "l_start", "l_stop", "r_start", "r_stop", "num_reads", "ext_min", "ext_max", "n_l", "n_r", "coverage", "ng"]
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(want) and len(want) > 20


def suggested(values, t):
    """How many clusters the lowest eleven eigenvalues suggest, gap by gap."""
    gaps = [b - a for a, b in zip(values[:11], values[1:11])]
    if len(gaps) <= 2:
        return 1
    if values[1] > 1 and values[1] >= 10 * np.median(gaps[1:]):
        return 2
    return next((i + 2 for i, g in enumerate(gaps) if g >= t * (np.median(gaps[:i]) if i else 1.0) and g > 0), 1)


def test_spectra_and_numbers_of_clusters(spark, reads):
    edges = weights(reads, 0.5)
    found, _ = parts(reads, edges)
    spectra, labels = defaultdict(list), defaultdict(set)
    for r in queries.QUERIES["component_spectra"](spark, SF).orderBy("rank").collect():
        spectra[r["component"]].append(r["eigenvalue"])
    for r in queries.QUERIES["spectral_dg"](spark, SF).collect():
        labels[r["component"]].add(r["dg"])
    assert len(labels) == len(found)
    for own in found:
        place = {x: i for i, x in enumerate(own)}
        w = np.zeros((len(own), len(own)))
        for a, b in itertools.combinations(own, 2):
            w[place[a], place[b]] = w[place[b], place[a]] = edges.get((a, b), 0.0)
        if len(own) > 1:
            values = np.sort(np.linalg.eigvals((np.diag(w.sum(1)) - w) / (w > 0).sum(1)[:, None]).real)
            assert np.allclose(spectra[own[0]], values, atol=1e-5)
            assert len(labels[own[0]]) == suggested(values, 5.0) or len(labels[own[0]]) < suggested(values, 5.0) and len(set(map(tuple, np.round(w, 9)))) < len(own)
        else:
            assert len(labels[own[0]]) == 1


def test_kmeans_finds_the_best_partition_of_far_clusters():
    rng = np.random.default_rng(5)
    for _ in range(10):
        points, k = np.repeat([[0.0, 0.0], [9.0, 1.0], [2.0, 8.0]], [3, 2, 3], axis=0) + rng.normal(size=(8, 2)), 3
        cost = lambda label: sum(((points[label == c] - points[label == c].mean(0)) ** 2).sum() for c in set(label.tolist()))
        best = min(cost(np.array(p)) for p in itertools.product(range(k), repeat=8) if len(set(p)) == k)
        assert cost(kernels.kmeans(points, k)) == pytest.approx(best)


def test_components_of_any_partitioning(spark, monkeypatch):
    rng = np.random.default_rng(6)
    pairs = [tuple(sorted(map(int, rng.integers(0, 400, 2)))) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)]
    want = {x: c[0] for c in parts(range(600), [p for p in pairs if p[0] != p[1]])[0] for x in c}
    nodes = spark.range(600).withColumnRenamed("id", "read_id")
    edges = spark.createDataFrame(pairs, "src bigint, dst bigint")
    for df in (edges, edges.repartition(23), edges.coalesce(1)):
        assert {r["read_id"]: r["component"] for r in components.components(nodes, df).collect()} == want
    names = {r["read_id"]: r["component"] for r in components.components(nodes.select(F.format_string("r%04d", "read_id").alias("read_id")), edges.select(F.format_string("r%04d", "src").alias("src"), F.format_string("r%04d", "dst").alias("dst"))).collect()}
    assert names == {f"r{k:04d}": f"r{v:04d}" for k, v in want.items()}


def test_coverage_and_apart_reads_by_pairs_of_rows(spark, reads):
    members = views.arms(spark, SF).withColumn("dg", F.expr("l_start div 60"))
    stats = groups.medians(members)
    for g in groups.coverage(stats, members).collect():
        own = [r for r in reads.values() if (r["l_gene"], r["r_gene"]) == (g["l_gene"], g["r_gene"])]
        met = [sum(r[f"{s}_start"] <= g[f"{s}_stop"] and g[f"{s}_start"] <= r[f"{s}_stop"] for r in own) for s in "lr"]
        assert [g["n_l"], g["n_r"]] == met
    key = lambda r: (r["l_gene"], r["r_gene"], r["l_start"] // 60)
    beyond = lambda a, b: a["l_start"] > b["l_stop"] and a["r_start"] > b["r_stop"]
    want = {a["read_id"] for a in reads.values() for b in reads.values() if key(a) == key(b) and (beyond(a, b) or beyond(b, a))}
    assert {r["read_id"] for r in groups.non_overlapping(members).collect()} == want and want


def test_full_cells_are_shared(spark, reads):
    """A cell that holds a third of all rows gives the same pairs in parts, none of which has more than its share of smaller rows."""
    r = views.arms(spark, SF)
    hot = r.withColumns({"l_start": F.col("read_id") % 9 + 100, "l_stop": F.col("read_id") % 5 + 112, "r_start": F.col("read_id") % 7 + 160, "r_stop": F.col("read_id") % 11 + 175, "read_id": F.col("read_id") + 10**6, "l_gene": F.lit("x"), "r_gene": F.lit("y")}).limit(300)
    both = r.unionByName(hot)
    sides = (("l_start", "l_stop"), ("r_start", "r_stop"))
    whole = {(x["src"], x["dst"]) for x in graph.overlapping_pairs(both).collect()}
    parts = range_join.rectangle_pairs(both, graph.PAIR, "read_id", sides, cell_rows=20)
    got = parts.select(F.col("a.read_id").alias("src"), F.col("b.read_id").alias("dst"), F.col("a._part").alias("part"), "a._x", "a._y", "a.l_gene")
    rows = got.collect()
    assert len(rows) == len(whole) and {(x["src"], x["dst"]) for x in rows} == whole
    assert {x["part"] for x in rows if x["l_gene"] == "x"} >= set(range(10))


def test_edges(spark, reads):
    for t in (0.1, 0.5):
        got = {(r["src"], r["dst"]): r["weight"] for r in graph.edges(views.arms(spark, SF), t).collect()}
        want = weights(reads, t)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
