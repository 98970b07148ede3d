"""Kernels against brute force and worked values."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from twinarm.functions import digits, fold, kernels
from twinarm.operators import scan, validation
from twinarm.operators.groups import first_fit
from twinarm.operators.validation import dinucleotide_shuffle


def random_graph(rng, n, p=0.5):
    return [(i, j, rng.random() + 0.2) for i in range(n) for j in range(i + 1, n) if rng.random() < p]


def component(n, edges, counts=None):
    a, b, w = (np.array(x) for x in zip(*edges)) if edges else (np.empty(0),) * 3
    return kernels.Component(np.ones(n) if counts is None else np.array(counts), a, b, w)


def test_spectrum_solves_the_generalised_problem():
    rng = random.Random(1)
    for n in (2, 5, 9):
        edges = random_graph(rng, n, 0.7) + [(i, i + 1, 1.0) for i in range(n - 1)]
        edges = list({(a, b): (a, b, w) for a, b, w in edges}.values())
        values, vectors = component(n, edges).lowest()
        w = np.zeros((n, n))
        for a, b, x in edges:
            w[a, b] = w[b, a] = x
        lap, deg = np.diag(w.sum(1)) - w, np.diag((w > 0).sum(1))
        assert np.allclose(lap @ vectors, deg @ vectors * values, atol=1e-9)
        assert values[0] == pytest.approx(0, abs=1e-9)


def test_uniform_clique_is_split_in_two():
    edges = [(i, j, 2.0) for i, j in itertools.combinations(range(6), 2)]
    values, _ = component(6, edges).lowest()
    assert values[1] == pytest.approx(12 / 5)
    assert kernels.cluster_count(values, 5.0) == 2


def test_small_components_are_one_cluster():
    assert kernels.spectral(component(1, []), 5.0)[0] == 1
    assert kernels.spectral(component(3, [(0, 1, 1.7), (1, 2, 0.4)]), 5.0)[0] == 1


def test_bridged_cliques_are_told_apart():
    edges = [(i, j, 1.8) for c in (range(5), range(5, 10)) for i, j in itertools.combinations(c, 2)] + [(4, 5, 0.21)]
    k, label = kernels.spectral(component(10, edges), 5.0)
    # The gap after the second eigenvalue asks for three clusters: the ends of the bridge are the third.
    assert k == 3 and len(set(label[:4])) == 1 and len(set(label[6:])) == 1 and len({label[0], label[4], label[9]}) == 3 and label[4] == label[5]


def brute_cliques(n, edges):
    near = {frozenset(e[:2]) for e in edges}
    full = [set(s) for r in range(1, n + 1) for s in itertools.combinations(range(n), r) if all(frozenset(p) in near for p in itertools.combinations(s, 2))]
    return sorted(tuple(sorted(s)) for s in full if not any(s < t for t in full))


def expanded(n, edges, counts):
    """The full graph of equal reads: node i stands for counts[i] neighbours in a row."""
    first = np.concatenate([[0], np.cumsum(counts)])
    at = [range(first[i], first[i + 1]) for i in range(n)]
    full = [(x, y, 2.0) for own in at for x, y in itertools.combinations(own, 2)]
    return int(first[-1]), full + [(x, y, w) for i, j, w in edges for x in at[i] for y in at[j]], at


def connected_graph(rng, n, p):
    edges = {(i, rng.randrange(i)): rng.random() + 0.2 for i in range(1, n)} | {(i, j): rng.random() + 0.2 for i in range(n) for j in range(i) if rng.random() < p}
    return [(j, i, w) for (i, j), w in edges.items()]


@pytest.mark.parametrize("seed", range(6))
def test_quotient_has_the_spectrum_of_all_reads(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 8)
    edges, counts = connected_graph(rng, n, 0.4), [rng.randint(1, 4) for _ in range(n)]
    many, full, at = expanded(n, edges, counts)
    small, large = component(n, edges, counts), component(many, full)
    if many < 2:
        return
    values, vectors = small.lowest()
    want, _ = large.lowest()
    assert np.allclose(small.spectrum(values), want) and np.allclose(small.spectrum(values[: kernels.LOWEST], kernels.LOWEST), want[: kernels.LOWEST])
    w = np.zeros((many, many))
    for a, b, x in full:
        w[a, b] = w[b, a] = x
    spread = np.repeat(vectors, counts, axis=0)
    assert np.allclose((np.diag(w.sum(1)) - w) @ spread, (w > 0).sum(1)[:, None] * spread * values)


@pytest.mark.parametrize("shape", ["tiling", "tight", "ring", "wide tiling"])
def test_lowest_pairs_without_a_matrix_of_all_nodes(shape, monkeypatch):
    """Both ways to iterate against the dense solver."""
    rng = np.random.default_rng(4)
    n = 900
    if shape == "tiling":
        start = np.sort(rng.integers(0, 3000, n))
        edges = [(i, j, 1 + rng.random()) for i in range(n) for j in range(i + 1, min(n, i + 12)) if start[j] - start[i] < 25] + [(i, i + 1, 1.0) for i in range(n - 1)]
    elif shape == "ring":
        edges = [(i, (i + 1) % n, 1.0) for i in range(n)]
    else:
        edges = [(i, int(j), 1 + rng.random()) for i in range(1, n) for j in {*rng.integers(0, i, 6).tolist()}]
        if shape == "wide tiling":
            monkeypatch.setattr(kernels, "FACTOR", 0)
            edges = [(i, j, 1 + rng.random()) for i in range(n) for j in range(i + 1, min(n, i + 60))]
    edges = list({(min(a, b), max(a, b)): (min(a, b), max(a, b), w) for a, b, w in edges}.values())
    graph = component(n, edges, rng.integers(1, 4, n))
    assert graph.levels().min() == 0
    values, vectors = graph.lowest()
    want = np.linalg.eigvalsh(graph.dense())[: kernels.LOWEST]
    assert vectors.shape == (n, kernels.LOWEST) and np.allclose(values, want, atol=1e-8)
    y = vectors / graph.scale[:, None]
    assert np.linalg.norm(graph.times(y) - y * values, axis=0).max() <= 1e-7


def greedy(n, edges):
    taken, chosen = set(), []
    for c in sorted(brute_cliques(n, edges), key=lambda c: (-len(c), c)):
        if not taken & set(c):
            taken |= set(c)
            chosen.append(c)
    return chosen


@pytest.mark.parametrize("seed", range(30))
def test_cliques_are_the_greedy_ones_of_all_reads(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 7)
    edges, counts = random_graph(rng, n, rng.choice([0.3, 0.5, 0.8])), [rng.randint(1, 2) for _ in range(n)]
    many, full, at = expanded(n, edges, counts)
    label = kernels.Cliques(component(n, edges, counts)).cover()
    got = [tuple(x for i in range(n) if label[i] == k for x in at[i]) for k in range(label.max() + 1)]
    assert got == greedy(many, full)
    assert got == [tuple(np.flatnonzero(kernels.Cliques(component(many, full)).cover() == k).tolist()) for k in range(len(got))]


def test_cliques_of_a_dense_graph_end():
    """The complement of triangles: 3 to the power of 40 maximal cliques, so they can't be listed."""
    n = 120
    edges = [(i, j, 1.0) for i in range(n) for j in range(i + 1, n) if i // 3 != j // 3]
    label = kernels.Cliques(component(n, edges)).cover()
    assert [sorted(np.flatnonzero(label == k).tolist()) for k in range(3)] == [list(range(k, n, 3)) for k in range(3)]


def test_first_fit_of_worked_extents():
    extents = [(0, 10, 112), (1, 21, 122), (2, 112, 150), (3, 122, 130), (4, 0, 500)]
    assert [k for _, k in first_fit(extents)] == [0, 1, 0, 1, 2]


def plain_first_fit(extents):
    colours, out = [], []
    for dg, lo, hi in sorted(extents):
        k = next((k for k, held in enumerate(colours) if all(min(b, hi) - max(a, lo) <= 0 for a, b in held)), len(colours))
        if k == len(colours):
            colours.append([])
        colours[k].append((lo, hi))
        out.append((dg, k))
    return out


@given(st.lists(st.tuples(st.integers(-40, 3000), st.sampled_from([-1, 0, 1, 2, 5, 17, 60, 900])), max_size=60))
@settings(max_examples=150, deadline=None)
def test_first_fit_as_by_all_pairs(ranges):
    extents = [(i, a, a + n) for i, (a, n) in enumerate(ranges)]
    assert first_fit(extents) == plain_first_fit(extents)


def test_first_fit_of_a_pile_and_of_many_groups():
    assert [k for _, k in first_fit([(i, i % 7, 100 + i % 5) for i in range(3000)])] == list(range(3000))
    rng = random.Random(2)
    starts = [rng.randrange(1_000_000) for _ in range(60_000)]
    assert max(k for _, k in first_fit([(i, at, at + rng.randrange(30, 90)) for i, at in enumerate(starts)])) < 40


@given(st.lists(st.tuples(st.integers(0, 80), st.integers(0, 30)), max_size=25))
@settings(max_examples=50, deadline=None)
def test_colours_hold_no_overlap(ranges):
    extents = [(i, a, a + n) for i, (a, n) in enumerate(ranges)]
    colour = dict(first_fit(extents))
    for (i, a, b), (j, c, d) in itertools.combinations(extents, 2):
        if colour[i] == colour[j]:
            assert min(b, d) - max(a, c) <= 0


def test_fold():
    structure, energy = fold.duplex("GGGCCC", "GGGCCC")
    assert len(structure) == 12 and structure.startswith("((((((") and structure.endswith("))))))") and energy < -8
    assert fold.duplex("AAAA", "AAAA") == ("........", 0.0)
    structure, _ = fold.duplex("GATTACAGG", "CCTGTAATC")
    assert set(structure[:9]) <= set("({.") and set(structure[9:]) <= set(")}.")


def plain_fold(left, right):
    """Probabilities of pairs and the ensemble's energy, structure by structure."""
    x, y, rt = left.replace("T", "U"), right.replace("T", "U"), fold.RT
    weak = lambda i, j: x[i] + y[j] not in ("GC", "CG")
    first = lambda a, b: fold.MISMATCH if a + b in ("UU", "GA", "AG") else 0.0
    total, of = 1.0, {}

    def go(pairs, energy):
        nonlocal total
        i, j = pairs[-1]
        weight = np.exp(-(energy + weak(i, j) * fold.WEAK_END) / rt)
        total += weight
        for p in pairs:
            of[p] = of.get(p, 0.0) + weight
        for p in range(i + 1, min(len(x), i + fold.REACH + 2)):
            for q in range(max(0, j - fold.REACH - 1), j):
                if x[p] + y[q] in fold.PAIRS:
                    a, b = p - i - 1, j - q - 1
                    step = fold.loop_energy(a, b) if a or b else 0.0
                    if a + b <= 1:
                        step += fold._stack(x[i], x[p], y[j], y[q])
                    elif not a or not b:
                        step += (weak(i, j) + weak(p, q)) * fold.WEAK_END
                    else:
                        step += (weak(i, j) + weak(p, q)) * fold.WEAK_LOOP + first(x[i + 1], y[j - 1]) + first(x[p - 1], y[q + 1])
                    go([*pairs, (p, q)], energy + step)

    for i in range(len(x)):
        for j in range(len(y)):
            if x[i] + y[j] in fold.PAIRS:
                go([(i, j)], fold.START + weak(i, j) * fold.WEAK_END)
    return {p: w / total for p, w in of.items()}, -rt * np.log(total)


@pytest.mark.parametrize("seed", range(12))
def test_fold_is_the_sum_over_structures(seed):
    rng = random.Random(seed)
    left, right = ("".join(rng.choice("ACGTN" if seed % 3 == 0 else "ACGT") for _ in range(rng.randint(1, 8))) for _ in range(2))
    structure, energy = fold.duplex(left, right)
    p, want = plain_fold(left, right)
    assert energy == pytest.approx(want, abs=1e-9)
    mark = lambda values, strong, weak: "".join(strong if v > 0.5 else weak if v > 0.2 else "." for v in values)
    best = lambda k, n: [max((v for key, v in p.items() if key[k] == i), default=0.0) for i in range(n)]
    assert structure == mark(best(0, len(left)), "(", "{") + mark(best(1, len(right)), ")", "}")


def test_fold_of_long_arms():
    structure, energy = fold.duplex("G" * 150, "C" * 150)
    assert structure == "(" * 150 + ")" * 150 and -3.26 * 149 + 4 - 20 < energy < -3.26 * 149 + 5
    rng = random.Random(1)
    arm = "".join(rng.choice("ACGT") for _ in range(2000))
    other = "".join({"A": "T", "C": "G", "G": "C", "T": "A"}[c] for c in reversed(arm))
    structure, energy = fold.duplex(arm, other)
    assert np.isfinite(energy) and energy < -3000 and structure.count("(") > 1900


def test_energies_of_many_arms_at_once():
    """Short arms in batches of many sizes, arms too long for plain weights, empty and unpaired ones, unknown letters: all as pair by pair, and equal pairs once."""
    rng = random.Random(7)
    arm = lambda most, letters: "".join(rng.choice(letters) for _ in range(rng.randint(0, most)))
    pairs = [(arm(24, "ACGTUN" if k % 3 else "acgt"), arm(33, "ACGT")) for k in range(60)] + [(arm(9, "AC"), arm(9, "AC")) for _ in range(5)]
    pairs += [("G" * 96, "C" * 96), ("G" * 130, "C" * 130), ("G" * 20, "AC" * 90), ("AC" * 90, "G" * 20), ("ACß", "GGT")]
    assert fold.duplex_energies(*map(list, zip(*pairs))) == pytest.approx([fold.duplex(*p)[1] for p in pairs], abs=1e-9)
    asked = []
    fold.KERNELS["length"] = lambda a, b: asked.append((a, b)) or ("", float(len(a + b)))
    try:
        assert fold.energies("length", ["A", "AC", "A"], ["G", "G", "G"]).tolist() == [2, 3, 2] and asked == [("A", "G"), ("AC", "G")]
    finally:
        del fold.KERNELS["length"]
    assert fold.energies("duplex", [], []).tolist() == []


@given(st.text("ACGT", min_size=1, max_size=30), st.integers(0, 5))
@settings(max_examples=60, deadline=None)
def test_shuffles_keep_neighbouring_pairs(text, seed):
    out = dinucleotide_shuffle(text, np.random.default_rng(seed))
    assert sorted(zip(out, out[1:])) == sorted(zip(text, text[1:])) and out[0] == text[0] and len(out) == len(text)


def test_shuffles_begin_with_the_stem_and_are_unbiased():
    rng = np.random.default_rng(3)
    arm = "ACAGATACCAGGA"
    drawn = [validation.distinct_shuffles(arm, "GG", 3, rng) for _ in range(600)]
    assert all(d[0] == (arm, "GG") and len(d) == len(set(d)) == 3 for d in drawn)
    assert validation.distinct_shuffles("AA", "CC", 5, rng) == [("AA", "CC")]
    # The second letters of what is kept are spread as those of all shuffles.
    kept = np.mean([d[1][0][1] == "C" for d in drawn])
    free = [s for s in (dinucleotide_shuffle(arm, rng) for _ in range(2000)) if s != arm]
    assert abs(kept - np.mean([s[1] == "C" for s in free])) < 0.08


@pytest.mark.parametrize("parts", [1, 5])
def test_running_sums_and_neighbours(spark, parts):
    """Ranges, ties, nulls, keys that span ranges and keys that lie in one, against plain loops."""
    rng = random.Random(parts)
    rows = [(rng.choice([None, "a", "b", "hot", "hot", "hot"]), rng.choice([None, *range(40)]), rng.choice([None, 1, 5, 7])) for _ in range(700)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k string, x int, v long, i int").repartition(parts)
    order = lambda r: (r["k"] is not None, r["k"] or "", r["x"] is not None, r["x"] or 0)
    got = sorted(scan.running(scan.ranged(df, ["k", "x"]), ["k"], ["x"], {"s": F.col("v"), "n": F.lit(1)}).collect(), key=lambda r: (*order(r), r["n"]))
    at, s, n = object(), 0, 0
    for r in got:
        if r["k"] != at:
            at, s, n = r["k"], 0, 0
        s, n = s + (r["v"] or 0), n + 1
        assert (r["s"], r["n"]) == (s, n)
    assert len(got) == 700 and scan.running(scan.ranged(df.where("false"), ["k"]), ["k"], ["k"], {"s": F.col("v")}).count() == 0
    unique = df.withColumn("x", F.col("i"))
    before = {r["x"]: r["p"] for r in scan.former(scan.ranged(unique, ["x"]), ["x"], "p", F.col("i")).collect()}
    assert before == {i: i - 1 if i else None for i in range(700)}


def test_sixteen_exact_decimals(spark):
    rng = random.Random(4)
    values = [0.0, 1.0, 0.5, 0.1, 2 / 3, 1.1, 0.07, 1 - 2**-53, 0.99999999999999995, 3 * 2**-17, 2**-29, 12345.678, 2.0**52 + 0.5, 0.00000000000000005 + 0.5, *(rng.random() * rng.choice([1, 1, 1e-3, 3, 1e5]) for _ in range(3000)), *(a / np.sqrt(b) for a in range(1, 40) for b in range(a * a, a * a + 30))]
    df = spark.createDataFrame([(float(v),) for v in values] + [(float("nan"),), (None,)], "x double")
    got = [r[0] for r in df.select(digits.fixed16(F.col("x"))).collect()]
    assert got[-2:] == ["nan", "nan"] and [g for g, v in zip(got, values) if g != "%.16f" % v] == []


def test_shuffles_of_many_stems_at_once():
    """A stem's shuffles are the same in any batch, keep neighbouring pairs, and all paths of a text come up equally often."""
    rng = random.Random(4)
    left, right = (["".join(rng.choice("ACGTN€"[: rng.randint(1, 6)]) for _ in range(rng.randint(0, 24))) for _ in range(150)] for _ in range(2))
    ids = np.arange(150) * 100 + 10
    drawn = validation.distinct_shuffles_of(left, right, 5, validation.keyed(ids, 0))
    pairs = lambda s: (len(s), s[:1], s[-1:], sorted(zip(s, s[1:])))
    for k, (a, b) in enumerate(zip(left, right)):
        assert drawn[k][0] == (a, b) and len(set(drawn[k])) == len(drawn[k]) <= 5
        assert all(pairs(x) == pairs(a) and pairs(y) == pairs(b) for x, y in drawn[k])
    assert max(map(len, drawn)) == 5 and min(map(len, drawn)) == 1
    for k in (0, 77, 149):
        assert validation.distinct_shuffles_of(left[k : k + 1], right[k : k + 1], 5, validation.keyed(ids[k : k + 1], 0)) == [drawn[k]]
    n = 12_000
    found = validation.Shuffles(["ACAGATACCAGA"] * n, validation.keyed(np.arange(n), 1)).draw(np.arange(n), 0)
    counts = [found.count(s) for s in set(found)]
    assert len(counts) == 60 and sum((c - n / 60) ** 2 / (n / 60) for c in counts) < 110
