"""Top-k search, the Jaccard join and suffix deduplication against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from twinarm.llm import components, jaccard, shingles, suffix_dedup, topk

DOC = "doc_id bigint, text string, node string, n string, digest string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], DOC)


def brute_topk(rows, k=5):
    usable = {(i, tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, q in usable:
        if i % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in usable if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 70)
    monkeypatch.setattr(topk, "LEAF_ROWS", 8)
    monkeypatch.setattr(topk, "SAMPLE_ROWS", 150)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4).round(1)]) for i in range(400)]
    rows += [rows[50], (401, None), (402, [None, 1.0, 1.0, 1.0]), (403, [float("nan")] * 4), (404, [float("inf")] * 4), (None, [9.0] * 4), (450, [1.0, 2.0]), (451, [1.0, 2.0]), (500, [0.0] * 4), (550, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, score int")
    search = lambda d: sorted(map(tuple, topk.search(d.select("vec_id", topk.quantised(F.col("embedding")).alias("v")), F.col("vec_id") % 50 == 0).collect()))
    assert search(df) == brute_topk(rows)
    assert search(df.where("false")) == []
    hot = rows + [(i, rows[7][1]) for i in range(1000, 1300)]  # one vector in nearly half of all rows
    assert search(spark.createDataFrame([(*r, 1) for r in hot], "vec_id bigint, embedding array<float>, score int")) == brute_topk(hot)


def test_vectors_of_one_id_are_shared_by_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 64)
    rng = np.random.default_rng(3)
    rows = [(7, [int(x) for x in rng.integers(-99, 99, 3)]) for _ in range(2000)] + [(i, [int(x) for x in rng.integers(-99, 99, 3)]) for i in range(100, 400)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, v array<bigint>").withColumn("q", F.lit(False))
    assert topk.index(topk.placed(vectors)).agg(F.max("n")).first()[0] < 200


def test_topk_of_large_numbers(spark):
    big = [(0, [3_000_000_001, 3_000_000_007]), (1, [1_500_000_011, 1_000_000_003]), (2, [1_500_000_011, 1_000_000_004]), (3, [1_500_000_012, 1_000_000_003])]
    df = spark.createDataFrame(big, "vec_id bigint, v array<bigint>")
    want = sorted((-sum(a * b for a, b in zip(big[0][1], v)), i) for i, v in big[1:])
    assert [(r["vec_id"], r["score"]) for r in topk.search(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(i, -s) for s, i in want]


def test_topk_opens_few_leaves_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 500)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16)) * 400
    rows = [(i, [int(x) for x in centres[i % 40] + rng.normal(size=16) * 8]) for i in range(8000)]
    got = topk.found(spark.createDataFrame(rows, "vec_id bigint, v array<bigint>"), F.col("vec_id") % 100 == 0, 5)
    assert got.agg(F.sum("scored")).first()[0] < 0.15 * 80 * 8000


def test_ball_tree_bounds_hold():
    rng = np.random.default_rng(2)
    v, q = rng.integers(-50, 50, (500, 6)), rng.integers(-50, 50, (20, 6)).astype(float)
    tree = topk.BallTree.from_bytes(topk.BallTree(np.arange(500), v).to_bytes())
    bounds, starts = tree.bounds(q), [0, *tree.ends[:-1]]
    for leaf, (a, b) in enumerate(zip(starts, tree.ends)):
        assert (q @ tree.vectors[a:b].T <= bounds[:, leaf][:, None]).all()


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (40, 40)], "a bigint, b bigint")
    assert {r["node"]: r["root"] for r in components.connected(chain).collect()} == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 32: 30}
    assert components.connected(chain.where("false")).count() == 0


def test_components_of_long_chains_take_few_rounds(spark, monkeypatch):
    order = random.Random(3).sample(range(2000), 2000)
    written = []
    monkeypatch.setattr(components, "materialise", lambda df, label, keep=components.materialise: written.append(label) or keep(df, label))
    got = components.connected(spark.createDataFrame([*zip(order[:1500], order[1:1501]), *zip(order[1600:], order[1601:])], "a bigint, b bigint"))
    want = {x: min(c) for c in (order[:1501], order[1600:]) for x in c}
    assert {r["node"]: r["root"] for r in got.collect()} == want and written.count("hooks") <= 11


def brute_components(rows):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                i = len(sets[a] & sets[b])
                if i and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return {d: (len(sets[d]), label[d]) for d in sets}


@pytest.mark.parametrize("few", [True, False])
def test_jaccard(spark, monkeypatch, few):
    """Also without broadcasts, and with the lists of all tokens ranked in parts."""
    if not few:
        monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
        monkeypatch.setattr(jaccard, "LIST_NODES", 2)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one two"), (4, "ONE\ttwo"), (5, "two one"), (6, "a b c d e"), (7, "A b c d e"), (8, "a b c d e f")]
    base = [rng.choice(words) for _ in range(80)]
    common = [rng.choice(words) for _ in range(25)]
    for i in range(10, 60):
        w = list(base if i % 3 else [rng.choice(words) for _ in range(rng.randint(3, 70))] + common)
        for _ in range(rng.randint(0, 4)):
            p = rng.randrange(len(w))
            w[p : p + 1] = rng.choice([[], [rng.choice(words)], [w[p], rng.choice(words)]])
        rows.append((i, " ".join(w)))
    rows += [(100, " ".join(base)), (101, " ".join(base)), (102, "x " * 40_000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.similar_components(docs(spark, [*rows, (None, "one two"), (101, " ".join(base))])).collect() if r["doc_id"] is not None}
    assert got == brute_components(rows)


def test_candidates_of_groups_of_mixed_sizes(spark):
    """A group's larger members may be similar to a query three bands up though its least one isn't."""
    band = lambda n: int(np.floor(np.log(n) / np.log(jaccard.BAND)))
    assert band(1060) == band(1080) == 49 and band(1436) == 52
    rows = [(7, node, n, 0, comp, nodes, band(n), asks, not asks, grp) for node, n, comp, nodes, asks, grp in [(1, 1060, 1, 2, False, 10), (2, 1080, 1, 2, False, 10), (3, 1436, 3, 1, True, 30)]]
    df = spark.createDataFrame(rows, "tok bigint, node bigint, n bigint, pos int, comp bigint, nodes bigint, band int, asks boolean, asked boolean, grp bigint")
    assert [tuple(r) for r in jaccard._candidates(df).collect()] == [(3, 10)]
    assert jaccard._candidates(df.where("node <> 2")).count() == 0


def test_rare_tokens_stay_rare_where_counters_are_full(spark):
    """A million other tokens in each counter: rare ones still make lists of one part, and frequent ones stand apart."""
    rng = np.random.default_rng(8)
    counts = rng.poisson(1e6, 1 << jaccard.SLICE_BITS)
    counts[:3] = 1_050_000, 2_000_000, 900_000_000
    parts = [counts // 2, counts - counts // 2]
    rows = [(0, zlib.compress(x.astype("<u4").tobytes())) for x in parts] + [(None, None)]
    ranks = jaccard.token_ranks(spark.createDataFrame(rows, "slice int, counts binary"))[: 1 << jaccard.SLICE_BITS].astype(float)
    assert (2 ** ((ranks[3:] + 1) / 3) < 2 * jaccard.LIST_NODES).all() and np.median(ranks) < 30
    assert ranks[3:].max() < ranks[0] < ranks[1] < ranks[2]


def test_jaccard_of_nothing(spark):
    assert jaccard.similar_components(docs(spark, [])).count() == 0
    assert [(r["doc_id"], r["component_id"]) for r in jaccard.similar_components(docs(spark, [(4, None)])).collect()] == [(4, 4)]


def test_shingles_of_cut_texts(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab cd efg é".split()) for _ in range(rng.randint(0, 400))) for _ in range(30)] + ["x" * 500, "", None]
    whole = [s.tolist() for s in shingles.sets(texts)]
    monkeypatch.setattr(shingles, "CHUNK", 64)
    assert [s.tolist() for s in shingles.sets(texts)] == whole


def brute_dedup(rows):
    seen, out = set(), {}
    for d, t in sorted(set(rows)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for q in range(len(b) - 99):
            s = b[q : q + 100]
            if s in seen:
                gone[q : q + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[d] = (len(b), len(b) - len(kept), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("hot", [30_000, 4])
def test_suffix_dedup(spark, monkeypatch, small, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    if small:
        monkeypatch.setattr(suffix_dedup, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(suffix_dedup, "BUCKET", 50)
        monkeypatch.setattr(suffix_dedup, "RUN", 40)
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    p, q = text(150), text(99)
    rows = [(0, None), (1, ""), (2, "short"), (3, p), (4, text(50) + p + text(70) + p), (5, q + text(20)), (6, text(20) + q), (7, p), (8, "ab" * 300), (9, "ab" * 300), (10, "x" * 99), (11, "x" * 101), (12, p[:120] + text(40) + p[30:]), (13, "yz " * 5000)]
    rows += [(20 + i, text(rng.randint(0, 60)) + p[rng.randint(0, 40) :] + text(30)) for i in range(12)]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.report(docs(spark, [*rows, (3, p)])).collect()}
    assert got == brute_dedup(rows)


@pytest.mark.parametrize("hot", [30_000, 8])
def test_suffix_dedup_of_one_passage_in_every_document(spark, monkeypatch, hot):
    """At its end each document goes on in its own way: one seed has as many suffixes as there are documents."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "RUN", 160)
    cloudpickle.register_pickle_by_value(suffix_dedup)
    rng = random.Random(11)
    text = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    p, ends = text(180), [text(40) for _ in range(3)]
    rows = [(i, text(rng.randint(0, 150)) + p + (ends[i % 3] if i % 2 else "") + text(rng.randint(0, 150))) for i in range(90)]
    try:
        got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.report(docs(spark, rows).repartition(3)).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(suffix_dedup)
    assert got == brute_dedup(rows)


def test_suffix_dedup_of_equal_ids(spark):
    """Other texts of one doc_id are documents of their own, in some order: together they lose what two documents would."""
    rng = random.Random(12)
    a, b, c = ("".join(rng.choices("abcdefgh", k=300)) for _ in range(3))
    rows = [(1, a + b), (1, b + c), (1, "short"), (1, a + b), (2, c + a)]
    got = sorted(tuple(r)[:4] for r in suffix_dedup.report(docs(spark, rows)).collect())
    assert [r[1] for r in got] == [5, 600, 600, 600, 600] and got[0][2] == 0 and got[4] == (2, 600, 600, 1)
    assert sorted(r[2] for r in got[1:4]) in ([0, 0, 300], [0, 300, 300])


def test_suffix_dedup_of_many_texts_of_one_id(spark, monkeypatch):
    """More texts of a doc_id than have numbers: what goes is what would go if each were a document, in order of their md5."""
    monkeypatch.setattr(suffix_dedup, "MOST", 3)
    rng = random.Random(13)
    text = lambda n: "".join(rng.choices("abcdefgh", k=n))
    p = text(140)
    rows = [(5, text(60) + p + text(rng.randint(0, 50))) for _ in range(11)] + [(2, p + text(20)), (9, text(10) + p), (7, text(300)), (7, text(20)), (None, p), (5, "short")]
    rows += [rows[0], rows[3]]
    order = sorted({r for r in rows if r[0] is not None and len(r[1]) >= 100}, key=lambda r: (r[0], hashlib.md5(r[1].encode()).hexdigest()))
    want = brute_dedup([(k, t) for k, (_, t) in enumerate(order)])
    by_text = {r: want[k] for k, r in enumerate(order)}
    got = sorted((tuple(r) for r in suffix_dedup.report(docs(spark, rows)).collect()), key=repr)
    assert got == sorted(((d, *by_text.get((d, t), (len(t), 0, 0, hashlib.sha256(t.encode()).hexdigest()))) for d, t in rows), key=repr)


def test_suffix_dedup_edges(spark, monkeypatch):
    assert suffix_dedup.report(docs(spark, [])).count() == 0
    assert [tuple(r)[:4] for r in suffix_dedup.report(docs(spark, [(None, "z" * 300)])).collect()] == [(None, 300, 0, 0)]
    kept = suffix_dedup.remove(docs(spark, [(1, "é" * 80), (2, "é" * 80), (3, None)]))
    assert kept.columns == DOC.replace(" bigint", "").replace(" string", "").split(", ")
    assert {r["doc_id"]: r["text"] for r in kept.collect()}[2] == ""
    whole = [a.tolist() for a in suffix_dedup.anchors([("q%d" % i * 3).encode() for i in range(5)] + [bytes(random.Random(1).choices(b"abcd", k=3000))])]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    cut = suffix_dedup.anchors([("q%d" % i * 3).encode() for i in range(5)] + [bytes(random.Random(1).choices(b"abcd", k=3000))])
    strings = lambda d, a, lo, hi, s: {(x, q): (y, z) for x, y, l, h, z in zip(d, a, lo, hi, s) for q in range(l, h + 1)}  # noqa: E731, E741
    assert strings(*[c.tolist() for c in cut]) == strings(*whole)


def test_suffix_dedup_across_parts(spark, monkeypatch):
    """Documents that are anchored in parts lose what they would lose as a whole."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    p = text(400)
    rows = [(1, text(5000)), (2, text(500) + p + text(3000)), (3, text(650) + p + text(2000) + p)]
    cloudpickle.register_pickle_by_value(suffix_dedup)  # so that workers get the small CHUNK
    try:
        got = {r["doc_id"]: tuple(r)[1:] for r in suffix_dedup.report(docs(spark, rows)).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(suffix_dedup)
    assert got == brute_dedup(rows)


def test_loser_tree_never_compares_known_prefixes(monkeypatch):
    rng = random.Random(0)
    runs = [sorted({bytes(rng.choice(b"ab") for _ in range(6)) + bytes(suffix_dedup.KEY - 6) for _ in range(rng.randint(0, 15))}) for _ in range(7)]
    coded = [suffix_dedup.front_code(r) for r in runs]
    assert [suffix_dedup.front_decode(*c) for c in coded] == runs
    out = [(runs[i][p], lcp) for i, p, lcp in suffix_dedup.merge_runs([(r, c[0]) for r, c in zip(runs, coded)])]
    assert [k for k, _ in out] == sorted(k for r in runs for k in r)
    assert all(lcp == suffix_dedup.common_prefix(a, b) for (a, _), (b, lcp) in zip(out, out[1:]))
