"""Mixing, the prefix trie and the filter audit against brute force, with hostile rows."""

import hashlib
import random
import zlib
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from twinarm.llm import audit, mixture, trie


def _targets(sizes, weights, repeats=3):
    """Targets by resharing again and again."""
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while True:
        rest = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
        level = rest / sum(weights[i] for i in open_) if open_ else 0
        over = {i for i in open_ if level * weights[i] > repeats * sizes[i]}
        for i in open_:
            target[i] = repeats * sizes[i] if i in over else level * weights[i]
        if not over:
            return target
        open_ -= over


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, u long, pattern string, taken long")


@pytest.mark.parametrize("seed", range(3))
def test_mix_targets_and_words_taken(spark, seed):
    rng = random.Random(seed)
    names = [None, "", "z", "a", "é", "B", "10"]
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 5, 30, 200]))), rng.choices(names, [1, 2, 5, 40, 9, 3, 200])[0], 0, "p", 1) for i in range(1500)]
    rows += [(None, None, "a", 0, "p", 1), (3, "x y z", "a", 0, "p", 1), (3, "x y z", "a", 0, "p", 1), (5000, "word " * 20_000, "10", 0, "p", 1)]
    got = mixture.report(_docs(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixture.report(_docs(spark, rows)).collect()), key=repr)
    size_of = {}
    for _, text, source, *_ in rows:
        size_of[source] = size_of.get(source, 0) + len((text or "").split())
    order = sorted((s for s in size_of if s is not None)) + [None] * (None in size_of)
    target = dict(zip(order, _targets([size_of[s] for s in order], [1 + i % 3 for i in range(len(order))])))
    assert len(got) == len(rows) and sum(r["size"] for r in got) == sum(size_of.values())
    by_size = {v: k for k, v in size_of.items()}
    assert len(by_size) == len(size_of)
    taken = dict.fromkeys(order, 0)
    for r in got:
        source = by_size[r["source_size"]]
        assert abs(r["target"] - target[source]) < 1e-6 * max(1, target[source])
        assert r["taken"] in [k * r["size"] for k in range(4)]
        taken[source] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= max(2, 0.01 * target[s]), (s, taken[s], target[s])


def test_mix_of_no_rows(spark):
    assert mixture.report(_docs(spark, [])).collect() == []
    assert [r["taken"] for r in mixture.report(_docs(spark, [(1, None, None, 0, "p", 1), (2, "", "a", 0, "p", 1)])).collect()] == [0, 0]


def _best_flow(sizes, members, targets, costs):
    """Greatest flow and its least cost, by trying every way to route single words."""
    best = (0, 0)

    def go(i, left, flow, cost):
        nonlocal best
        if i == len(sizes):
            best = max(best, (flow, -cost))
            return

        def route(j, left, taken):
            if j == len(members[i]):
                go(i + 1, left, flow + taken, cost + sum(costs[k // sizes[i]] for k in range(taken)) if sizes[i] else cost)
                return
            s = members[i][j]
            for x in range(min(left[s], sizes[i] * len(costs) - taken) + 1):
                route(j + 1, left[:s] + (left[s] - x,) + left[s + 1 :], taken + x)

        route(0, left, 0)

    go(0, tuple(targets), 0, 0)
    return best


def test_flow_is_greatest_and_cheapest():
    rng = random.Random(5)
    for _ in range(40):
        sizes, targets = [rng.randint(0, 2) for _ in range(3)], [rng.randint(0, 4) for _ in range(2)]
        members = [sorted(rng.sample([0, 1], rng.randint(1, 2))) for _ in sizes]
        flow = mixture.min_cost_flow(sizes, members, targets)
        cost = sum(mixture.COSTS[k // s] for f, s in zip(flow, sizes) for k in range(f))
        assert (sum(flow), -cost) == _best_flow(sizes, members, targets, mixture.COSTS)


def test_overlapping_sources_share_their_documents(spark):
    """A large pattern of two sources serves both; the repeats go where they must."""
    rows = [(i, ["a", "b"], 10) for i in range(300)] + [(1000 + i, ["a"], 10) for i in range(30)] + [(2000 + i, ["c"], 10) for i in range(200)] + [(3000, [], 10), (3001, None, 10), (3002, ["c", "c", None], 10)]
    docs = spark.createDataFrame(rows, "doc_id long, s array<string>, n long")
    mixed, quota = mixture.mix(docs, F.col("s"), F.col("n"))
    target, taken = {r["source"]: r["target"] for r in quota.collect()}, {}
    assert set(target) == {"0a", "0b", "0c", "1"}
    for r in mixed.collect():
        taken[tuple(r["members"])] = taken.get(tuple(r["members"]), 0) + r["taken"]
        assert r["taken"] <= 30
    assert taken[()] == 0
    assert abs(sum(taken.values()) - sum(target.values())) <= 0.02 * sum(target.values())
    assert abs(taken[("0a",)] + taken[("0a", "0b")] - target["0a"] - target["0b"]) <= 30


def _trie(log):
    """The contract's rows in plain Python."""
    turns = {}
    for conv, turn, role, text in sorted((r for r in log if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(conv, []).append((role or "", text or ""))
    members = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built = turns.get(c - int(f"{abs(c) % 100}") * (1 if c >= 0 else -1), [])[:h] + own[h:]
        for d in range(len(built) + 1):
            members.setdefault(tuple(built[:d]), []).append((c, d == len(built)))
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    total = {}
    for p in sorted(members, key=len, reverse=True):
        kids = children.get(p, [])
        saved = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        total[p] = (sum(total[k][0] for k in kids) or 1, saved + sum(total[k][1] for k in kids))
    out = []
    for p, m in members.items():
        ids = ",".join(str(c) for c in sorted(c for c, end in m if end))
        up = min(c for c, _ in members[p[:-1]]) if p else None
        out.append((min(c for c, _ in m), len(p), up, len(m), len(children.get(p, [])), *total[p], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_trie_of_random_logs(spark, seed):
    rng = random.Random(seed)
    log = []
    for c in [*range(0, 12), *range(95, 130), *range(700, 712), -1, -250, 10**12]:
        log += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "ça"]), 0, 0) for t in range(rng.choice([0, 1, 2, 3, 9]))]
        log += [(c, None, "user", "first", 0, 0)] * rng.choice([0, 0, 1, 2])
    log += [(None, 1, "user", "none", 0, 0), (101, 1, "user", "tie", 0, 0), (101, 1, "user", "a tie", 0, 0), (102, 2**62, "user", "late", 0, 0)]
    log += [(6, 5, "user", "same", 0, 0)] * 40 + [(c, t, "user", f"common {t}", 0, 0) for c in range(800, 812) for t in range(10, 60)] + [(900, t, "u", "x" * 30 + str(t % 7), 0, 0) for t in range(1500)]
    rng.shuffle(log)
    df = spark.createDataFrame(log, "conv_id long, turn long, role string, text string, depth long, kid long")
    assert sorted(map(tuple, trie.report(df).collect()), key=repr) == _trie([r[:4] for r in log])


def test_trie_of_no_rows(spark):
    assert trie.report(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


@pytest.mark.parametrize("shape", ["nested", "caterpillar", "random"])
def test_contraction_in_any_shape(spark, shape):
    """Chains along and across paths, and trees in which paths end early; totals equal plain sums."""
    rng = random.Random(1)
    n = 120 if shape == "nested" else 600
    if shape == "nested":  # the deepest member's path, but labels that break every chain
        up = {i: i - 1 for i in range(1, n)}
        path = dict.fromkeys(range(n), 0) | {i: i for i in range(n)}
    elif shape == "caterpillar":
        up = {i: (i - 2 if i % 2 == 0 else i - 1) for i in range(1, n)}
        up[2] = 0
        path = {i: 0 if i % 2 == 0 else i for i in range(n)}
    else:
        up = {i: rng.randrange(i) for i in range(1, n)}
        path = {i: i for i in range(n)}
    depth = {0: 0}
    for i in range(1, n):
        depth[i] = depth[up[i]] + 1
    value = {i: rng.randint(0, 9) for i in range(n)}
    rows = [((i, depth[i]), (up[i], depth[up[i]]) if i else None, path[i], value[i]) for i in range(n)]
    tree = spark.createDataFrame(rows, "id struct<conv_id:long,depth:long>, parent struct<conv_id:long,depth:long>, path long, v long")
    want, kids = dict(value), {i: 0 for i in range(n)}
    for i in range(n - 1, 0, -1):
        want[up[i]] += want[i]
        kids[up[i]] += 1
    leaves = {i: int(not kids[i]) for i in range(n)}
    for i in range(n - 1, 0, -1):
        leaves[up[i]] += leaves[i]
    got = {r["id"]["conv_id"]: (r["v"], r["leaves"], r["n_children"]) for r in trie.subtree_totals(tree, ["v", "leaves"], block=16).collect()}
    assert got == {i: (want[i], leaves[i], kids[i]) for i in range(n)}


def _audit(rows, labels):
    fails, n = [], len(rows)
    for doc_id, text, lang in rows:
        t = text or ""
        w = [x for x in "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ") if x]
        bad = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t)]
        bad.append(any(t == (o[1] or "") and o[0] is not None and doc_id is not None and o[0] < doc_id for o in rows))
        fails.append({f for f, b in zip("ABCDE", bad) if b})
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    good.discard(None)
    toxic.discard(None)
    out = []
    for part in {r[2] or "" for r in rows}:
        own = [i for i in range(n) if (rows[i][2] or "") == part]
        shapley, lines = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            left = set(own)
            for step, f in enumerate(order, 1):
                gone = {i for i in left if f in fails[i]}
                left -= gone
                shapley[f] += len(gone)
                failing = [i for i in own if f in fails[i]]
                lines.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(fails[i] == {f} for i in own), sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone), f))
        out += [(*line[:-1], shapley[line[-1]]) for line in lines]
    return sorted(out)


def test_audit_against_every_order(spark):
    rng = random.Random(3)
    long_ = [" ".join(str(rng.randrange(k)) for _ in range(120)) for k in (10, 10_000, 100_000)]
    texts = [None, "", "short", "A B C", "money $", long_[0], long_[1], long_[2], long_[1] + " |", long_[2].replace("1", "X"), "x\x0by\x0cz" * 60, "é" * 50 + "ABCDE", " ".join(map(str, range(100)))]
    rows = [(i, rng.choice(texts), rng.choice(["en", "fr", None, ""])) for i in range(150)]
    rows += [(None, "short", "en"), (3, "short", "en"), (3, "short", "fr"), (160, "word " * 30_000, "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(None, 1, 1), (2, 1, 0), (2, 0, 1)]
    docs = spark.createDataFrame([(*r, "m", 1) for r in rows], "doc_id long, text string, lang string, mask string, quality int")
    got = audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.select(*columns).collect())) == _audit(rows, labels)
    assert audit.audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []


def test_intervals_cover_each_order_once():
    orders = list(permutations(range(5)))
    held = {m: sorted((lo, hi, s) for k, s, lo, hi in audit.removal_intervals() if k == m) for m in range(1, 32)}
    for r in range(5):
        for failed in combinations(range(5), r + 1):
            at = 0
            for lo, hi, step in held[sum(1 << f for f in failed)]:
                assert lo == at and all(next(i for i, f in enumerate(o, 1) if f in failed) == step for o in orders[lo:hi])
                at = hi
            assert at == 120
