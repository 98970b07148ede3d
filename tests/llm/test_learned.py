"""Toxicity, quality and personal data: held-out accuracy, brute force and hostile rows."""

import itertools
import math
import os
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinarm.llm import common, pii, quality, toxicity

DOC = "doc_id bigint, text string, lang string, source string, score string, p string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], DOC)


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(1)
    plain = "the of and to in is that it was for on with are this here there every morning river stone light house".split()
    bad = ["idiot", "stupid", "trash", "moron"]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 40))]
        y = i % 4 == 0
        if y:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), "en", "s"))
        labels.append((i, int(y), 1))
    labels += [(1, None, 1), (None, 1, 1), (5000, 1, 1)]
    d, y = docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int, quality int")
    return d, y, toxicity.fit(d, y)


def test_toxicity_on_held_out_rows(toxic):
    d, y, m = toxic
    got = toxicity.score(d, m).join(y, "doc_id").where("held_out").collect()
    assert len(got) > 100 and all(r["predicted"] == r["toxic"] for r in got if r["toxic"] is not None)


@pytest.mark.parametrize("word", ["1d10t", "st*pid", "$tupid", "m0r0n", "i.d.i.o.t", "i d i o t", "tr@sh", "stuuuupid", "s-t-u-p-i-d", "ＩＤＩＯＴ", "id​iot", "mоrоn", "(idiot)", "STUPID!!"])
def test_deobfuscation(toxic, word):
    m = toxic[2]
    assert m.score(*m.signals(f"the {word} of the river", {})) >= toxicity.THRESHOLD


def test_clean_and_hostile_texts(spark, toxic):
    m = toxic[2]
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (None, "the river", "en", "s"), (3, "the river 1999 1.2.3 a b c d e", "en", "s"), (4, "light " * 50_000, "en", "s"), (5, "x" * 20_000, "en", "s"), (6, "### $$$ @@@ !!! ***", "en", "s"), (6, "### $$$ @@@ !!! ***", "en", "s"), (7, "you idiot", "en", "s")]
    got = [(r["doc_id"], r["predicted"]) for r in toxicity.score(docs(spark, rows), m).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (2, 0), (None, 0), (3, 0), (4, 0), (5, 0), (6, 0), (6, 0), (7, 1)], key=str)
    kept = toxicity.keep_clean(docs(spark, rows), m)
    assert kept.columns == docs(spark, rows).columns and kept.count() == 8
    assert toxicity.score(docs(spark, []), m).count() == 0
    blank = toxicity.fit(docs(spark, rows), spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert [r["score"] < 1e-6 for r in toxicity.score(docs(spark, rows), blank).collect()] == [True] * 9


def test_character_model_counts_every_text(spark, monkeypatch):
    """Labelled or not, in the sample or not: the same as letter by letter over all texts."""
    rows = [(i, t) for i, t in enumerate(["the idiot", "the river", "(żółw) ßüß ßüß", "x \U0001f600 -- a\ta", "", None] * 4)] + [(90, "unlabelled zqj zqj, " * 50)]
    d = docs(spark, [(*r, "en", "s") for r in rows])
    y = spark.createDataFrame([(i, int(i % 6 == 0), 1) for i in range(24)], "doc_id bigint, toxic int, quality int")
    want = np.zeros((toxicity.SIZE,) * 3)
    for _, t in rows:
        for w in filter(None, (toxicity.trim(x) for x in toxicity.normalise(t or "").split())):
            c = [0, 0, *(toxicity.SYMBOLS.get(x, toxicity.OTHER) for x in w), 0]
            for a, b, z in zip(c, c[1:], c[2:]):
                want[a, b, z] += 1
    assert np.allclose(toxicity.fit(d, y, 8).chars, toxicity.language_model(want))
    counts, words = [np.zeros(toxicity.SIZE**3, np.int64) for _ in range(2)], {"aé": 3, "b": 1, "zażółć": 2}
    toxicity.trigram_counts(words, counts[0])
    monkeypatch.setattr(toxicity, "COUNTED_LETTERS", 1)
    toxicity.trigram_counts(words, counts[1])
    assert (counts[0] == counts[1]).all() and counts[0].sum() == 3 * 3 + 2 + 2 * 7


def path_score(symbols, model):
    s = [0, 0, *(toxicity.SYMBOLS.get(ch, toxicity.OTHER) for ch in symbols), 0]
    return sum(model[a, b, z] for a, b, z in zip(s, s[1:], s[2:]))


@pytest.mark.parametrize("token", ["1d10t", "7r4sh", "m0ron", "stup1d", "s-t.u", "a*b#c", "xxxx1", "$$a!!", "(a00*)"])
def test_decoding_finds_the_best_path(toxic, token):
    m = toxic[2].chars
    options = [*toxicity.lattice(token), [(" ", 0.0)]]
    best = max(((path_score("".join(o[0] for o in p[:-1]), m) - sum(o[1] for o in p), "".join(o[0] for o in p)) for p in itertools.product(*options)), key=lambda x: x[0])
    start = {(0, 0): (0.0, "")}
    for beam in (toxicity._sparse(options, m, start), toxicity._dense(options, m, start, True), toxicity._dense(options, m, start, False)):
        end = max(beam, key=beam.get)
        text = beam[end][1]
        cost = best[0] if text == best[1] else max(path_score("".join(o[0] for o in p[:-1]), m) - sum(o[1] for o in p) for p in itertools.product(*options) if "".join(o[0] for o in p) == text)
        assert cost == pytest.approx(best[0]) and end[1] == 0


def random_lattice_token(rng):
    return "".join(rng.choice(["a1", "0", "*", "#", "$$$", "th", "e", "xxx", ".", "!!", "st", " ", "-"]) for _ in range(rng.randint(1, 120)))


def test_stretches_give_the_best_path_of_the_whole_lattice(toxic, monkeypatch):
    """Short stretches, of which each kind follows each other, against one pass over everything."""
    m, rng = toxic[2].chars, random.Random(8)
    tokens = [random_lattice_token(rng) for _ in range(60)] + ["*" * 90, "s1*" * 40]
    whole = []
    for t in tokens:
        beam = toxicity._sparse([*toxicity.lattice(t), [(" ", 0.0)]], m, {(0, 0): (0.0, "")})
        whole.append(max(beam.values())[1].strip())
    for stretch, dense in ((3, 300), (3, 0), (7, 20), (1, 5)):
        monkeypatch.setattr(toxicity, "STRETCH", stretch)
        monkeypatch.setattr(toxicity, "DENSE", dense)
        assert [toxicity.decode(t, m) for t in tokens] == whole


def test_rows_to_fit_on_are_bounded_whatever_their_ids(spark):
    """One labelled id in half of all rows."""
    rows = [(i, f"text number {i} here") for i in range(300)] + [(7, f"another {k} of it") for k in range(2000)] + [(8, "the same again")] * 1000
    d = docs(spark, [(*r, "en", "s") for r in rows])
    y = spark.createDataFrame([(i, i % 2, i % 2) for i in range(300)], "doc_id bigint, toxic int, quality int")
    assert toxicity.training_rows(d, y, 200).count() < 300
    marked = quality.marked_rows(y, 100_000)
    joined = d.join(marked, "doc_id").select("y", "text", F.xxhash64("doc_id", "text").alias("h"))
    assert common.at_most_about(joined, "h", 200).count() < 300 and common.at_most_about(joined, "h", 10**6).count() == joined.distinct().count()


@pytest.mark.parametrize("token", ["a" + "*#" * 10_000, "a1" * 10_000, "a" + "!" * 200_000 + "a", "#" * 300_000 + "a", "a." * 20_000, "a " * 50_000, "q" * 1_000_000])
def test_decoding_of_long_tokens(toxic, token):
    began = time.perf_counter()
    toxic[2].signals(token, {})
    assert time.perf_counter() - began < 20


def test_restored_text(toxic):
    assert toxicity.restore("The  1d10t, of m0r0n and i d i o t!", toxic[2].chars).split()[:4] == ["the", "idiot", "of", "moron"]
    assert toxicity.restore(None, toxic[2].chars) == toxicity.restore("", toxic[2].chars) == ""


def test_quality(spark):
    rng = random.Random(2)
    prose = lambda: " ".join(rng.choice("the of and river stone light house every morning to".split()) + rng.choice(["", "ly", "er", "s"]) for _ in range(60)) + "."
    junk = lambda: rng.choice([lambda: "Click " * 60, lambda: prose().upper().replace(" ", "!! "), lambda: prose().replace(" ", " | ")])()
    rows = [(i, junk() if i % 5 == 0 else prose(), "en", f"s{i % 7}") for i in range(500)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(500)] + [(3, None)], "doc_id bigint, quality int")
    hostile = [(1000, None, None, None), (1001, "", "en", None), (None, "the river", None, "s1"), (1002, "word " * 40_000, "en", "new"), (1003, prose(), "en", "s1"), (1003, prose(), "en", "s1")]
    d = docs(spark, rows + hostile)
    got = quality.score(d, labels, F.col("source"), F.col("lang")).collect()
    assert len(got) == len(rows) + len(hostile) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["held_out"] and r["doc_id"] < 500]
    assert np.mean([r["predicted"] == int(r["doc_id"] % 5 != 0) for r in held]) > 0.95
    assert quality.score(docs(spark, []), labels, F.col("source"), F.col("lang")).count() == 0


def plain_quality(rated, labelled):
    """Posteriors and scores one by one: (host posterior, path posterior, score) of each (doc_id, host, path, p)."""
    logit = lambda p: math.log(min(max(p, 1e-9), 1 - 1e-9)) - math.log(1 - min(max(p, 1e-9), 1 - 1e-9))
    mu = sum(p for *_, p in rated) / len(rated)
    of_host = {h: [p for _, x, _, p in rated if x == h] for _, h, _, _ in rated}
    v = np.mean([(np.mean(x) - mu) ** 2 - mu * (1 - mu) / len(x) for x in of_host.values()])
    k = min(max(mu * (1 - mu) / v - 1 if v > 0 else 1000.0, 1.0), 1000.0)
    out = []
    for d, h, path, p in rated:
        host = (k * mu + sum(of_host[h]) - p) / (k + len(of_host[h]) - 1)
        own = [q for _, x, y, q in rated if (x, y) == (h, path)]
        out.append((d, host, (k * host + sum(own) - p) / (k + len(own) - 1), logit(p)))
    w = 0.0
    points = [(labelled[d], o, logit(path) - logit(mu)) for d, _, path, o in out if d in labelled]
    for _ in range(30):
        p = [1 / (1 + math.exp(-min(max(o + w * x, -30), 30))) for _, o, x in points]
        w -= (sum(x * (q - y) for q, (y, _, x) in zip(p, points)) + 1e-3 * w) / (sum(x * x * q * (1 - q) for q, (_, _, x) in zip(p, points)) + 1e-3)
        w = min(max(w, 0.0), 2.0)
    return [(d, host, path, 1 / (1 + math.exp(-(o + w * (logit(path) - logit(mu)))))) for d, host, path, o in out]


def test_quality_against_a_plain_computation(spark):
    """Many sparse hosts and paths out of URLs, and one host with a third of all rows."""
    rng = random.Random(3)
    good = lambda: " ".join(rng.choice("the of and river stone light house every morning to".split()) for _ in range(rng.randint(5, 60))) + "."
    rows = []
    for i in range(400):
        host = "big.example" if i % 3 == 0 else f"h{rng.randint(0, 120)}.example"
        rows.append((i, good().upper() + "!!! |" * 9 if (hash_ := rng.random()) < (0.7 if host < "h6" else 0.1) else good(), f"https://{host.upper()}:80/p{int(hash_ * 9)}/x?y#z", "en"))
    d = docs(spark, rows)
    labels = spark.createDataFrame([(i, int("!" not in rows[i][1]) if i % 11 else i % 2) for i in range(300)], "doc_id bigint, quality int")
    host, path = quality.host_of(F.col("lang")), quality.path_of(F.col("lang"))
    marked = quality.marked_rows(labels)
    rated = [tuple(r) for r in quality.evidence(d, quality.fit(d, marked), host, path).collect()]
    assert len({r[1] for r in rated}) > 60 and {r[1] for r in rated if r[0] % 3 == 0} == {"big.example"}
    want = sorted(plain_quality(rated, {r["doc_id"]: r["y"] for r in marked.collect()}))
    got = sorted((r["doc_id"], r["host_posterior"], r["path_posterior"], r["score"]) for r in quality.score(d, labels, host, path).collect())
    assert np.allclose(np.array(got), np.array(want), atol=1e-9)


@pytest.fixture(scope="module")
def tagger():
    return pii.Tagger(pii.model())


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in pii._initial(rng).items()}
    x, y = pii.labelled_windows(rng, 4, 12)
    _, g = pii._gradients(p, x, y)
    for k, at in (("x", (0, 3, int(x[3, 1]))), ("w", (1, 5, 2)), ("e", (2, 4)), ("b", (1, 0)), ("t", (0, 3))):
        up, down = ({n: v.copy() for n, v in p.items()} for _ in range(2))
        up[k][at] += 1e-3
        down[k][at] -= 1e-3
        assert g[k][at] == pytest.approx((pii._gradients(up, x, y)[0] - pii._gradients(down, x, y)[0]) / 2e-3, rel=0.02, abs=1e-6)


def test_tagger_on_held_out_windows(tagger):
    x, y = pii.labelled_windows(np.random.default_rng(99), 400, 64)
    found = tagger.decode(x)
    assert (found == y).mean() > 0.97 and ((found == y) & (y > 0)).sum() / (y > 0).sum() > 0.85


def test_skipped_windows_are_empty_ones(tagger, monkeypatch):
    x, _ = pii.labelled_windows(np.random.default_rng(5), 300, 64)
    found = tagger.decode(x)
    monkeypatch.setattr(tagger, "cross", 1e9)
    assert (tagger.decode(x) == found).all()


def plain_spans(text):
    """The base patterns as they are stated."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]


def test_base_spans():
    text = "a.b+c@x-y.co.uk, 1.2.3.4 256.1.1.1 4111 1111-1111 1111, 4111111111111112 +1 (456) 555-2186 +12 34 @x a@b é@é.com x@y.z"
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in pii.base_spans(text)] == [("email", "a.b+c@x-y.co.uk"), ("email", "x@y.z"), ("ip", "1.2.3.4"), ("phone", "+1 (456) 555-2186")]
    assert pii.base_spans("") == [] and pii.base_spans("4111 1111 1111 1111") == [(2, 0, 19)]


def spans_of(tagger, texts):
    base = [pii.base_spans(t) for t in texts]
    return [pii.all_spans(*x) for x in zip(texts, tagger.tag(texts, base), base)]


def long_texts(seed):
    rng = np.random.default_rng(seed)
    return [pii._example(rng, int(n))[0] for n in (5, 200, 256, 257, 700, 5000, 20_000)] + ["", "bob at host dot com " * 60, "a1" * 700, "plain words only " * 300, "x" * 400 + " (at) " + "host-" * 100 + " dot com"]


def test_skipped_windows_would_add_no_span(tagger, monkeypatch):
    """Decoding only near marks gives the spans of decoding everything."""
    texts = [t for seed in range(6) for t in long_texts(seed)]
    got = spans_of(tagger, texts)
    assert sum(len(g) - len(pii.base_spans(t)) for g, t in zip(got, texts)) > 20
    monkeypatch.setattr(pii, "_MARK", re.compile("(?s)."))
    base = [pii.base_spans(t) for t in texts]
    assert got == [pii.all_spans(*x) for x in zip(texts, tagger.tag(texts), base)]


def test_windows_agree_with_a_decode_of_the_whole_text(tagger):
    """Windows see MARGIN characters beyond what they own, so their tags are nearly those of one decode of everything, and so are the spans."""
    same = total = alike = every = 0
    for text in long_texts(11):
        if len(text) > pii.WINDOW:
            whole = tagger.decode(pii.symbols(text)[:, None])[:, 0]
            windows = np.concatenate([tagger.tag([text])[0]])
            near = windows > 0
            same, total = same + int((windows[near] == whole[near]).sum()), total + int(near.sum())
            base = pii.base_spans(text)
            a, b = set(pii.all_spans(text, whole, base)), set(pii.all_spans(text, windows, base))
            alike, every = alike + len(a & b), every + len(a | b)
    assert same > 0.98 * total and alike > 0.95 * every


@pytest.mark.parametrize("text", ["bob (at) host" + "-dot" * 30 + "_!", "a" * 1_000_000, "a (at) " + "b dot " * 150_000, "a at " + "dot " * 250_000, "x@" + "y." * 500_000 + "!", "(at)" * 250_000, "a (at) b" + " (dot) c" * 120_000])
def test_forms_are_checked_in_one_pass(text):
    began = time.perf_counter()
    assert len(list(pii._addresses(text, 0, len(text)))) <= 1 and len(list(pii._addresses(text, len(text) - 20, len(text)))) <= 1
    assert time.perf_counter() - began < 4


def test_forms():
    good = ["bob (at) host.com", "bob@host dot com", "x.y at host dot co dot uk", "bob [AT] host [dot] org", "a @ b.c"]
    assert all(pii._SPELT.fullmatch(t) for t in good) and not any(pii._SPELT.fullmatch(t) for t in ("bob at host", "at home", "bob (at) host", "bob", "", "a (at) b dot ", "bob at host.com"))


@pytest.mark.parametrize("text, want", [("write to bob at mail dot net now", ["bob at mail dot net"]), ("mail jane (at) host.com or jane [at] host [dot] org", ["jane (at) host.com", "jane [at] host [dot] org"]), ("you can reach anna at gmail dot com", ["anna at gmail dot com"]), ("reach me: j.smith (at) company (dot) com please", ["j.smith (at) company (dot) com"]), ("look at this and come at once", []), ("call 555-123-4567 today", ["555-123-4567"])])
def test_added_spans_in_sentences(tagger, text, want):
    assert [text[s:e] for _, s, e in spans_of(tagger, [text])[0]] == want


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(8)
    for k in range(6000):
        alphabet = rng.choice(["a@.-", "a@b.c@", "01.2", "0 1-", "+1 (2).", "ab@.+-_% 0123456789()é\n", "4 1-"])
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        text = text.replace("b", "4111 1111 1111 1111") if k % 9 == 0 else text
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("text", ["0" * 1_000_000 + ".1.1.1", "7" * 1_000_000, "x" * 1_000_000 + "@", "a@" * 500_000, "x@y" * 300_000, "1." * 500_000, "+1" * 500_000, "1 " * 500_000, "a@b.c" * 200_000, "+1(" + "(" * 1_000_000])
def test_base_spans_of_long_texts(text):
    began = time.perf_counter()
    found = pii.base_spans(text)
    assert time.perf_counter() - began < 5
    assert ((1, 0, len(text)) in found) == text.startswith("0")


def test_find_and_redact(spark):
    long = "the river " * 30_000 + "me@host.org end"
    rows = [(1, None, "en", "s"), (2, "", "en", "s"), (3, "mail me@host.org now", "en", "s"), (3, "mail me@host.org now", "en", "s"), (None, "10.0.0.1", "en", "s"), (4, long, "en", "s"), (5, "plain text only", "en", "s"), (6, "\x00\n é 中 😀 me@host.org", "en", "s")]
    got = {(r["doc_id"]): r for r in pii.find(docs(spark, rows)).collect()}
    assert got[1]["base"] == [] and got[5]["spans"] == [] and [(s["kind"], s["start"], s["end"]) for s in got[4]["base"]] == [("email", 300_000, 300_011)]
    assert all(set(map(tuple, r["base"])) <= set(map(tuple, r["spans"])) for r in got.values())
    clean = pii.redact(docs(spark, rows))
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert clean.columns == docs(spark, rows).columns and text[3] == "mail [EMAIL] now" and text[1] is None and text[None] == "[IP]" and text[4].endswith("[EMAIL] end")
    assert pii.find(docs(spark, [])).count() == 0


def test_no_query_reads_a_part_only():
    """No modulo filters, row caps or id subsets in the queries, but for the stated query set and folds."""
    import twinarm.llm.queries as q

    source = open(q.__file__).read()
    assert not re.search(r"\.limit\(|\.sample\(", source) and source.count("% 50 == 0") == 1
    assert os.path.exists(q.__file__)
