"""Encoding, token files and packing against the library and exact round trips."""

import ctypes
import random
import types
import weakref
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tokenizers

from twinarm.llm import bpe, dac, jaccard, packing

FILES = {n: public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}
DOC = "doc_id bigint, text string, start bigint, part string"


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize("cache", [bpe.CACHE_WORDS, 40])
def test_encoder_equals_library(name, cache, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", cache)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 500)
    rng = random.Random(1)
    alphabet = "ab'stdmrevl  \n\t.,!12ñéÀ²ß½'x-\"中 \r<|>"
    texts = ["".join(rng.choice(alphabet if k % 5 else alphabet.replace("中", "")) for _ in range(rng.randint(0, 60 if k % 50 else 4000))) for k in range(600)]
    texts += ["", None, " ", "\n\n x", "don't we've I'LL 's", "<|endoftext|> a", "a <|endoftext|> b", "x <|ENDOFTEXT|><|endoftext|>", "<unk> [UNK] <|startoftext|>", "word " * 3000, "word " * 200 + "<|endoftext|>" + " word" * 200]
    e = bpe.Encoder(FILES[name])
    library = tokenizers.Tokenizer.from_file(FILES[name])
    ids, counts = e.encode(texts)
    want = [x.ids for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_shard_random_access():
    rng = np.random.default_rng(2)
    ids = np.concatenate([rng.integers(0, 2**k, 700, dtype=np.uint64) for k in (8, 16, 24, 32)]).astype(np.uint32)
    rng.shuffle(ids)
    s = dac.Shard(dac.write_shard([5, None, 7], np.array([1000, 0, len(ids) - 1000]), ids))
    assert s.decode().tolist() == ids.tolist() and s.doc_ids == [5, None, 7] and s.ends.tolist() == [1000, 1000, len(ids)]
    assert all(s.get(i) == ids[i] for i in range(len(ids)))
    with pytest.raises(IndexError):
        s.get(len(ids))
    one = dac.Shard(dac.write_shard([1], np.array([1]), np.array([2], np.uint32)))
    assert one.get(0) == 2 and one.decode().tolist() == [2]


def test_token_file(spark):
    rows = [(3, "third text"), (1, None), (2, ""), (7, "long words " * 20_000), (3, "another third"), (None, "no id")]
    got = [tuple(r) for r in dac.round_trip(spark.createDataFrame([(*r, 9, "clash") for r in rows], DOC), FILES["byte_bpe_50k.json"], 2).orderBy("start").collect()]
    lib = tokenizers.Tokenizer.from_file(FILES["byte_bpe_50k.json"])
    want = {}
    for d, t in rows:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(d, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert [r[0] for r in got] == [None, 1, 2, 3, 3, 7]
    at = 0
    for d, start, n, crc in got:
        assert start == at and (n, crc) in want[d]
        at += n
    assert dac.round_trip(spark.createDataFrame([], DOC), FILES["byte_bpe_50k.json"], 2).count() == 0


def held(found):
    total = {}
    for pattern, copies in found:
        for n, k in pattern.items():
            total[n] = total.get(n, 0) + k * copies
    return total


def check_packing(found, lengths, demand, capacity):
    assert held(found) == dict(zip(lengths.tolist(), demand.tolist()))
    assert all(sum(n * k for n, k in p.items()) <= capacity and c > 0 for p, c in found)
    return sum(c for _, c in found)


@pytest.mark.parametrize("seed", range(4))
def test_programme_holds_the_demand_near_its_bound(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.choice(np.arange(1, 101), 20, replace=False))
    demand = rng.integers(1, 300, 20)
    found, bound = packing.solve(lengths, demand, 100)
    assert bound <= check_packing(found, lengths, demand, 100) <= 1.05 * bound


def test_programme_of_many_lengths():
    """With short pieces to fill up with, within a thousandth and a sequence of the bound; with lengths over a third only, no worse than known."""
    rng = np.random.default_rng(0)
    lengths, demand = np.arange(1, 2049), np.maximum(1, rng.poisson(6000 / np.arange(1, 2049)))
    found, bound = packing.solve(lengths, demand)
    assert bound <= check_packing(found, lengths, demand, 2048) <= 1.001 * bound + 1
    lengths, demand = np.sort(rng.choice(np.arange(500, 900), 120, replace=False)), rng.integers(1, 2000, 120)
    assert check_packing(packing.solve(lengths, demand)[0], lengths, demand, 2048) <= 1.05 * packing.solve(lengths, demand)[1]


def least(lengths, capacity):
    """The fewest sequences for pieces, tried one by one."""
    def place(k, rooms, best):
        if len(rooms) >= best:
            return best
        if k == len(lengths):
            return len(rooms)
        for i in range(len(rooms)):
            if rooms[i] >= lengths[k] and rooms[i] not in rooms[:i]:
                best = place(k + 1, [*rooms[:i], rooms[i] - lengths[k], *rooms[i + 1 :]], best)
        return place(k + 1, [*rooms, capacity - lengths[k]], best)

    return place(0, [], len(lengths) + 1)


@pytest.mark.parametrize("seed", range(6))
def test_bound_and_packing_against_brute_force(seed):
    rng = np.random.default_rng(seed)
    pieces = sorted(rng.integers(1, 21, 10).tolist(), reverse=True)
    lengths, demand = np.unique(pieces, return_counts=True)
    found, bound = packing.solve(lengths, demand, 20)
    assert bound <= least(pieces, 20) <= check_packing(found, lengths, demand, 20) <= least(pieces, 20) + 1


def test_price_is_the_best_knapsack():
    rng = np.random.default_rng(3)
    lengths, copies, weights = np.array([3, 5, 7, 11]), np.array([4, 6, 1, 2]), rng.random(4)
    p = packing.price(weights, lengths, copies, 30)
    best = max(a * weights[0] + b * weights[1] + c * weights[2] + d * weights[3] for a in range(5) for b in range(7) for c in range(2) for d in range(3) if 3 * a + 5 * b + 7 * c + 11 * d <= 30)
    assert p @ lengths <= 30 and (p <= copies).all() and p @ weights == pytest.approx(best)


def test_fill_is_the_best_subset_sum():
    rng = random.Random(1)
    for _ in range(200):
        lengths, left = np.array(sorted(rng.sample(range(1, 30), 4))), np.array([rng.randint(0, 3) for _ in range(4)])
        room = rng.randint(1, 60)
        sums = {0}
        for n, k in zip(lengths.tolist(), left.tolist()):
            sums = {s + n * i for s in sums for i in range(k + 1)}
        got = packing.fill(room, lengths, left)
        assert sum(int(lengths[i]) * k for i, k in got.items()) == max(s for s in sums if s <= room) and all(k <= left[i] for i, k in got.items())


def test_pack(spark):
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "d"), (4, "long words here " * 2000), (5, "x " * 2047), (6, "x " * 2048)]
    got = packing.pack(spark.createDataFrame([(*r, 9, "clash") for r in rows], DOC), FILES["word_bpe_49k.json"]).toPandas()
    assert sorted(got[got.doc_id == 4].start) == [0, 2048, 4096] and got[got.doc_id == 5].length.tolist() == [2048] and sorted(got[got.doc_id == 6].length) == [1, 2048]
    assert got.length.sum() == 1 + 1 + 4 + 4 + 2 + 6001 + 2048 + 2049
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048
    assert packing.pack(spark.createDataFrame([], DOC), FILES["word_bpe_49k.json"]).count() == 0


def test_other_tasks_free_the_encoder(spark, monkeypatch):
    """A worker keeps the encoder from one packing task to the next, and no longer once a task of another operator runs in it; each task returns freed memory."""

    class Taken:
        """In place of a frame: what mapInArrow is given."""

        select = where = lambda self, *columns: self

        def mapInArrow(self, task, schema):
            return task

    rows = [pa.RecordBatch.from_pydict({"doc_id": [k], "text": [f"some words of text {k}"]}) for k in range(3)]
    trims, path = [], FILES["word_bpe_49k.json"]
    monkeypatch.setattr(packing.TaskContext, "get", lambda: types.SimpleNamespace(partitionId=lambda: 0))
    pack = packing.cut(Taken(), path, 2048, 0)
    assert sum(b.num_rows for b in pack(iter(rows))) == 3
    kept = weakref.ref(bpe.encoder(path))
    assert sum(b.num_rows for b in pack(iter(rows))) == 3 and bpe.encoder(path) is kept()
    monkeypatch.setattr(ctypes, "CDLL", lambda name: types.SimpleNamespace(malloc_trim=trims.append))
    assert sum(b.num_rows for b in jaccard.survey(Taken())(iter(rows))) > 3
    assert kept() is None and len(trims) >= 2
