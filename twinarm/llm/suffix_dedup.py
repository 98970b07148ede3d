"""Removal of repeated byte strings by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (smaller doc_id, or earlier in the same document).

1. Each string of LENGTH bytes has one anchor: the leftmost place with the least hash among its SEED-byte substrings. Equal strings have it at the same
   offset, so only suffixes that start at anchors (about 1 byte in 30) need sorting. The anchors' fingerprints are exchanged first; suffixes whose
   seed occurs once are unique and are dropped, as in sorting by distinguishing prefixes.
2. Each task sorts the remaining suffixes (the LENGTH bytes from the anchor on, then those before it, backwards), keeps the first of equal ones and writes front-coded runs:
   the length of the prefix shared with the suffix before, and the rest. Equal suffixes never leave their task twice, so a passage in a third of all documents gives
   a task at most one suffix for each place in it.
3. Runs meet by seed. A loser tree merges them; it knows the common prefix of each loser with the winner that beat it, so no byte known to be equal is compared again.
4. Among suffixes of one seed the merged order gives the equal ones; for the others the first string at each offset is found and later ones are marked.
5. Where a common passage ends, every document goes on in its own way, so its last seed has as many different suffixes as there are documents. Suffixes of a seed
   that occurs more than HOT times are marked within their run in the same way, and only the first of each string, by 128 bits of hash, meets those of other runs: one seed is spread over all tasks.

Documents of equal text (of at least LENGTH bytes) after the first are removed whole at the start. Defined results: null texts are empty; texts shorter
than LENGTH lose nothing; rows of equal doc_id and equal text are one document and get the same result; rows of equal doc_id and other text are documents of their own, in order of a hash, however many; rows of a null doc_id take no part and keep all; an empty table gives no rows; further columns are ignored by :func:`report`.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scan
from .common import materialise
from .shingles import _MIX, _power, mix

#: Byte values of the second hash of strings.
_CHECK = np.random.default_rng(9).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LENGTH, SEED = 100, 40
#: Places of a string's seed, and the bytes kept before an anchor.
PLACES = LENGTH - SEED + 1
BEFORE = PLACES - 1
#: Bytes hashed at once, suffixes in a run, suffixes that meet in a bucket (about).
CHUNK, RUN, BUCKET = 1 << 22, 200_000, 120_000
#: A seed of more suffixes than this, or than one in HOT_SEEDS of all suffixes, is hot; so there are at most about HOT_SEEDS hot seeds (8 bytes each in the driver and
#: the tasks). A seed that isn't has 30,000 suffixes in a bucket at most up to 7 TB, and 420,000 (some 150 MB) at 100 TB.
HOT, HOT_SEEDS = 30_000, 8_000_000
#: Ids of documents are broadcast up to so many bytes; beyond, they are joined by shuffle.
BROADCAST_BYTES = 1 << 20
#: Texts that are numbered within one doc_id; more make ids of their own (20 bits hold a number and its sign).
MOST = 1 << 19
#: Marks the bytes beyond a document's ends; UTF-8 has none like it.
BEYOND = 0xFF
KEY = LENGTH + BEFORE


def anchors(raws: list[bytes]) -> tuple[np.ndarray, ...]:
    """For the strings of all documents together: (document, anchor, first and last string it stands for, hash of its seed)."""
    out = []
    for first, part, offsets in _parts(raws):
        b = np.frombuffer(b"".join(part), np.uint8)
        n = len(b)
        if n < LENGTH:
            continue
        up, down = _power(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_MIX[b] * up[:n], out=sums[1:])
        seeds = mix((sums[SEED:] - sums[:-SEED]) * down[: n - SEED + 1])
        order = (seeds & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(seeds), dtype=np.uint64)
        least = _sliding_least(order, PLACES)
        ends = np.cumsum([len(r) for r in part])
        doc = np.repeat(np.arange(len(part)), [len(r) for r in part])[: len(least)]
        valid = np.arange(len(least)) + LENGTH <= ends[doc]
        q = np.flatnonzero(valid)
        if not len(q):
            continue
        at = (least[q] & np.uint64(0xFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        lo, hi = q[cut], q[np.append(cut[1:], len(q)) - 1]
        a, d = at[cut], doc[lo]
        shift = np.asarray(offsets)[d] - (ends - [len(r) for r in part])[d]
        out.append((d + first, a + shift, lo + shift, hi + shift, seeds[a]))
    if not out:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
    d, a, lo, hi, seeds = (np.concatenate(c) for c in zip(*out))
    # Parts of a long document give an anchor once each: its strings on both sides of the boundary belong together.
    fresh = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] != a[:-1])]))
    return d[fresh], a[fresh], lo[fresh], hi[np.append(fresh[1:], len(d)) - 1], seeds[fresh]


def _parts(raws: list[bytes]):
    """(first document, byte strings, their offsets): several documents, or a part of a long one that overlaps the next by LENGTH - 1."""
    held, size, first = [], 0, 0
    for k, raw in enumerate(raws):
        if len(raw) > CHUNK:
            if held:
                yield first, held, [0] * len(held)
            for s in range(0, len(raw) - LENGTH + 1, CHUNK):
                yield k, [raw[s : s + CHUNK + LENGTH - 1]], [s]
            held, size, first = [], 0, k + 1
            continue
        held.append(raw)
        size += len(raw)
        if size >= CHUNK // 8:
            yield first, held, [0] * len(held)
            held, size, first = [], 0, k + 1
    if held:
        yield first, held, [0] * len(held)


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The least value of each window, by running minima from both ends of blocks of the window's width."""
    n = len(v) - width + 1
    padded = np.concatenate([v, np.full(-len(v) % width + width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.ascontiguousarray(np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def suffix_key(raw: bytes, a: int) -> bytes:
    """The bytes from an anchor on, then those before it, backwards; padded beyond the document's ends."""
    right = raw[a : a + LENGTH]
    left = raw[max(0, a - BEFORE) : a][::-1]
    return right + b"\xff" * (LENGTH - len(right)) + left + b"\xff" * (BEFORE - len(left))


def common_prefix(x: bytes, y: bytes, known: int = 0) -> int:
    """The common prefix of two keys, of which known bytes are known to be equal."""
    differ = int.from_bytes(x[known:], "big") ^ int.from_bytes(y[known:], "big")
    return len(x) - (differ.bit_length() + 7) // 8


def front_code(keys: list[bytes]) -> tuple[bytes, bytes]:
    """Sorted keys as (lengths of common prefixes with the key before, the rests)."""
    lcps = [0, *map(common_prefix, keys, keys[1:])] if keys else []
    return bytes(lcps), b"".join(k[n:] for k, n in zip(keys, lcps))


def front_decode(lcps: bytes, rests: bytes) -> list[bytes]:
    """The keys back."""
    keys, at, last = [], 0, b""
    for n in lcps:
        last = last[:n] + rests[at : at + KEY - n]
        at += KEY - n
        keys.append(last)
    return keys


def merge_runs(runs: list[tuple[list[bytes], bytes]]):
    """Merge sorted runs (keys, lcps) by a loser tree: yields (run, place in run, common prefix with the key before)."""
    runs = list(runs)
    k = 1
    while k < len(runs):
        k *= 2
    sizes = [len(r[0]) for r in runs] + [0] * (k - len(runs))
    place = [0] * k
    losers = [(-1, 0)] * k  # node -> (run, common prefix with the winner that passed it); run -1: exhausted

    def beats(i: int, n: int, j: int, m: int) -> tuple[int, int, int, int]:
        """(winner, its prefix, loser, its prefix); both prefixes are with the last key that went out."""
        if i < 0:
            return j, m, i, n
        if j < 0 or n > m:
            return i, n, j, m
        if m > n:
            return j, m, i, n
        x, y = runs[i][0][place[i]], runs[j][0][place[j]]
        c = common_prefix(x, y, n)
        if c == KEY:
            return (i, n, j, c) if i < j else (j, m, i, c)
        return (i, n, j, c) if x[c] < y[c] else (j, m, i, c)

    winners = [(i if sizes[i] else -1, 0) for i in range(k)]
    level = k
    while level > 1:
        level //= 2
        up = []
        for x in range(level):
            i, n, j, m = beats(*winners[2 * x], *winners[2 * x + 1])
            losers[level + x] = (j, m)
            up.append((i, n))
        winners = up
    run, lcp = winners[0]
    while run >= 0:
        yield run, place[run], lcp
        at, node = run, (k + run) // 2
        place[at] += 1
        if place[at] < sizes[at]:
            run, lcp = at, runs[at][1][place[at]]
        else:
            run, lcp = -1, 0
        while node:
            run, lcp, loser, m = beats(run, lcp, *losers[node])
            losers[node] = (loser, m)
            node //= 2


# Packed: number of the text under its doc_id (20 bits), anchor (32 bits), distances from the anchor back to its last and first string (6 bits each, at most PLACES - 1).
def _pack(number, a, lo, hi):
    return (np.asarray(number, np.int64) << 44) | (a.astype(np.int64) << 12) | ((a - hi).astype(np.int64) << 6) | (a - lo).astype(np.int64)


def _unpack(w):
    """(number, anchor, distance to the last string, distance to the first one) of packed values."""
    return w >> 44, w >> 12 & 0xFFFFFFFF, w >> 6 & 0x3F, w & 0x3F


def _near(ids: DataFrame, row_bytes: int = 16) -> DataFrame:
    """A table of ids with a broadcast hint where its size allows."""
    return F.broadcast(ids) if ids.count() * row_bytes <= BROADCAST_BYTES else ids


def _slices(batches, rows: int = 512):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _raws(rows) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in rows.column("text").to_pylist()]


#: Kinds of fingerprint rows: to be decided, known to be repeated, and a sign for others that the seed is repeated.
OPEN, KNOWN, SIGN = range(3)


def fingerprints(texts: DataFrame) -> DataFrame:
    """(seed, doc_id, w, kind) for each anchor of texts (doc_id, number, text).

    Seeds that a task meets several times are known to be repeated: their rows are dealt out at random, with two signs for each such seed (w: how many rows they stand for), so a
    passage in a third of all documents doesn't gather in one task.
    """

    def scan(batches):
        for rows in _slices(batches, 2048):
            d, a, lo, hi, seeds = anchors(_raws(rows))
            if not len(d):
                continue
            w = _pack(rows.column("number").to_numpy()[d], a, lo, hi)
            _, place, count = np.unique(seeds, return_inverse=True, return_counts=True)
            known = count[place] > 1
            doc = rows.column("doc_id").to_numpy()[d]
            salted = np.where(known, mix(w.view(np.uint64) ^ (doc.view(np.uint64) << np.uint64(20))), seeds)
            seed, times = np.unique(seeds[known], return_counts=True)
            signs, none = np.repeat(seed, 2), np.zeros(2 * len(seed), np.int64)
            weight = none.copy()
            weight[::2] = times
            kind = np.concatenate([np.where(known, KNOWN, OPEN), np.full(len(signs), SIGN)]).astype(np.int32)
            columns = [np.concatenate(c) for c in ((salted.view(np.int64), signs.view(np.int64)), (doc, none), (w, weight))]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(kind)], names=["seed", "doc_id", "w", "kind"])

    return texts.mapInArrow(scan, "seed bigint, doc_id bigint, w bigint, kind int")


def repeated(batches, hot: int):
    """Of fingerprint rows sorted by seed, (doc_id, w) of the known ones and of those whose neighbour has their seed; and (null, seed) of seeds of more than hot rows. Holds one batch and a row."""
    held, sent, total, last_seed = None, False, 0, None
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [held, batch])
        seed, kind = table.column("seed").to_numpy(), table.column("kind").to_numpy()
        if not len(seed):
            continue
        same = seed[1:] == seed[:-1]
        keep = kind == KNOWN
        keep[1:] |= same
        keep[:-1] |= same
        keep &= kind != SIGN
        last = bool(keep[-1])
        if sent:
            keep[0] = False
        yield from table.filter(pa.array(keep)).select(["doc_id", "w"]).combine_chunks().to_batches()
        # Rows of each seed: its own, and those that its signs stand for. A seed goes on into the next batch.
        new = slice(0 if held is None else 1, None)
        rows = np.where(kind[new] == SIGN, table.column("w").to_numpy()[new], kind[new] == OPEN).astype(np.int64)
        if len(rows):
            own = seed[new]
            start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            sums, seeds = np.add.reduceat(rows, start), own[start]
            if seeds[0] == last_seed:
                sums[0] += total
                before = total > hot
            else:
                before = False
            found = seeds[sums > hot][1 if before and sums[0] > hot else 0 :]
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(found), pa.int64()), pa.array(found)], names=["doc_id", "w"])
            total, last_seed = int(sums[-1]), seeds[-1]
        held, sent = table.slice(len(seed) - 1, 1).combine_chunks().to_batches()[0], last


_RUNS = "bucket int, lcps binary, rests binary, docs binary, packed binary"


#: What a row of runs holds beside the bucket of a run: suffixes equal to an earlier one, ranges of repeated strings, first strings of hot seeds.
LATER, MARKED, FIRST = -1, -2, -3


def _seed_hashes(raw: bytes, at: np.ndarray) -> np.ndarray:
    """The hashes of the seeds at some places of a text, as :func:`anchors` gives them."""
    held = np.frombuffer(raw, np.uint8)[at[:, None] + np.arange(SEED)]
    return mix((_MIX[held] * _power(SEED)[0][:SEED]).sum(1, dtype=np.uint64))


def sorted_runs(held: DataFrame, buckets: int, hot: np.ndarray) -> DataFrame:
    """Front-coded runs by bucket, from (doc_id, text, ws); suffixes equal to an earlier one of the same run; and of hot seeds (sorted hashes) repeated ranges and first strings."""
    shared = held.sparkSession.sparkContext.broadcast(hot)

    def scan(batches):
        hot = shared.value
        first: dict[bytes, tuple[int, int]] = {}
        later: list[tuple[int, int]] = []
        common: list[tuple[bytes, int, int]] = []
        types = (pa.int32(), *[pa.binary()] * 4)

        def rows_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["bucket", "lcps", "rests", "docs", "packed"])

        def flush():
            parts: list[list[bytes]] = [[] for _ in range(buckets)]
            for key in sorted(first):
                parts[zlib.crc32(key[:SEED]) % buckets].append(key)
            rows = [(k, *front_code(keys), *(np.array([first[x][c] for x in keys], "<i8").tobytes() for c in (0, 1))) for k, keys in enumerate(parts) if keys]
            if later:
                pairs = np.array(later, "<i8")
                rows.append((LATER, None, None, pairs[:, 0].tobytes(), pairs[:, 1].tobytes()))
            if common:
                keys = np.frombuffer(b"".join(c[0] for c in common), np.uint8).reshape(-1, KEY)
                docs, ws = (np.array([c[k] for c in common], np.int64) for k in (1, 2))
                doc, number, s, e = _marked(keys, docs, ws)
                rows.append((MARKED, *(x.astype("<i8").tobytes() for x in (s, e, doc, number))))
                rows.append((FIRST, *(x.astype("<i8").tobytes() for x in _firsts(keys, docs, ws))))
            first.clear()
            later.clear()
            common.clear()
            return rows_of(rows) if rows else None

        for rows in _slices(batches):
            for doc, raw, ws in zip(rows.column("doc_id").to_pylist(), _raws(rows), rows.column("ws").to_pylist()):
                if len(hot):
                    at = _unpack(np.array(ws, np.int64))[1]
                    seeds = _seed_hashes(raw, at).view(np.int64)
                    is_hot = (hot[np.minimum(np.searchsorted(hot, seeds), len(hot) - 1)] == seeds).tolist()
                else:
                    is_hot = [False] * len(ws)
                for w, apart in zip(ws, is_hot):
                    key, own = suffix_key(raw, w >> 12 & 0xFFFFFFFF), (doc, w)
                    if apart:
                        common.append((key, *own))
                        continue
                    known = first.setdefault(key, own)
                    if known != own:
                        later.append(max(known, own))
                        if own < known:
                            first[key] = own
                if len(first) >= RUN or len(later) >= 4 * RUN or len(common) >= RUN // 8:
                    yield flush()
        if first or later or common:
            yield flush()

    return held.mapInArrow(scan, _RUNS)


def _strings(keys: np.ndarray, ws: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashes of the strings that suffixes stand for, as (row, distance from the string's start to the anchor, hash, second hash). keys: (n, KEY) bytes."""
    text = np.concatenate([keys[:, LENGTH:][:, ::-1], keys[:, :LENGTH]], 1)  # in reading order, the anchor at BEFORE
    up, down = _power(KEY + 1)
    back = np.arange(PLACES)
    start = BEFORE - back
    _, _, least, most = _unpack(ws)
    row, col = np.nonzero((back >= least[:, None]) & (back <= most[:, None]))
    hashes = []
    for values in (_MIX, _CHECK):
        sums = np.zeros((len(text), KEY + 1), np.uint64)
        np.cumsum(values[text] * up[:KEY], axis=1, out=sums[:, 1:])
        strings = mix((sums[:, start + LENGTH] - sums[:, start]) * down[start]) * np.uint64(2 * PLACES + 1) + back.astype(np.uint64)
        hashes.append(strings[row, col])
    return row, col, *hashes


def _first_of_each(h: np.ndarray, check: np.ndarray) -> np.ndarray:
    """The places of the first of each pair of hashes."""
    order = np.lexsort((check, h))  # stable
    h, check = h[order], check[order]
    return order[np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])])[: len(order)]]


def _firsts(keys: np.ndarray, docs: np.ndarray, ws: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash and second hash by turns, distance, document, packed) of the first of each string around suffixes."""
    order = np.lexsort((_unpack(ws)[1], ws >> 44, docs))
    keys, docs, ws = keys[order], docs[order], ws[order]
    row, col, h, check = _strings(keys, ws)
    at = _first_of_each(h, check)
    return np.stack([h[at], check[at]], 1).view(np.int64).ravel(), col[at], docs[row[at]], ws[row[at]]


def _marked(keys: np.ndarray, docs: np.ndarray, ws: np.ndarray) -> tuple[np.ndarray, ...]:
    """Repeated strings among suffixes of equal seed: (document, number, first byte, last string + 1) of their runs. keys: (n, KEY) bytes."""
    order = np.lexsort((_unpack(ws)[1], ws >> 44, docs))
    keys, docs, ws = keys[order], docs[order], ws[order]
    row, col, h, check = _strings(keys, ws)
    repeated = np.zeros((len(keys), PLACES), bool)
    again = np.ones(len(row), bool)
    again[_first_of_each(h, check)] = False
    repeated[row[again], col[again]] = True
    # Distances fall as starts rise: turn the columns round to get runs of starts.
    flat = np.pad(repeated[:, ::-1], ((0, 0), (1, 1))).astype(np.int8)
    step = np.diff(flat, axis=1)
    r0, c0 = np.nonzero(step == 1)
    _, c1 = np.nonzero(step == -1)
    number, a, _, _ = _unpack(ws[r0])
    return docs[r0], number, a - (PLACES - 1 - c0), a - (PLACES - 1 - c1)


_RANGES = "doc_id bigint, number int, s bigint, e bigint"


def _whole(docs: np.ndarray, ws: np.ndarray) -> tuple[np.ndarray, ...]:
    """All strings of suffixes that equal an earlier one."""
    number, a, least, most = _unpack(ws)
    return docs, number, a - most, a - least + 1


def _ranges(found: list[tuple[np.ndarray, ...]]) -> dict:
    doc, number, s, e = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
    return {"doc_id": pa.array(doc, pa.int64()), "number": pa.array(number.astype(np.int32)), "s": pa.array(s, pa.int64()), "e": pa.array(e - 1 + LENGTH, pa.int64())}


def repeated_ranges(runs: DataFrame) -> DataFrame:
    """(doc_id, number, s, e): byte ranges covered by repeated strings."""

    def merge(table: pa.Table) -> pa.Table:
        lcps = table.column("lcps").to_pylist()
        runs_ = [(front_decode(n, r), n) for n, r in zip(lcps, table.column("rests").to_pylist())]
        docs, packed = ([np.frombuffer(x, "<i8") for x in table.column(c).to_pylist()] for c in ("docs", "packed"))
        found, group, size = [], [], 0
        pending: list[list] = []  # distinct suffixes of seeds that have more than one, as [key, doc, w]

        def close():
            nonlocal group, size
            if len(group) > 1:
                pending.extend(group)
            if len(pending) >= 20_000:
                settle()
            group = []

        def settle():
            if pending:
                keys = np.frombuffer(b"".join(p[0] for p in pending), np.uint8).reshape(-1, KEY)
                found.append(_marked(keys, np.array([p[1] for p in pending], np.int64), np.array([p[2] for p in pending], np.int64)))
                pending.clear()

        later_docs, later_ws = [], []
        for run, at, lcp in merge_runs(runs_):
            doc, w = int(docs[run][at]), int(packed[run][at])
            if group and lcp == KEY:
                last = group[-1]
                if (doc, w) == (last[1], last[2]):  # the same row twice
                    continue
                if (doc, w) < (last[1], last[2]):
                    doc, w, last[1], last[2] = last[1], last[2], doc, w
                later_docs.append(doc)
                later_ws.append(w)
                continue
            if lcp < SEED:
                close()
            group.append([runs_[run][0][at], doc, w])
        close()
        settle()
        if later_docs:
            found.append(_whole(np.array(later_docs, np.int64), np.array(later_ws, np.int64)))
        return pa.table(_ranges(found))

    def spread(batches):
        for batch in batches:
            for bucket, *raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "lcps", "rests", "docs", "packed"))):
                s, e, doc, w = (np.frombuffer(x or b"", "<i8") for x in raw)
                yield pa.RecordBatch.from_pydict(_ranges([(doc, w, s, e) if bucket == MARKED else _whole(doc, w)]))

    def firsts(batches):
        for batch in batches:
            for raw in zip(*(batch.column(c).to_pylist() for c in ("lcps", "rests", "docs", "packed"))):
                hashes, *rest = (np.frombuffer(x, "<i8") for x in raw)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (hashes[::2], hashes[1::2], *rest))], names=["h", "check", "back", "doc_id", "w"])

    merged = runs.where("bucket >= 0").groupBy("bucket").applyInArrow(merge, _RANGES)
    found = merged.union(runs.where(F.col("bucket").isin(LATER, MARKED)).mapInArrow(spread, _RANGES))
    # A hot seed's strings: a run sends each once, and all but the first of all runs are repeated.
    each = runs.where(F.col("bucket") == FIRST).mapInArrow(firsts, "h bigint, check bigint, back bigint, doc_id bigint, w bigint")
    start = F.shiftright("w", 12).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")) - F.col("back")
    number = F.shiftright("w", 44).cast("int")
    order = Window.partitionBy("h", "check").orderBy("doc_id", number, start)  # at most a row of each run
    again = each.withColumn("k", F.row_number().over(order)).where("k > 1")
    return found.union(again.select("doc_id", number.alias("number"), start.alias("s"), (start + LENGTH).alias("e")))


def _joined(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as one."""
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _numbers(same: DataFrame) -> DataFrame | None:
    """(doc_id, md5, number) of the texts of doc_ids that have several, in order of their md5; None where none has."""
    several = same.distinct().groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if several.isEmpty():
        return None
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("md5")) - 1
    return materialise(same.join(several, "doc_id", "left_semi").distinct().withColumn("number", rank), "numbers")


def _split_ids(docs: DataFrame, md5: Column, same: DataFrame) -> tuple[DataFrame, bool]:
    """docs with _own, their doc_id, and whether ids changed. If an id has more than MOST texts, all ids give way to numbers in their order, as many for each as its texts need; otherwise they stay."""
    own = docs.withColumn("_own", F.col("doc_id"))
    texts = materialise(same.distinct(), "texts")
    ids = texts.groupBy("doc_id").agg(F.ceil(F.count("*") / MOST).alias("parts"))
    large = materialise(ids.where("parts > 1"), "large")
    if large.isEmpty():
        return own, False
    keep = partial(materialise, label="ids")
    base = scan.running(scan.ranged(ids, ["doc_id"], keep), [], ["doc_id"], {"upto": F.col("parts")}).select(F.col("doc_id").alias("_id"), (F.col("upto") - F.col("parts")).alias("base"))
    rows = scan.ranged(texts.join(F.broadcast(large) if large.count() < 100_000 else large, "doc_id", "left_semi"), ["doc_id", "md5"], keep)
    part = scan.running(rows, ["doc_id"], ["md5"], {"rank": F.lit(1)}).select(F.col("doc_id").alias("_id"), F.col("md5").alias("_md5"), F.floor((F.col("rank") - 1) / MOST).alias("part"))
    numbered = own.withColumn("_text", md5).join(keep(base), F.col("doc_id") == F.col("_id"), "left").drop("_id").join(keep(part), (F.col("doc_id") == F.col("_id")) & (F.col("_text") == F.col("_md5")), "left")
    return numbered.withColumn("doc_id", F.col("base") + F.coalesce("part", F.lit(0))).drop("_id", "_md5", "_text", "base", "part"), True


def _numbered(rows: DataFrame, md5: Column, numbers: DataFrame | None) -> DataFrame:
    """rows with number: the text's among those of its doc_id, 0 where that has one."""
    if numbers is None:
        return rows.withColumn("number", F.lit(0))
    known = numbers.select(F.col("doc_id").alias("_id"), F.col("md5").alias("_md5"), F.col("number").alias("_number"))
    return rows.join(known, (F.col("doc_id") == F.col("_id")) & (md5 == F.col("_md5")), "left").withColumn("number", F.coalesce("_number", F.lit(0))).drop("_id", "_md5", "_number")


def find(docs: DataFrame, text: Column) -> tuple[DataFrame, DataFrame]:
    """docs with number (-1 for rows that take no part) and _own, their doc_id, and what goes: (doc_id, number, ranges), where a range to -1 means the whole text."""
    size, md5 = F.octet_length(text), F.md5(text.cast("binary"))
    partakes = F.col("doc_id").isNotNull() & (size >= LENGTH)
    same = materialise(docs.where(partakes).select("doc_id", md5.alias("md5"), size.alias("size")), "digests")
    docs, moved = _split_ids(docs, md5, same.select("doc_id", "md5"))
    if moved:
        same = materialise(docs.where(F.col("doc_id").isNotNull() & (size >= LENGTH)).select("doc_id", md5.alias("md5"), size.alias("size")), "digests")
    total = same.agg(F.sum("size")).first()[0] or 0
    numbers = _numbers(same.select("doc_id", "md5"))
    docs = _numbered(docs, md5, numbers).withColumn("number", F.when(partakes, F.col("number")).otherwise(-1))
    # Written, so that the groups' table and the documents meet by plain exchanges, of which a large group's can be split.
    least = materialise(same.groupBy("md5").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1"), "copied")
    copies = _numbered(same.join(least, "md5").where("doc_id > least").select("doc_id", "md5"), F.col("md5"), numbers)
    copies = materialise(copies.select("doc_id", "number").distinct(), "copies")
    rest = docs.where("number >= 0").select("doc_id", "number", text.alias("text")).join(_near(copies), ["doc_id", "number"], "left_anti")
    most = max(HOT, total // (30 * HOT_SEEDS))
    seen = materialise(fingerprints(rest).repartition("seed").sortWithinPartitions("seed").mapInArrow(lambda b: repeated(b, most), "doc_id bigint, w bigint"), "repeated")
    hot = np.sort(seen.where("doc_id is null").select("w").distinct().toArrow().column("w").to_numpy())  # about HOT_SEEDS at most
    listed = seen.where("doc_id is not null").groupBy("doc_id", F.shiftright("w", 44).cast("int").alias("number")).agg(F.collect_list("w").alias("ws"))
    n = seen.where("doc_id is not null").count()
    held = rest.join(listed.hint("shuffle_hash"), ["doc_id", "number"]).select("doc_id", "text", "ws")
    runs = materialise(sorted_runs(held, max(1, -(-n // BUCKET)), hot), "runs")
    ranges = repeated_ranges(runs).groupBy("doc_id", "number").agg(F.collect_set(F.struct("s", "e")).alias("ranges"))

    def join_up(batches):
        for batch in batches:
            merged = [[{"s": s, "e": e} for s, e in _joined([(r["s"], r["e"]) for r in x])] for x in batch.column("ranges").to_pylist()]
            yield batch.set_column(2, batch.schema.field(2), pa.array(merged, batch.schema.field(2).type))

    gone = ranges.mapInArrow(join_up, ranges.schema)
    all_of_it = copies.select("doc_id", "number", F.array(F.struct(F.lit(0).cast("bigint").alias("s"), F.lit(-1).cast("bigint").alias("e"))).alias("ranges"))
    return docs, materialise(gone.union(all_of_it), "gone").hint("shuffle_hash")


_REPORT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _cut(raw: bytes, ranges) -> tuple[bytes, int]:
    """What is left, and the number of removed runs."""
    if not ranges:
        return raw, 0
    if ranges[0]["e"] < 0:
        return b"", 1
    kept, at = [], 0
    for r in ranges:
        kept.append(raw[at : r["s"]])
        at = r["e"]
    return b"".join([*kept, raw[at:]]), len(ranges)


def report(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    texts, gone = find(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), F.col("text"))

    def scan_rows(batches):
        for rows in _slices(batches):
            out = []
            for doc, raw, ranges in zip(rows.column("doc_id").to_pylist(), _raws(rows), rows.column("ranges").to_pylist()):
                kept, spans = _cut(raw, ranges)
                out.append((doc, len(raw), len(raw) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (*[pa.int64()] * 4, pa.string()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return texts.join(gone, ["doc_id", "number"], "left").select(F.col("_own").alias("doc_id"), "text", "ranges").mapInArrow(scan_rows, _REPORT)


def remove(docs: DataFrame) -> DataFrame:
    """docs with repeated strings cut out of text; a character of which a byte goes, goes; texts that lose all become empty."""
    columns = docs.columns
    whole = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"))
    kept, gone = find(whole, F.coalesce("text", F.lit("")))
    kept = kept.join(gone, ["doc_id", "number"], "left").select(*[F.col(f"_doc.`{c}`").alias(c) for c in columns], F.col("ranges").alias("_ranges"))
    at = columns.index("text")

    def scan_rows(batches):
        for rows in _slices(batches):
            new = []
            for text, ranges in zip(rows.column("text").to_pylist(), rows.column("_ranges").to_pylist()):
                new.append(text if text is None or not ranges else _cut(text.encode("utf-8", "surrogatepass"), ranges)[0].decode("utf-8", "ignore"))
            yield rows.set_column(at, rows.schema.field(at), pa.array(new, rows.schema.field(at).type)).select(columns)

    return kept.mapInArrow(scan_rows, docs.schema)
