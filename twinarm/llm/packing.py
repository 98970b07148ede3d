"""Packing documents into training sequences by the configuration linear program.

1. Every text is encoded and cut into pieces of at most ``capacity`` tokens (only longer ones are cut). Tasks number the pieces of each
   length they meet, so ranks need no sort and no task ever holds a length that many documents share.
2. The driver sees the length histogram alone (at most ``capacity`` rows). The configuration LP, fewest sequences (patterns of lengths) that cover every
   length's demand, is solved by multiplicative weights: a length's weight falls exponentially with the covered share of its demand, the pricing step finds
   the pattern of largest weight that fits by a knapsack dynamic program, and the pattern gets a step of the solution. No length is covered beyond its
   demand. Any weights also bound the LP from below (:func:`lower_bound`), so the gap of a result is known.
3. The fractional pattern counts are rounded by error diffusion; a pattern whose pieces have run out keeps those that are left, and its room and what remains in
   the end are filled by exact subset sums over the remaining histogram. Patterns of little weight may be left to the filling; of several such thresholds the
   best rounding counts.
4. A piece finds its place from its length and rank by a search in the table of patterns, whose size depends on the histogram only.

Defined results: a null text is empty, a piece of the end id alone; repeated rows are packed one by one; a null doc_id is kept; an empty table gives
no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import frugal, materialise

CAPACITY = 2048
#: A step covers at most this share of a length's demand; a weight falls by exp(-RATE) from none of it covered to all; lengths that a pricing step looks at.
SHARE, RATE, PRICED = 0.34, 6.0, 96
#: Patterns are rounded if they weigh at most so much less than a full one.
SLACKS = (0.0, 0.002, 0.01, 0.05, 1.0)

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, local bigint"


def cut(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """The pieces of all documents, with the writing task (part) and the piece's number among those of its length there (local)."""

    def pieces(batches):
        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                ids, counts = enc.encode(rows.column("text").to_pylist())
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "local")}
                a = 0
                for key, m in zip(rows.column("doc_id").to_pylist(), counts.tolist()):
                    own = np.append(ids[a : a + m], np.uint32(end_id)).astype("<u4")
                    raw = memoryview(own).cast("B")
                    a += m
                    for k, s in enumerate(range(0, m + 1, capacity)):
                        n = min(capacity, m + 1 - s)
                        for name, value in zip(out, (key, k, s, n, zlib.crc32(raw[4 * s : 4 * (s + n)]), part, int(seen[n]))):
                            out[name].append(value)
                        seen[n] += 1
                yield pa.RecordBatch.from_pydict({"piece": pa.array(out.pop("piece"), pa.int32()), "part": pa.array(out.pop("part"), pa.int32())} | {k: pa.array(v, pa.int64()) for k, v in out.items()}).select(
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
                )

    return docs.select("doc_id", "text").mapInArrow(frugal(pieces, "bpe"), _PIECES)


def price(weights: np.ndarray, lengths: np.ndarray, copies: np.ndarray, capacity: int) -> np.ndarray:
    """How often each length, at most copies times, stands in the pattern of largest total weight that fits: a bounded knapsack by dynamic programming."""
    best, layers = np.zeros(capacity + 1), []
    for i, n in enumerate(lengths.tolist()):
        rest, times = min(int(copies[i]), capacity // n), 1
        while rest > 0:  # 1, 2, 4, ... copies at once, so any number of them can be taken
            times = min(times, rest)
            size = times * n
            gain = best[:-size] + times * weights[i]
            better = gain > best[size:] + 1e-12
            layers.append((i, times, size, better))
            best[size:] = np.where(better, gain, best[size:])
            rest, times = rest - times, 2 * times
    pattern, room = np.zeros(len(lengths), np.int64), capacity
    for i, times, size, better in reversed(layers):
        if room >= size and better[room - size]:
            pattern[i] += times
            room -= size
    return pattern


def lower_bound(weights: np.ndarray, lengths: np.ndarray, demand: np.ndarray, capacity: int) -> float:
    """A bound on the LP: the demand's weight over that of the heaviest pattern."""
    heaviest = price(weights, lengths, demand, capacity) @ weights
    return float(weights @ demand / heaviest) if heaviest else 0.0


def first_weights(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """Weights to start from: the size of a length, or one that counts lengths beyond capacity - k as whole and those below k not at all, whichever bounds the LP best."""
    best, value = lengths / capacity, float(lengths @ demand) / capacity
    for k in lengths[2 * lengths <= capacity].tolist():
        own = np.where(lengths > capacity - k, 1.0, np.where(lengths < k, 0.0, lengths / capacity))
        if own @ demand > value:
            best, value = own, float(own @ demand)
    return best + 1e-3 * lengths / capacity


def relax(lengths: np.ndarray, demand: np.ndarray, capacity: int, seed: int = 0) -> tuple[list[tuple[np.ndarray, np.ndarray, float]], float]:
    """The LP by multiplicative weights: [(places of lengths, times, amount)] that cover the demand exactly, and a lower bound on the optimum."""
    rng, covered, found = np.random.default_rng(seed), np.zeros(len(lengths)), []
    size = first_weights(lengths, demand, capacity)
    bound, checked = lower_bound(size, lengths, demand, capacity), 0.25
    while len(open_ := np.flatnonzero(covered < 1 - 1e-9)):
        # The heaviest lengths a token are the least covered ones; which of many alike are priced is left to chance.
        if len(open_) > PRICED:
            open_ = open_[np.argpartition(covered[open_] + SHARE * rng.random(len(open_)), PRICED)[:PRICED]]
            open_.sort()
        weights = size[open_] * np.exp(RATE * (covered[open_].min() - covered[open_]))
        times = price(weights, lengths[open_], demand[open_], capacity)
        if room := capacity - int(lengths[open_] @ times):
            spare = np.where(covered < 1 - 1e-9, demand, 0)
            spare[open_] -= times
            more = fill(room, lengths, spare)
        else:
            more = {}
        own = dict(zip(open_[times > 0].tolist(), times[times > 0].tolist()))
        for i, k in more.items():
            own[i] = own.get(i, 0) + k
        at, times = np.array(list(own), np.int64), np.array(list(own.values()), np.int64)
        amount = float((np.minimum(SHARE, 1 - covered[at]) * demand[at] / times).min())
        covered[at] += amount * times / demand[at]
        found.append((at, times, amount))
        if covered.min() >= checked - 1e-9 and checked < 1:
            bound = max(bound, lower_bound(size * np.exp(RATE * (covered.min() - covered)), lengths, demand, capacity))
            checked += 0.25
    return found, bound


def fill(room: int, lengths: np.ndarray, left: np.ndarray) -> dict[int, int]:
    """{place: times} of remaining pieces that fill a room best, by subset sums on bits; long pieces first, so that short ones stay for other rooms."""
    reach, steps, limit = 1, [], (1 << (room + 1)) - 1
    for i in range(int(np.searchsorted(lengths, room, "right")) - 1, -1, -1):
        if rest := min(int(left[i]), room // int(lengths[i])):
            steps.append((i, reach))
            times, n = 1, int(lengths[i])
            while rest > 0:
                times = min(times, rest)
                reach |= (reach << (times * n)) & limit
                rest, times = rest - times, 2 * times
            if reach >> room & 1:
                break
    total, out = reach.bit_length() - 1, {}
    for i, before in reversed(steps):
        while not before >> total & 1:
            total -= int(lengths[i])
            out[i] = out.get(i, 0) + 1
    return out


def rounded(found: list[tuple[np.ndarray, np.ndarray, float]], lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Whole patterns and copies that hold the demand exactly."""
    left, out = demand.copy(), []

    def take(at: np.ndarray, times: np.ndarray, wanted: int) -> int:
        copies = min(wanted, int((left[at] // times).min()))
        left[at] -= copies * times
        out.append(({int(n): int(k) for n, k in zip(lengths[at], times)}, copies))
        return copies

    def mend(at: np.ndarray, times: np.ndarray) -> None:
        own = dict(zip(at.tolist(), times.tolist()))
        left[at] -= times
        room = capacity - int(lengths[at] @ times)
        for i, k in fill(room, lengths, left).items() if room else ():
            own[i] = own.get(i, 0) + k
            left[i] -= k
        at, times = np.array(list(own), np.int64), np.array(list(own.values()), np.int64)
        left[at] += times
        take(at, times, int((left[at] // times).min()))

    owed = 0.0
    for at, times, amount in found:
        owed += amount
        if owed >= 1 and (left[at] >= times).all():
            owed -= take(at, times, int(owed + 1e-9))
        elif owed >= 1:
            rest = np.minimum(times, left[at])
            if 2 * int(lengths[at] @ rest) >= int(lengths[at] @ times):
                before = sum(c for _, c in out)
                mend(at[rest > 0], rest[rest > 0])
                owed -= sum(c for _, c in out) - before
    while left.any():
        mend(np.flatnonzero(left)[-1:], np.ones(1, np.int64))
    return out


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Patterns and copies that hold demand[i] pieces of lengths[i] each (lengths ascend), and the least number of sequences that any packing needs."""
    if not len(lengths):
        return [], 0
    found, bound = relax(lengths, demand, capacity)
    weights = first_weights(lengths, demand, capacity)
    roundings = (rounded([f for f in found if weights[f[0]] @ f[1] >= 1 - slack], lengths, demand, capacity) for slack in SLACKS)
    return min(roundings, key=lambda r: sum(c for _, c in r)), max(-(-int(lengths @ demand) // capacity), int(np.ceil(bound - 1e-6)))


def slots(found: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Where the pieces of a length lie, by rank: sorted arrays (length, first rank, first sequence, times a sequence, offset)."""
    rows, used, sequence = [], defaultdict(int), 0
    for pattern, copies in found:
        offset = 0
        for n, times in sorted(pattern.items(), reverse=True):
            rows.append((n, used[n], sequence, times, offset))
            used[n] += times * copies
            offset += times * n
        sequence += copies
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "sequence", "times", "offset"), table.T))


_PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialise(cut(docs, tokenizer, capacity, end_id), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = sorted((r["length"], r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect())  # at most capacity rows
    lengths, demand = np.array([h[0] for h in histogram], np.int64), np.array([h[1] for h in histogram], np.int64)
    where = spark.sparkContext.broadcast(slots(solve(lengths, demand, capacity)[0]))
    before = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))

    def place(batches):
        t = where.value
        # A piece's slot is the last one of its length whose first rank isn't beyond its own.
        first = np.searchsorted(t["length"], np.arange(capacity + 2))
        for batch in batches:
            n, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.empty(len(n), np.int64)
            order = np.argsort(n, kind="stable")
            for group in np.split(order, np.flatnonzero(np.diff(n[order])) + 1) if len(n) else []:
                lo, hi = first[n[group[0]]], first[n[group[0]] + 1]
                at[group] = lo + np.searchsorted(t["rank"][lo:hi], rank[group], side="right") - 1
            within = rank - t["rank"][at]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            sequence = t["sequence"][at] + within // t["times"][at]
            offset = t["offset"][at] + within % t["times"][at] * n
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local"))
    return ranked.mapInArrow(place, _PLACED)
