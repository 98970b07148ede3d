"""Checks of stems against known structures and null models."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import energies
from . import scan
from .sizes import near
from .stems import sequences


def gold_stems(pairs: DataFrame, gap: int = 3) -> DataFrame:
    """pairs (line, l, r; 1-based) in file order to stems: a new one begins where both indices jump by more than gap.

    Lines lie in ranges; the pair before a range and the number of jumps before it are carried into it (:mod:`scan`), so no task sees all lines.
    """
    rows = scan.former(scan.ranged(pairs.select("line", "l", "r"), ["line"]), ["line"], "_former", F.struct("l", "r"))
    jump = (F.abs(F.col("l") - F.col("_former.l")) > gap) & (F.abs(F.col("r") - F.col("_former.r")) > gap)
    placed = scan.running(rows.withColumn("_jump", F.coalesce(jump, F.lit(False)).cast("bigint")), [], ["line"], {"stem_ix": F.col("_jump")})
    return placed.groupBy("stem_ix").agg((F.min_by("l", "line") - 1).alias("l_start"), (F.max_by("l", "line") - 1).alias("l_stop"), (F.min("r") - 1).alias("r_start"), (F.max("r") - 1).alias("r_stop"))


def stem_gene(stems: DataFrame, genes: DataFrame) -> DataFrame:
    """stems (stem_ix, region, l_start, r_start) with the first gene, in table order, that holds both starts."""
    g = genes.select(F.col("region").alias("_r"), F.col("gene").alias("_g"), "g_start", "g_stop", "gene_ord")
    hit = (F.col("region") == F.col("_r")) & F.col("l_start").between(F.col("g_start"), F.col("g_stop")) & F.col("r_start").between(F.col("g_start"), F.col("g_stop"))
    best = stems.join(near(g), hit, "left").groupBy("stem_ix").agg(F.min_by("_g", "gene_ord").alias("gene"))
    return stems.join(best, "stem_ix")


def _last_start() -> Column:
    """The last place to which a stem may be shifted: as in the field's own null model the base after it is still in the gene."""
    return F.col("g_stop") - (F.col("r_stop") - F.col("l_start") + 1)


def shift_candidates(stems: DataFrame) -> DataFrame:
    """All other starts in the gene (g_start, g_stop) to which a stem could be shifted: stem_ix, start."""
    own = F.explode(F.array_except(F.sequence("g_start", _last_start()), F.array("l_start")))
    return stems.where(_last_start() >= F.col("g_start")).select("stem_ix", own.alias("start"))


def shift_starts(stems: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Up to n of the starts of :func:`shift_candidates` for each stem, drawn without listing them: stem_ix, start.

    A keyed permutation of the range of starts (its own left out) is asked for its first n places, so a stem makes n rows at most, however long its gene is.
    """

    def run(frames):
        for f in frames:
            out = []
            for ix, first, last, own in f.itertuples(index=False):
                skips = first <= own <= last
                size = last - first + 1 - skips
                for k in range(min(n, max(0, size))):
                    at = first + permuted(k, size, (seed, ix))
                    out.append((ix, at + (skips and at >= own)))
            yield pd.DataFrame(out, columns=["stem_ix", "start"])

    asked = stems.select(F.col("stem_ix").cast("bigint").alias("stem_ix"), F.col("g_start").cast("bigint").alias("a"), _last_start().cast("bigint").alias("b"), F.col("l_start").cast("bigint").alias("c"))
    return asked.mapInPandas(run, "stem_ix bigint, start bigint")


def permuted(k: int, size: int, key: tuple[int, int]) -> int:
    """Where a keyed permutation of range(size) puts k: four rounds that mix the halves of the next even number of bits, gone through again until the range is met."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    while True:
        left, right = k >> half, k & ((1 << half) - 1)
        for turn in range(4):
            mixed = int.from_bytes(hashlib.blake2b(f"{key[0]},{key[1]},{turn},{right}".encode(), digest_size=8).digest(), "little")
            left, right = right, left ^ (mixed & ((1 << half) - 1))
        k = left << half | right
        if k < size:
            return k


def _dealt(stems: DataFrame, *by: str) -> DataFrame:
    """stems dealt evenly to all tasks: they are few bytes but much work, so partitions merged by size would leave most tasks idle. by are no columns by which a join has dealt them, or that stays."""
    return stems.repartition(int(stems.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def shifted(stems: DataFrame, regions: DataFrame, n: int, seed: int = 0, kernel: str = "duplex") -> DataFrame:
    """Energies of up to n random shifts of each stem (stem_ix, region, ends, g_start, g_stop), greatest first: stem_ix, rank, energy. A stem that fills its gene has none."""
    by = F.col("start") - F.col("l_start")
    moved = shift_starts(_dealt(stems, "stem_ix"), n, seed).join(stems, "stem_ix").select("stem_ix", "region", *[(F.col(c) + by).alias(c) for c in ("l_start", "l_stop", "r_start", "r_stop")])
    return _ranked(_dealt(sequences(moved, regions).select("stem_ix", "l_seq", "r_seq"), "stem_ix", "l_seq", "r_seq"), kernel)


#: Uniform numbers for some rows of a batch: (rows, draw, arm, width) -> an array of that many rows and columns.
Uniform = Callable[[np.ndarray, int, int, int], np.ndarray]


def _eulerian(codes: np.ndarray, lengths: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Random Eulerian paths (Altschul and Erickson) of many texts, rows of letters (0 to some k) padded on the right: the paths, and whether each is one.

    Each neighbouring pair has a uniform number. A letter's pairs are used in order of them, so the last is a random exit and those before it are in random order; it is a path
    if the exits of all letters lead to the text's last one, and has to be drawn again if not.
    """
    size, width = codes.shape
    k, rows = int(codes.max(initial=0)) + 1, np.arange(size)
    last = codes[rows, np.maximum(lengths - 1, 0)]
    used = np.arange(width - 1) < lengths[:, None] - 1
    order = np.argsort(np.where(used, codes[:, :-1] + u / 2, np.inf), axis=1)
    to = np.take_along_axis(codes[:, 1:], order, 1)
    n = np.stack([(used & (codes[:, :-1] == a)).sum(1) for a in range(k)], 1)
    ends = n.cumsum(1)
    exits = np.where(n > 0, np.take_along_axis(to, np.maximum(ends - 1, 0), 1), last[:, None])
    exits[rows, last] = last
    for _ in range(k.bit_length()):
        exits = np.take_along_axis(exits, exits, 1)
    out, at, next_ = codes.copy(), codes[:, 0], ends - n
    for i in range(1, width):
        place = next_[rows, at]
        next_[rows, at] += 1
        at = to[rows, np.minimum(place, width - 2)]
        out[:, i] = at
    return out, (exits == last[:, None]).all(1)


class Shuffles:
    """Random strings with the same counts of neighbouring pairs as each of some texts."""

    def __init__(self, texts: list[str], uniform: Uniform, arm: int = 0) -> None:
        self.lengths = np.array([len(t) for t in texts], np.int64)
        width = max(2, int(self.lengths.max(initial=0)))
        points = np.frombuffer("".join(t.ljust(width) for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        letters, codes = np.unique(points, return_inverse=True)
        self.letters, self.codes, self.uniform, self.arm = letters, codes.reshape(len(texts), width), uniform, arm

    def draw(self, rows: np.ndarray, turn: int) -> list[str]:
        """A shuffle of the texts of some rows; turns are independent of each other, and so are tries that end in no path."""
        drawn, left, tries = self.codes[rows], np.arange(len(rows)), 0
        while len(left):
            u = self.uniform(rows[left], turn << 32 | tries, self.arm, drawn.shape[1] - 1)
            out, whole = _eulerian(self.codes[rows[left]], self.lengths[rows[left]], u)
            drawn[left[whole]] = out[whole]
            left, tries = left[~whole], tries + 1
        text, width = self.letters[drawn].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), drawn.shape[1]
        return [text[i * width : i * width + n] for i, n in enumerate(self.lengths[rows].tolist())]


def dinucleotide_shuffle(text: str, rng: np.random.Generator) -> str:
    """A random string with the same counts of neighbouring pairs."""
    return Shuffles([text], lambda rows, draw, arm, width: rng.random((len(rows), width))).draw(np.zeros(1, np.int64), 0)[0]


#: Draws for each shuffle that is asked for, after which a stem has no more that differ.
DRAWS = 20
#: Letters that are shuffled at once.
SHUFFLED = 1 << 17


def distinct_shuffles_of(left: list[str], right: list[str], n: int, uniform: Uniform) -> list[list[tuple[str, str]]]:
    """For many pairs of arms: the arms as they are and shuffles of them that differ, up to n in all, in the order in which they are drawn."""
    seen = [{arms: None} for arms in zip(left, right)]
    both, open_ = [Shuffles(arms, uniform, k) for k, arms in enumerate((left, right))], np.arange(len(seen))
    for turn in range(DRAWS * n):
        open_ = np.array([k for k in open_.tolist() if len(seen[k]) < n], np.int64)
        if not len(open_):
            break
        for k, *arms in zip(open_.tolist(), *(s.draw(open_, turn) for s in both)):
            seen[k].setdefault(tuple(arms))
    return [list(x)[:n] for x in seen]


def distinct_shuffles(left: str, right: str, n: int, rng: np.random.Generator) -> list[tuple[str, str]]:
    """:func:`distinct_shuffles_of` for one pair of arms."""
    return distinct_shuffles_of([left], [right], n, lambda rows, draw, arm, width: rng.random((len(rows), width)))[0]


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64 bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed(ids: np.ndarray, seed: int) -> Uniform:
    """Uniform numbers that depend on the row's id, not on the batch in which it comes."""
    key = _mixed(_mixed(np.array([seed], np.int64).view(np.uint64) + _STEP) ^ _mixed(ids.astype(np.int64).view(np.uint64)))

    def uniform(rows: np.ndarray, draw: int, arm: int, width: int) -> np.ndarray:
        drawn = _mixed(key[rows] + np.array([2 * draw + arm + 1], np.uint64) * _STEP)
        return (_mixed(drawn[:, None] + np.arange(1, width + 1, dtype=np.uint64) * _STEP) >> np.uint64(11)) * 2.0**-53

    return uniform


def shuffled(stems: DataFrame, n: int, seed: int = 0, kernel: str = "duplex") -> DataFrame:
    """Energies of each stem's arms (l_seq, r_seq) and of dinucleotide shuffles of them that differ, up to n in all, greatest first: stem_ix, rank, energy."""

    def run(frames):
        for f in frames:
            longest = max(1, *(int(f[c].str.len().max()) for c in ("l_seq", "r_seq"))) if len(f) else 1
            held = max(1, SHUFFLED // longest)
            for k in range(0, len(f), held):
                g = f.iloc[k : k + held]
                drawn = distinct_shuffles_of(g["l_seq"].tolist(), g["r_seq"].tolist(), n, keyed(g["stem_ix"].to_numpy(), seed))
                rows = [(ix, a, b) for ix, pairs in zip(g["stem_ix"], drawn) for a, b in pairs]
                yield pd.DataFrame(rows, columns=["stem_ix", "l_seq", "r_seq"])

    return _ranked(_dealt(stems.select("stem_ix", "l_seq", "r_seq"), "stem_ix", "l_seq").mapInPandas(run, "stem_ix bigint, l_seq string, r_seq string"), kernel)


def _ranked(arms: DataFrame, kernel: str) -> DataFrame:
    def run(frames):
        for f in frames:
            yield pd.DataFrame({"stem_ix": f["stem_ix"], "energy": energies(kernel, f["l_seq"].tolist(), f["r_seq"].tolist())})

    folded = arms.select(F.col("stem_ix").cast("bigint").alias("stem_ix"), "l_seq", "r_seq").mapInPandas(run, "stem_ix bigint, energy double")
    return folded.select("stem_ix", F.row_number().over(Window.partitionBy("stem_ix").orderBy(F.desc("energy"))).alias("rank"), "energy")
