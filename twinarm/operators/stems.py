"""Stem groups: reads of a duplex group with short arms, their envelope, its fold, and base pairs that can be crosslinked."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fold import KERNELS
from .sizes import is_small

PAIR = ["l_gene", "r_gene"]
PERCENTILES = tuple(range(10, 100, 10))


def _length(side: str) -> Column:
    return F.col(f"{side}_stop") - F.col(f"{side}_start") + 1


def cutoffs(members: DataFrame, arms: str = "left2", percentiles: tuple[int, ...] = PERCENTILES) -> DataFrame:
    """(l_gene, r_gene, ptile, cutoff): exact percentiles, interpolated, of a pair's arm lengths. arms "left2" counts each left arm twice, "both" each arm once."""
    each = F.array(_length("l"), _length("l") if arms == "left2" else _length("r"))
    found = members.select(*PAIR, F.explode(each).alias("n")).groupBy(*PAIR).agg(F.percentile("n", F.array(*[F.lit(p / 100) for p in percentiles])).alias("c"))
    return found.select(*PAIR, F.posexplode("c").alias("i", "cutoff")).select(*PAIR, F.element_at(F.array(*map(F.lit, percentiles)), F.col("i") + 1).alias("ptile"), "cutoff")


def short_reads(members: DataFrame, cutoff: DataFrame) -> DataFrame:
    """members by percentile whose arms are both no longer than the cutoff."""
    return members.join(cutoff, PAIR).where((_length("l") <= F.col("cutoff")) & (_length("r") <= F.col("cutoff")))


def envelopes(chosen: DataFrame) -> DataFrame:
    """Per percentile and group: the envelope of both arms, ordered where they cross, and the number of reads."""
    e = chosen.groupBy(*PAIR, "ptile", "cutoff", "dg").agg(F.count("*").alias("num_reads"), F.min("l_start").alias("a"), F.max("l_stop").alias("b"), F.min("r_start").alias("c"), F.max("r_stop").alias("d"))
    return e.select(*PAIR, "ptile", "cutoff", "dg", "num_reads", F.col("a").alias("l_start"), F.least("b", "c").alias("l_stop"), F.greatest("b", "c").alias("r_start"), F.col("d").alias("r_stop"))


def edge_stats(chosen: DataFrame) -> DataFrame:
    """Per percentile and group: least, greatest and population deviation of the four ends, 1-based."""
    stats = []
    for c in ("l_start", "l_stop", "r_start", "r_stop"):
        stats += [(f"{c}_min", F.min(c) + 1), (f"{c}_max", F.max(c) + 1), (f"{c}_std", F.stddev_pop(c))]
    return chosen.groupBy(*PAIR, "ptile", "dg").agg(F.count("*").alias("num_reads"), *[x.alias(n) for n, x in stats])


#: Bases of a piece of a region.
PIECE = 1024


def sequences(envelope: DataFrame, regions: DataFrame) -> DataFrame:
    """envelope (with region) with the sequences of both arms; regions is broadcast if its sequences are small in all.

    Arms are cut from the few pieces of the region in which they lie: a substring of the whole would be counted off from the region's first base.
    """
    pieces = regions.select("region", F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("_pieces"))
    joined = envelope.join(F.broadcast(pieces) if is_small(regions, "seq") else pieces, "region")

    def cut(s: str) -> Column:
        first, last = (F.greatest(F.floor(F.col(f"{s}_{e}") / PIECE), F.lit(0)).cast("int") for e in ("start", "stop"))
        held = F.array_join(F.slice("_pieces", first + 1, F.greatest(last - first + 1, F.lit(0))), "")
        return F.substr(held, (F.col(f"{s}_start") - first * PIECE + 1).cast("int"), F.greatest(_length(s), F.lit(0)).cast("int"))

    return joined.withColumns({f"{s}_seq": cut(s) for s in "lr"}).drop("_pieces")


def folded(envelope: DataFrame, kernel: str = "duplex") -> DataFrame:
    """envelope (with l_seq, r_seq) with structure and energy; equal arms are folded once, and folds of energy 0 are dropped."""

    def run(frames):
        fold = KERNELS[kernel]
        for f in frames:
            out = [fold(a, b) for a, b in zip(f["l_seq"], f["r_seq"])]
            yield pd.DataFrame({"l_seq": f["l_seq"], "r_seq": f["r_seq"], "structure": [x[0] for x in out], "energy": [x[1] for x in out]})

    distinct = envelope.select("l_seq", "r_seq").distinct()
    folds = distinct.mapInPandas(run, "l_seq string, r_seq string, structure string, energy double")
    return envelope.join(folds, ["l_seq", "r_seq"]).where("energy <> 0")


def base_pairs(structure: Column, cut: Column, l_start: Column, r_start: Column) -> tuple[Column, Column]:
    """Positions of opening bases, and of closing bases from the last to the first; pair i joins both at i."""
    chars = F.split(structure, "")
    place = F.transform(chars, lambda c, i: F.struct(c.alias("c"), i.cast("bigint").alias("i")))
    opens = F.transform(F.filter(place, lambda x: x["c"].isin("(", "{")), lambda x: x["i"] + l_start)
    closes = F.transform(F.filter(place, lambda x: x["c"].isin(")", "}")), lambda x: x["i"] + r_start - cut)
    return opens, F.reverse(closes)


def stem_info(stems: DataFrame) -> DataFrame:
    """stems (structure, cut, l_start, r_start, seq of the region, or of a part of it that begins at seq_start) with lefts, rights, n_bp, uu and uc.

    A pair (l, r) counts the bases at l and r-1 unless l is the last left base, and those at l and r+1 unless it is the first; beyond the
    sequence nothing is counted.
    """
    lefts, rights = base_pairs(F.col("structure"), F.col("cut"), F.col("l_start"), F.col("r_start"))
    df = stems.withColumns({"lefts": lefts, "rights": rights})
    pairs = F.slice(F.arrays_zip("lefts", "rights"), 1, F.least(F.size("lefts"), F.size("rights")))
    df = df.withColumn("basepairs", F.transform(pairs, lambda p: F.struct(p["lefts"].alias("l"), p["rights"].alias("r"))))
    lo, hi = F.array_min(F.transform("basepairs", lambda p: p["l"])), F.array_max(F.transform("basepairs", lambda p: p["l"]))

    first = F.col("seq_start") if "seq_start" in stems.columns else F.lit(0)

    def base(at: Column) -> Column:
        at = at - first
        return F.when((at >= 0) & (at < F.length("seq")), F.substr("seq", at.cast("int") + 1, F.lit(1))).otherwise("")

    def met(p: Column) -> Column:
        inner = F.when(p["l"] < hi, F.concat(base(p["l"]), base(p["r"] - 1))).otherwise("")
        outer = F.when(p["l"] > lo, F.concat(base(p["l"]), base(p["r"] + 1))).otherwise("")
        return F.array(inner, outer)

    df = df.withColumn("_met", F.flatten(F.transform("basepairs", met)))
    df = df.withColumns({"n_bp": F.size("lefts").cast("bigint"), "uu": F.size(F.filter("_met", lambda x: x == "TT")).cast("bigint"), "uc": F.size(F.filter("_met", lambda x: x.isin("TC", "CT"))).cast("bigint")})
    return df.drop("_met")
