"""Duplex groups: filter, statistics, colours and the check for reads that don't overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = ["l_gene", "r_gene"]
KEY = [*PAIR, "dg"]
_ENDS = ("l_start", "l_stop", "r_start", "r_stop")


def valid_groups(members: DataFrame) -> DataFrame:
    """members (reads with dg) of the groups that have two reads or more, with two distinct sequences or more."""
    sequence = F.concat("l_seq", "r_seq")
    kept = members.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_distinct(sequence).alias("s")).where("n > 1 and s > 1").select(*KEY)
    return members.join(kept, KEY, "left_semi")


def medians(members: DataFrame) -> DataFrame:
    """Per group: truncated medians of the four ends, the number of reads and the extent."""
    return members.groupBy(*KEY).agg(*[F.median(c).cast("bigint").alias(c) for c in _ENDS], F.count("*").alias("num_reads"), F.min("l_start").alias("ext_min"), F.max("r_stop").alias("ext_max"))


def coverage(groups: DataFrame, members: DataFrame) -> DataFrame:
    """groups with n_l and n_r, the pair's reads that overlap the group's left and right median arm, and coverage = num_reads / sqrt(n_l n_r).

    Those are the reads that start by the arm's end, less those that stop before its start. Both numbers are running sums over the pair's distinct positions,
    to which reads are added up before the shuffle, so no pair of group and read is ever formed.
    """
    ends = F.array(*[F.struct(F.lit(f"{s}_{e}").alias("series"), (F.col(f"{s}_{e}") + int(e == "stop")).alias("x")) for s in "lr" for e in ("start", "stop")])
    counted = members.select(*PAIR, F.explode(ends).alias("p")).groupBy(*PAIR, "p.series", "p.x").agg(F.count("*").alias("n"))
    counted = counted.select(*PAIR, "series", "x", "n", F.lit(0).alias("asks"), F.lit(None).cast(groups.schema["dg"].dataType).alias("dg"))
    asked = F.array(*[F.struct(F.lit(f"{s}_{e}").alias("series"), F.col(f"{s}_{o}").alias("x")) for s in "lr" for e, o in (("start", "stop"), ("stop", "start"))])
    asked = groups.select(*PAIR, "dg", F.explode(asked).alias("p")).select(*PAIR, "p.series", "p.x", F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("asks"), "dg")
    upto = Window.partitionBy(*PAIR, "series").orderBy("x", "asks").rowsBetween(Window.unboundedPreceding, 0)
    sums = counted.unionByName(asked).withColumn("upto", F.sum("n").over(upto)).where("asks = 1")
    met = [F.sum(F.when(F.col("series") == f"{s}_start", F.col("upto")).when(F.col("series") == f"{s}_stop", -F.col("upto")).otherwise(0)).alias(f"n_{s}") for s in "lr"]
    counted = groups.join(sums.groupBy(*KEY).agg(*met), KEY)
    return counted.withColumn("coverage", F.try_divide(F.col("num_reads"), F.sqrt(F.col("n_l") * F.col("n_r"))))


class FirstFit:
    """Colours by first fit: an extent gets the first colour none of whose extents overlaps it by more than a shared end.

    Colours are bits. A binary tree over positions has, for each node, the colours that cover it and those that touch it; an extent is a few nodes, so its blocked colours are a few
    unions, and the first free one is the lowest bit that is missing. Nodes exist where extents lie; the tree grows upwards with the positions.
    """

    def __init__(self) -> None:
        self.cover: list[dict[int, int]] = []
        self.touch: list[dict[int, int]] = []
        self.used = 0

    def _grow(self, levels: int) -> None:
        while len(self.cover) < levels:
            below = self.touch[-1] if self.touch else {}
            up: dict[int, int] = {}
            for node, colours in below.items():
                up[node >> 1] = up.get(node >> 1, 0) | colours
            self.cover.append({})
            self.touch.append(up)

    def place(self, lo: int, hi: int) -> int:
        """The colour of an extent, which is then held by it."""
        if hi <= lo:  # a point overlaps nothing
            return 0
        self._grow(max(abs(lo), abs(hi)).bit_length() + 1)
        cover, touch, blocked, nodes = self.cover, self.touch, 0, []
        a, b, level = lo, hi, 0
        while a < b:
            if a & 1:
                nodes.append((level, a))
                a += 1
            if b & 1:
                b -= 1
                nodes.append((level, b))
            a, b, level = a >> 1, b >> 1, level + 1
        for level, node in nodes:
            blocked |= touch[level].get(node, 0)
        first, last = lo, hi - 1
        for level in range(len(cover)):
            blocked |= cover[level].get(first, 0) | cover[level].get(last, 0)
            first, last = first >> 1, last >> 1
        colour = ~blocked & (blocked + 1)
        for level, node in nodes:
            cover[level][node] = cover[level].get(node, 0) | colour
            touch[level][node] = touch[level].get(node, 0) | colour
        first, last = lo, hi - 1
        for level in range(len(touch)):
            if (held := touch[level].get(first, 0)) & colour == 0:
                touch[level][first] = held | colour
            if (held := touch[level].get(last, 0)) & colour == 0:
                touch[level][last] = held | colour
            first, last = first >> 1, last >> 1
        return colour.bit_length() - 1


def first_fit(extents: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(group, colour) in order of group."""
    held = FirstFit()
    return [(dg, held.place(lo, hi)) for dg, lo, hi in sorted(extents)]


def colours(groups: DataFrame) -> DataFrame:
    """groups with ng. First fit depends on all groups before, so a gene pair's groups (not its reads) pass through one task, sorted and one by one; only colours are held."""

    def run(frames):
        pair, held = None, None
        for f in frames:
            found = []
            for l_gene, r_gene, lo, hi in zip(f["l_gene"], f["r_gene"], f["ext_min"].tolist(), f["ext_max"].tolist()):
                if (l_gene, r_gene) != pair:
                    pair, held = (l_gene, r_gene), FirstFit()
                found.append(held.place(lo, hi))
            yield f[["l_gene", "r_gene", "dg"]].assign(ng=found)

    kind = groups.schema["dg"].dataType.simpleString()
    ordered = groups.select(*KEY, "ext_min", "ext_max").repartition(*PAIR).sortWithinPartitions(*KEY)
    return groups.join(ordered.mapInPandas(run, f"l_gene string, r_gene string, dg {kind}, ng int"), KEY)


def non_overlapping(members: DataFrame) -> DataFrame:
    """Reads that lie strictly beyond, or before, another read of their group on both arms.

    Extremes of a group decide whether it can have such reads at all. In suspicious groups, a read lies beyond another where the least right end among the reads whose left arm
    ends before its own begins is before its right arm; and before another likewise. Both are running extremes in order of position, without a join of reads.
    """
    limits = members.groupBy(*KEY).agg(*[f(c).alias(f"{n}_{c}") for c in _ENDS for f, n in ((F.min, "min"), (F.max, "max"))])
    suspects = limits.where((F.col("max_l_start") > F.col("min_l_stop")) & (F.col("max_r_start") > F.col("min_r_stop"))).select(*KEY)
    held = members.join(suspects, KEY, "left_semi").select(*KEY, "read_id", *_ENDS)

    def event(x: str, asks: int, value: str):
        return F.struct(F.col(x).alias("x"), F.lit(asks).alias("asks"), F.col(value).alias("value"))

    # At one position, questions come before the other reads' ends (and after their starts), so only strictly earlier (later) ones count.
    rows = held.select(*KEY, "read_id", F.explode(F.array(event("l_start", 0, "r_start"), event("l_stop", 1, "r_stop"))).alias("e")).select(*KEY, "read_id", "e.*")
    before = Window.partitionBy(*KEY).orderBy("x", "asks").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*KEY).orderBy(F.desc("x"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    least = F.min(F.when(F.col("asks") == 1, F.col("value"))).over(before)
    most = F.max(F.when(F.col("asks") == 0, F.col("value"))).over(after)
    marked = rows.select(*KEY, "read_id", F.when(F.col("asks") == 0, least < F.col("value")).otherwise(most > F.col("value")).alias("apart"))
    return marked.where("apart").select(*KEY, "read_id").distinct()


def without_failed_pairs(groups: DataFrame, failed_reads: DataFrame) -> DataFrame:
    """groups of gene pairs that have no read that doesn't overlap: such a pair gives no output."""
    return groups.join(failed_reads.select(*PAIR).distinct(), PAIR, "left_anti")
