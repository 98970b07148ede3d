"""CIGAR strings as columns: tokens, normalised runs, the gapped shape, and what follows from it for the two arms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operations of a usable gapped alignment, after equal neighbours are merged and both ends padded.
GAPPED = ("S", "M", "N", "M", "S")


def tokens(cigar: Column) -> Column:
    """array<struct<op,len>> of the string as written."""
    ops = F.regexp_extract_all(cigar, F.lit(r"(\d+)(\D)"), 2)
    lens = F.regexp_extract_all(cigar, F.lit(r"(\d+)(\D)"), 1)
    return F.zip_with(ops, lens, lambda o, n: F.struct(o.alias("op"), n.cast("bigint").alias("len")))


def runs(cigar: Column) -> Column:
    """Tokens with equal neighbours merged, and a soft clip of 0 where an end has none; empty for a string without tokens."""

    def merge(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(x["op"].alias("op"), (last["len"] + x["len"]).alias("len"))
        return F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["op"] == x["op"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    merged = F.aggregate(tokens(cigar), F.array().cast("array<struct<op:string,len:bigint>>"), merge)
    none = F.array().cast("array<struct<op:string,len:bigint>>")
    clip = F.array(F.struct(F.lit("S").alias("op"), F.lit(0).cast("bigint").alias("len")))
    front = F.when(F.get(merged, F.lit(0))["op"] == "S", none).otherwise(clip)
    back = F.when(F.try_element_at(merged, F.lit(-1))["op"] == "S", none).otherwise(clip)
    return F.when(F.size(merged) > 0, F.concat(front, merged, back)).otherwise(none)


def shape(run: Column) -> Column:
    """The operations of runs as a string."""
    return F.array_join(F.transform(run, lambda x: x["op"]), "")


def is_gapped(cigar: Column) -> Column:
    """Whether the runs are exactly clip, match, gap, match, clip. A regular expression, so it filters before anything is parsed."""
    return cigar.rlike(r"^(\d+S)*(\d+M)+(\d+N)+(\d+M)+(\d+S)*$")


def length(run: Column, k: int) -> Column:
    """Length of the k-th run."""
    return F.get(run, F.lit(k))["len"]
