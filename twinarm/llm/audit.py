"""Interaction of five filters over all orders, by difference arrays over ranks of permutations.

A document is a mask of the filters that it fails. An order of the filters is a permutation, and permutations have lexicographic ranks (their Lehmer codes as numbers). Which step removes a
document depends on a prefix of the order only: filters that it passes, then one that it fails. All orders with that prefix have neighbouring ranks, so each mask and step covers
intervals of ranks. The masks' counts are added at the beginnings of intervals and taken off at their ends, and a running sum over the ranks gives every order's totals.

Rows are judged one by one, equal texts meet by their digests (a hot text only as a join key whose rows Spark may split), and all that follows has at most 32 masks a part.

Defined results: a null text is empty and equal to other empty ones; a null part is the empty string; a row without an id is never equal to an earlier one nor earlier than
others, and has no labels; repeated rows are documents of their own, of which none is the earlier; an id that is labelled several times has every label found; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

FILTERS = "ABCDE"
ORDERS = factorial(len(FILTERS))
_COUNTS = ("docs", "good", "toxic")


def failures(text: Column) -> list[Column]:
    """Conditions A to D of a text that isn't null."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return [F.size(words) < 100, 100 * F.size(F.array_distinct(words)) < 80 * F.size(words), 100 * capitals > 10 * F.length(text), text.rlike(r"[#$%&*|]")]


def _bit(place: int) -> int:
    return 1 << place


def masks(docs: DataFrame, labels: DataFrame, part: str) -> DataFrame:
    """(part, mask, docs, good, toxic): how many documents of a part fail just the filters of mask (bit 0 is A), and how many of those are labelled."""
    text = F.coalesce("text", F.lit(""))
    bits = sum((F.when(c, _bit(i)).otherwise(0) for i, c in enumerate(failures(text))), F.lit(0))
    read = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), bits.alias("bits"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    judged = materialise(read, "judged")
    # A text that stands once has no earlier one, so only the others are joined.
    first = judged.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    met = judged.join(first, "digest", "left").join(known, "doc_id", "left")
    repeated = F.when(F.col("doc_id") > F.col("first"), _bit(len(FILTERS) - 1)).otherwise(0)
    return met.groupBy("part", (F.col("bits") + repeated).alias("mask")).agg(F.count("*").alias("docs"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))


def rank_of(prefix: tuple[int, ...]) -> int:
    """The rank of the first permutation that begins with prefix: its Lehmer digits times factorials."""
    left, rank = list(range(len(FILTERS))), 0
    for i, x in enumerate(prefix):
        rank += left.index(x) * factorial(len(FILTERS) - 1 - i)
        left.remove(x)
    return rank


def removal_intervals() -> list[tuple[int, int, int, int]]:
    """(mask, step, from, to): in the orders of ranks from <= rank < to, a document of mask is removed at step."""
    out, places = [], range(len(FILTERS))
    for mask in range(1, _bit(len(FILTERS))):
        failed = [p for p in places if mask & _bit(p)]
        passed = [p for p in places if not mask & _bit(p)]
        for k in range(len(passed) + 1):
            for head in permutations(passed, k):
                for f in failed:
                    at = rank_of((*head, f))
                    out.append((mask, k + 1, at, at + factorial(len(FILTERS) - 1 - k)))
    return out


def totals(counted: DataFrame) -> DataFrame:
    """counted (part, mask, docs, good, toxic) -> a row for each part, filter_order and step."""
    spark = counted.sparkSession
    intervals = spark.createDataFrame(removal_intervals(), "mask int, step int, lo int, hi int")
    orders = spark.createDataFrame([(r, "".join(FILTERS[i] for i in p)) for r, p in enumerate(permutations(range(len(FILTERS))))], "rank int, filter_order string")
    signed = F.explode(F.array(*[F.struct(F.col(e).alias("rank"), *[(sign * F.col(c)).alias(c) for c in _COUNTS]) for e, sign in (("lo", 1), ("hi", -1))]))
    deltas = counted.join(F.broadcast(intervals), "mask").select("part", "step", signed.alias("d")).select("part", "step", "d.*").where(F.col("rank") < ORDERS)
    parts = counted.groupBy("part").agg(F.sum("docs").alias("total"))
    grid = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")).select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(ORDERS - 1))).alias("rank"))
    zero = grid.select("part", "step", "rank", *[F.lit(0).cast("bigint").alias(c) for c in _COUNTS])
    at_rank = deltas.unionByName(zero).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    upto = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removed = at_rank.select("part", "step", "rank", *[F.sum(c).over(upto).alias(c) for c in _COUNTS])
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(_bit(i)) > 0, F.col("docs")).otherwise(0)).alias(f"fail_{f}") for i, f in enumerate(FILTERS)]
    alone = [F.sum(F.when(F.col("mask") == _bit(i), F.col("docs")).otherwise(0)).alias(f"only_{f}") for i, f in enumerate(FILTERS)]
    whole = counted.groupBy("part").agg(F.sum("docs").alias("total"), *fails, *alone)
    named = removed.join(F.broadcast(orders), "rank").join(whole, "part").withColumn("letter", F.substr("filter_order", "step", F.lit(1)))

    def of_letter(kind: str) -> Column:
        found = F.lit(0).cast("bigint")
        for f in FILTERS:
            found = F.when(F.col("letter") == f, F.col(f"{kind}_{f}")).otherwise(found)
        return found

    by_step = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return named.select(
        "part",
        "filter_order",
        "step",
        (F.col("total") - F.sum("docs").over(by_step)).alias("kept"),
        F.col("docs").alias("removed"),
        (of_letter("fail") - F.col("docs")).alias("redundant"),
        of_letter("only").alias("unique_fails"),
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        F.sum("docs").over(Window.partitionBy("part", "letter")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """For each value of part, all orders of the filters and each step: what is kept and removed, and what the step's filter costs."""
    return totals(materialise(masks(docs, labels, part), "masks"))
