"""Mixing overlapping sources to target weights by min-cost flow.

Documents are added up by membership pattern (the set of sources that a document belongs to). Words of a pattern can be taken up to ``REPEATS`` times, each time at a higher
cost; a min-cost flow routes them to the sources' quotas, so repetition is spread as evenly as the memberships allow. A pattern's flow is then turned into documents: whole passes
over all of them, and for the rest a seeded order of documents up to the flow; what is still open is filled with smaller documents, in the same order.

Patterns that share no source don't touch each other, so flows are solved component by component in tasks. Ranks, quotas and cumulative sizes are running sums over ranges of rows, so
neither a large source nor many sources meet in one task or the driver. What has to fit a task is one component's patterns (not its documents).

Defined results: a null text has size 0; a null source is a source of its own and comes last; a null or empty list of sources is a document of no source, of which nothing is taken;
sources named twice count once; documents of size 0 are taken with 0 words; repeated rows are documents of their own; documents without an id stand together in the seeded
order; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scan
from .common import materialise
from .components import connected

#: How often a document can be taken, the cost of a word's first and further times, the weights of sources in order, and the part of its flow by which a pattern may be missed.
REPEATS, COSTS, WEIGHTS, TOLERANCE = 3, (1, 2, 4), (1, 2, 3), 0.0005
SEED = 11


def n_words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.coalesce(F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")), F.lit(0)).cast("bigint")


def _named(source: Column) -> Column:
    """A source as a string that is never null and sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def quotas(patterns: DataFrame) -> DataFrame:
    """patterns (members, size) -> (source, source_size, target): weights in turn, no target above REPEATS times the source's size, what that frees shared by weight.

    The targets are min(REPEATS * size, level * weight) at the level at which they add up to all sizes. Sources reach their limit in order of limit / weight; running sums in
    that order give the level after each, and the first one that doesn't exceed the next source's ratio is it.
    """
    keep = partial(materialise, label="quotas")
    sources = patterns.select(F.explode("members").alias("source"), "size").groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = scan.running(scan.ranged(sources, ["source"], keep), [], ["source"], {"rank": F.lit(1)}).select("source", "source_size", "rank")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.col("rank") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = ranked.select("source", "source_size", weight.alias("weight"), (F.lit(REPEATS) * F.col("source_size")).alias("limit"))
    weighed = weighed.withColumn("ratio", F.col("limit") / F.col("weight"))
    rows = scan.ranged(weighed, ["ratio", "source"], keep)
    summed = scan.running(rows, [], ["ratio", "source"], {"limits": F.col("limit"), "weights": F.col("weight")})
    weights, total = rows.agg(F.sum("weight")).first()[0] or 0, patterns.agg(F.sum("size")).first()[0] or 0
    # Before a source reaches its limit, those of smaller ratios are at theirs.
    left = weights - F.col("weights") + F.col("weight")
    at = (total - F.col("limits") + F.col("limit")) / left
    level = summed.select("ratio", "source", at.alias("at")).where(F.col("at") <= F.col("ratio")).agg(F.min_by("at", F.struct("ratio", "source"))).first()[0]
    open_ = F.lit(float("inf") if level is None else level) * F.col("weight")
    return keep(rows.select("source", "source_size", F.least(F.col("limit").cast("double"), open_).alias("target")))


def min_cost_flow(sizes: list[int], members: list[list[int]], targets: list[int], costs: tuple[int, ...] = COSTS) -> list[int]:
    """Words taken of each pattern: a flow of least cost among the greatest ones from patterns (sizes; each further pass at the next cost) to the targets of their members.

    Successive shortest paths with potentials. Nodes: a start, the patterns, the sources, an end.
    """
    n = len(sizes)
    start, end = n + len(targets), n + len(targets) + 1
    edges: list[list[int]] = [[] for _ in range(end + 1)]
    to, room, cost = [], [], []

    def link(a: int, b: int, most: int, c: int) -> None:
        for x, y, m, k in ((a, b, most, c), (b, a, 0, -c)):
            edges[x].append(len(to))
            to.append(y)
            room.append(m)
            cost.append(k)

    for i, size in enumerate(sizes):
        for c in costs:
            link(start, i, size, c)
        for j in members[i]:
            link(i, n + j, size * len(costs), 0)
    for j, target in enumerate(targets):
        link(n + j, end, target, 0)
    high = [0] * (end + 1)
    while True:
        reached, by = [None] * (end + 1), [-1] * (end + 1)
        reached[start], queue = 0, [(0, start)]
        while queue:
            far, a = heapq.heappop(queue)
            if far > reached[a]:
                continue
            for e in edges[a]:
                if room[e]:
                    next_ = far + cost[e] + high[a] - high[to[e]]
                    if reached[to[e]] is None or next_ < reached[to[e]]:
                        reached[to[e]], by[to[e]] = next_, e
                        heapq.heappush(queue, (next_, to[e]))
        if reached[end] is None:
            return [sum(room[e ^ 1] for e in edges[start] if to[e] == i) for i in range(n)]
        high = [h + (reached[v] if reached[v] is not None else reached[end]) for v, h in enumerate(high)]
        path, at = [], end
        while at != start:
            path.append(by[at])
            at = to[by[at] ^ 1]
        flow = min(room[e] for e in path)
        for e in path:
            room[e] -= flow
            room[e ^ 1] += flow


def _solved(frame: pd.DataFrame) -> pd.DataFrame:
    """One component (members, targets, size of each pattern): the flow of each pattern."""
    place: dict = {}
    members = [[place.setdefault(s, len(place)) for s in m] for m in frame["members"]]
    targets = [0] * len(place)
    for m, t in zip(members, frame["targets"]):
        for j, x in zip(m, t):
            targets[j] = round(x)
    return pd.DataFrame({"pattern": frame["pattern"], "flow": min_cost_flow(frame["size"].tolist(), members, targets)})


def flows(patterns: DataFrame, quota: DataFrame) -> DataFrame:
    """patterns (pattern, members, size) -> (pattern, flow)."""
    each = patterns.select("pattern", "size", F.explode("members").alias("source")).join(quota, "source")
    listed = each.groupBy("pattern").agg(F.first("size").alias("size"), F.collect_list(F.struct("source", "target")).alias("m"))
    listed = listed.select("pattern", "size", F.col("m.source").alias("members"), F.col("m.target").alias("targets"))
    # Sources are linked by the patterns that hold them; a pattern of one source needs no link.
    first = F.col("members")[0]
    links = patterns.where(F.size("members") > 1).select(first.alias("a"), F.explode(F.slice("members", 2, F.size("members"))).alias("b"))
    if links.isEmpty():
        placed = listed.withColumn("component", first)
    else:
        roots = connected(links)
        placed = listed.join(roots, first == F.col("node"), "left").select(*listed.columns, F.coalesce("root", first).alias("component"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return _solved(frame)

    return placed.groupBy("component").applyInPandas(run, "pattern string, flow long")


def mix(docs: DataFrame, sources: Column, size: Column, doc_id: str = "doc_id", seed: int = SEED, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """docs to (doc_id, size, members, taken), how many words of each document the mix takes, and the quotas of :func:`quotas`; sources is an array of names, size a count of words.

    Whole passes over a pattern's documents take them all. Of the rest of its flow, a seeded order takes documents as long as they fit; while more than tolerance of the flow is
    open and a document that fits is left, the order is gone through once more. The last step takes a document that overshoots by less than it mends.
    """
    keep = partial(materialise, label="mix")
    named = F.array_sort(F.array_distinct(F.transform(F.coalesce(sources, F.array().cast("array<string>")), _named)))
    told = docs.select(F.col(doc_id).alias("doc_id"), size.cast("bigint").alias("size"), named.alias("members"))
    told = told.withColumn("pattern", F.to_json("members"))
    placed = scan.ranged(told.withColumn("u", F.xxhash64(F.lit(seed), "doc_id")), ["pattern", "u", "doc_id", "size"], keep)
    patterns = keep(placed.groupBy("pattern").agg(F.first("members").alias("members"), F.sum("size").alias("size")))
    quota = quotas(patterns)
    flow = flows(patterns, quota)
    passes = F.when(F.col("size") > 0, F.floor(F.col("flow") / F.col("size"))).otherwise(0)
    share = keep(patterns.join(flow, "pattern", "left").select("pattern", F.coalesce(passes, F.lit(0)).alias("passes"), F.coalesce("flow", F.lit(0)).alias("flow"), F.coalesce(F.col("flow") - passes * F.col("size"), F.lit(0)).alias("gap")))
    rest, chosen, gaps = placed.where("size > 0"), [], share.select("pattern", "flow", "gap")
    order = ["u", "doc_id", "size"]
    while True:
        fits = rest.join(gaps.where(F.col("gap") > tolerance * F.col("flow")), "pattern").where(F.col("size") <= F.col("gap"))
        summed = scan.running(fits, ["pattern"], order, {"upto": F.col("size")})
        taken = keep(summed.where("upto <= gap").select("pattern", "_part", "_tie", "size"))
        if taken.isEmpty():
            break
        chosen.append(taken.select("_part", "_tie"))
        rest = rest.join(taken.select("_part", "_tie"), ["_part", "_tie"], "left_anti")
        got = taken.groupBy("pattern").agg(F.sum("size").alias("got"))
        gaps = keep(gaps.join(got, "pattern", "left").select("pattern", "flow", (F.col("gap") - F.coalesce("got", F.lit(0))).alias("gap")))
    # No document fits any more where much is open; the smallest left may be nearer than none.
    least = rest.join(gaps.where(F.col("gap") > tolerance * F.col("flow")), "pattern").where(F.col("size") < 2 * F.col("gap")).groupBy("pattern").agg(F.min(F.struct("size", *order[:2], "_part", "_tie")).alias("m"))
    chosen.append(least.select("m._part", "m._tie"))
    every = chosen[0]
    for c in chosen[1:]:
        every = every.unionByName(c)
    marked = placed.join(every.withColumn("more", F.lit(1)), ["_part", "_tie"], "left").join(share.select("pattern", "passes"), "pattern")
    return marked.select("doc_id", "size", "members", (F.col("size") * (F.col("passes") + F.coalesce("more", F.lit(0)))).alias("taken")), quota


def report(docs: DataFrame) -> DataFrame:
    """The mix of documents that belong to one source each: doc_id, size, source_size, target, taken."""
    mixed, quota = mix(docs, F.array("source"), n_words(F.col("text")))
    return mixed.withColumn("source", F.col("members")[0]).join(quota, "source").select("doc_id", "size", "source_size", "target", "taken")
