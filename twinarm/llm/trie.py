"""The trie of conversation prefixes, and totals of its subtrees by parallel tree contraction.

A prefix is known by its depth and by sums of 64-bit hashes over its turns, each of (place, role, text), kept in four lanes of 32 bits; so prefixes are running sums, and one long conversation is
shared by many tasks (:mod:`twinarm.operators.scan`). Equal prefixes become nodes.

Contraction alternates two steps. Rake: every leaf's sums go to its parent. Compress: unary chains shrink to their lowest nodes. Every node lies on one path, that of its deepest member, and
a unary node's only child mostly follows it there, so whole stretches of chains shrink at once, in blocks of depths that grow from round to round. Where the only child lies on another path,
as happens once other children are raked, a round splices out nodes by coin tosses instead, so rounds grow with the logarithm of the nodes whatever their shape. A compressed node remembers the node below it and what lay
between; going back through the rounds gives every subtree's total.

Defined results: turns are in order of turn (null first), role and text; a null role or text is empty; repeated rows are turns of their own; rows without a conversation take no part; an
empty log gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import scan
from .common import materialise

#: Depths that a task compresses at once in the first round; four times as many in each further one. Ids that are joined to a string at once.
BLOCK, IDS = 1024, 1 << 16
_LANES = [f"lane{i}" for i in range(4)]
_LOW = (1 << 32) - 1
_ORDER = ["turn", "_role", "_head", "digest"]


def _lanes(place: Column) -> dict[str, Column]:
    """The hash of a turn (digest) at a place, in lanes."""
    halves = {}
    for i in range(2):
        h = F.xxhash64(F.lit(i), place, F.col("digest"))
        halves |= {_LANES[2 * i]: h.bitwiseAND(F.lit(_LOW)), _LANES[2 * i + 1]: F.shiftrightunsigned(h, 32)}
    return halves


def _packed(lanes: list[Column]) -> Column:
    low = [x.bitwiseAND(F.lit(_LOW)) for x in lanes]
    return F.struct(F.shiftleft(low[0], 32).bitwiseOR(low[1]).alias("a"), F.shiftleft(low[2], 32).bitwiseOR(low[3]).alias("b"))


def ranked_turns(log: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, digest, chars, _part, _tie) of a log (conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = log.where("conv_id is not null").select("conv_id", "turn", F.left(role, F.lit(64)).alias("_role"), F.left(text, F.lit(256)).alias("_head"), told.alias("digest"), F.length(text).cast("bigint").alias("chars"))
    placed = scan.ranged(rows, ["conv_id", *_ORDER], partial(materialise, label="turns"))
    return materialise(scan.running(placed, ["conv_id"], _ORDER, {"pos": F.lit(1).cast("bigint")}).select("conv_id", "pos", "digest", "chars", "_part", "_tie"), "ranked")


def branch(turns: DataFrame, base: Column, head: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt from the first head turns of their base (fewer if it has fewer) and their own turns after the first head.

    turns is from :func:`ranked_turns`; base and head are of conv_id, head being a small number. Gives prefixes (conv_id, length, depth, key, parent_key, chars) and
    conversations (conv_id, length, key), both with keys of whole prefixes.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = own.select("conv_id", "n", base.alias("base"), head.cast("bigint").alias("head"))
    # A base's head is a few turns, and the conversations that share a base are few.
    most = convs.agg(F.max("head")).first()[0] or 0
    heads = turns.where(F.col("pos") <= most).select(F.col("conv_id").alias("base"), "pos", "digest", "chars")
    begun = convs.join(heads, "base").where(F.col("pos") <= F.col("head")).select("conv_id", F.col("pos").alias("depth"), "digest", "chars")
    upto = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    begun = materialise(begun.withColumns(_lanes(F.col("depth"))).select("conv_id", "depth", "chars", *[F.col(x).alias(f"_{x}") for x in _LANES], *[F.sum(x).over(upto).alias(x) for x in _LANES]), "begun")
    sums = begun.groupBy("conv_id").agg(F.count("*").alias("kept"), *[F.max_by(x, "depth").alias(f"_of_{x}") for x in _LANES])
    kept = F.coalesce("kept", F.lit(0))
    info = convs.join(sums, "conv_id", "left").select("conv_id", "head", kept.alias("kept"), (kept + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("length"), *[F.coalesce(f"_of_{x}", F.lit(0)).alias(f"_of_{x}") for x in _LANES])
    info = materialise(info, "conversations")
    rest = turns.join(info, "conv_id").where(F.col("pos") > F.col("head"))
    rest = rest.withColumn("depth", F.col("kept") + F.col("pos") - F.col("head"))
    rest = rest.withColumns({f"_{x}": c for x, c in _lanes(F.col("depth")).items()})
    rest = scan.running(rest, ["conv_id"], ["pos"], {x: F.col(f"_{x}") for x in _LANES})
    rest = rest.withColumns({x: F.col(x) + F.col(f"_of_{x}") for x in _LANES})
    columns = ["conv_id", "length", "depth", "chars", *_LANES, *[f"_{x}" for x in _LANES]]
    whole = begun.join(info.select("conv_id", "length"), "conv_id").select(*columns).unionByName(rest.select(*columns))
    key, parent = _packed([F.col(x) for x in _LANES]), _packed([F.col(x) - F.col(f"_{x}") for x in _LANES])
    prefixes = materialise(whole.select("conv_id", "length", "depth", key.alias("key"), parent.alias("parent_key"), "chars"), "prefixes")
    ends = prefixes.where("depth = length").select("conv_id", "length", "key")
    none = info.where("length = 0").select("conv_id", "length", F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")).alias("key"))
    return prefixes, ends.unionByName(none)


def nodes(prefixes: DataFrame, ends: DataFrame) -> DataFrame:
    """(id, parent, path, key, n_convs, chars) of the trie's nodes; id is a node's least member and depth, path its deepest member (of equal ones the greatest)."""
    members = [F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max(F.struct("length", "conv_id")).alias("deepest")]
    found = prefixes.groupBy("depth", "key").agg(F.first("parent_key").alias("parent_key"), F.first("chars").alias("chars"), *members)
    no_key = F.struct(F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"))
    root = ends.agg(*members).where("n_convs > 0").select(F.lit(0).cast("bigint").alias("depth"), no_key.alias("key"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("parent_key"), F.lit(0).cast("bigint").alias("chars"), "conv_id", "n_convs", "deepest")
    every = materialise(found.select(*root.columns).unionByName(root), "nodes")
    up = every.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.struct("conv_id", "depth").alias("parent"))
    met = every.join(up, ["depth", "parent_key"], "left")
    return materialise(met.select(F.struct("conv_id", "depth").alias("id"), "parent", F.col("deepest.conv_id").alias("path"), "key", "n_convs", "chars"), "trie")


def _raked(live: DataFrame, values: list[str]) -> DataFrame:
    """Nodes with open children, with their leaves' sums added, n_kids counted anew, and kid, the least open child."""
    leaf = F.col("n_kids") == 0
    sums = [F.sum(F.when(leaf, F.col(f"s_{v}") + F.col(f"e_{v}")).otherwise(0)).alias(f"_{v}") for v in values]
    kid = F.struct("id", "path", *[f"e_{v}" for v in values])
    kids = live.where("parent is not null").groupBy("parent").agg(*sums, F.sum((~leaf).cast("int")).alias("_open"), F.min(F.when(~leaf, kid)).alias("kid")).withColumnRenamed("parent", "_of")
    met = live.where(~leaf).join(kids, F.col("id") == F.col("_of"))
    return met.withColumns({"n_kids": F.col("_open"), **{f"s_{v}": F.col(f"s_{v}") + F.col(f"_{v}") for v in values}})


def _compressed(stay: DataFrame, values: list[str], block: int) -> DataFrame:
    """Unary nodes whose only child follows in the same block of their path give way to the lowest such child: status, id, parent, sums, and for those that go: to and a_ (what is added to its total)."""
    unary = (F.col("n_kids") == 1) & F.col("parent").isNotNull() & (F.col("kid.path") == F.col("path"))
    blk = F.floor(F.col("id.depth") / block)
    rows = stay.withColumns({"_blk": blk, "_goes": F.coalesce(unary & (F.floor(F.col("kid.id.depth") / block) == blk), F.lit(False))})
    before = Window.partitionBy("path", "_blk").orderBy("id.depth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_run", F.coalesce(F.sum((~F.col("_goes")).cast("int")).over(before), F.lit(0)))
    run = Window.partitionBy("path", "_blk", "_run").orderBy("id.depth")
    below, above, whole = run.rowsBetween(1, Window.unboundedFollowing), run.rowsBetween(Window.unboundedPreceding, 0), run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    goes, own = F.col("_goes"), {v: F.col(f"e_{v}") + F.when(F.col("_goes"), F.col(f"s_{v}")).otherwise(0) for v in values}
    return rows.select(
        F.when(goes, "compressed").otherwise("live").alias("status"),
        "id",
        F.when(goes, F.col("parent")).otherwise(F.first("parent").over(above)).alias("parent"),
        "path",
        "n_kids",
        *[f"s_{v}" for v in values],
        *[F.when(goes, F.col(f"e_{v}")).otherwise(F.sum(own[v]).over(above)).alias(f"e_{v}") for v in values],
        F.when(goes, F.last("id").over(whole)).alias("to"),
        *[F.when(goes, F.col(f"s_{v}") + F.coalesce(F.sum(own[v]).over(below), F.lit(0))).alias(f"a_{v}") for v in values],
        (~goes & (F.col("n_kids") == 1) & (F.col("kid.path") != F.col("path"))).alias("aside"),
    )


def _spliced(stay: DataFrame, values: list[str], number: int) -> DataFrame:
    """As :func:`_compressed`, for unary nodes anywhere: those go whose coin falls on heads and whose child's doesn't, so no two neighbours go at once."""

    def heads(node: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(number), node), F.lit(2)) == 1

    goes = (F.col("n_kids") == 1) & F.col("parent").isNotNull() & heads("id") & ~heads("kid.id")
    rows = stay.withColumn("_goes", F.coalesce(goes, F.lit(False)))
    gone = rows.where("_goes").select(F.col("kid.id").alias("_kid"), F.col("parent").alias("_up"), *[(F.col(f"s_{v}") + F.col(f"e_{v}")).alias(f"_more_{v}") for v in values])
    met = rows.join(gone, F.col("id") == F.col("_kid"), "left")
    goes = F.col("_goes")
    return met.select(
        F.when(goes, "compressed").otherwise("live").alias("status"),
        "id",
        F.when(F.col("_kid").isNotNull(), F.col("_up")).otherwise(F.col("parent")).alias("parent"),
        "path",
        "n_kids",
        *[f"s_{v}" for v in values],
        *[(F.col(f"e_{v}") + F.coalesce(f"_more_{v}", F.lit(0))).alias(f"e_{v}") for v in values],
        F.when(goes, F.col("kid.id")).alias("to"),
        *[F.when(goes, F.col(f"s_{v}") + F.col(f"kid.e_{v}")).alias(f"a_{v}") for v in values],
        (~goes & (F.col("n_kids") == 1) & (F.col("kid.path") != F.col("path"))).alias("aside"),
    )


def subtree_totals(tree: DataFrame, values: list[str], block: int = BLOCK) -> DataFrame:
    """tree (id, parent, path, and numbers) -> (id, n_children, and each of values added up over the node's subtree). id is a struct with depth; a value ``leaves`` counts childless nodes."""
    kids = tree.where("parent is not null").groupBy("parent").agg(F.count("*").alias("n_kids")).withColumnRenamed("parent", "_of")
    first = tree.join(kids, F.col("id") == F.col("_of"), "left").withColumn("n_kids", F.coalesce("n_kids", F.lit(0)))
    own = {v: (F.col("n_kids") == 0).cast("bigint") if v == "leaves" else F.col(v) for v in values}
    none = F.lit(0).cast("bigint")
    live = materialise(first.select("id", "parent", "path", "n_kids", *[own[v].alias(f"s_{v}") for v in values], *[none.alias(f"e_{v}") for v in values]), "live")
    children, columns = live.select("id", F.col("n_kids").alias("n_children")), live.columns
    rounds, aside = [], False
    left = live.where("parent is not null").limit(1).count()
    while left:
        stay = _raked(live, values)
        done = _spliced(stay, values, len(rounds)) if aside else _compressed(stay, values, block << min(2 * len(rounds), 40))
        leaves = live.where("n_kids = 0 and parent is not null").select(F.lit("raked").alias("status"), *columns)
        step = materialise(done.unionByName(leaves, allowMissingColumns=True), "round")
        rounds.append(step)
        live = step.where("status = 'live'").select(*columns)
        left, odd, even = step.where("status = 'live'").agg(F.count("parent"), F.count_if("aside"), F.count_if(F.expr("not aside and n_kids = 1 and parent is not null"))).first()
        aside = odd > even
    known = [live.select("id", *[F.col(f"s_{v}").alias(v) for v in values])]  # the root
    for step in reversed(rounds):
        later = known[0]
        for k in known[1:]:
            later = later.unionByName(k)
        own_total = step.where("status = 'raked'").select("id", *[F.col(f"s_{v}").alias(v) for v in values])
        below = later.select(F.col("id").alias("_below"), *[F.col(v).alias(f"_{v}") for v in values])
        via = step.where("status = 'compressed'").join(below, F.col("to") == F.col("_below")).select("id", *[(F.col(f"a_{v}") + F.col(f"_{v}")).alias(v) for v in values])
        known.append(materialise(own_total.unionByName(via), "totals"))
    every = known[0]
    for k in known[1:]:
        every = every.unionByName(k)
    return every.join(children, "id")


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, key, ends_sha256) of the nodes at which conversations end: their ids in ascending order.

    Ids become strings in stretches of IDS possible values, so a task that digests a popular node reads few rows, one after the other.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    stretches = ends.groupBy(F.col("length").alias("depth"), "key", F.floor(F.col("conv_id") / IDS).alias("stretch")).agg(ids.alias("ids"))
    rows = stretches.select("depth", F.col("key.a").alias("a"), F.col("key.b").alias("b"), "stretch", "ids").repartition("depth", "a", "b").sortWithinPartitions("depth", "a", "b", "stretch")

    def digest(frames):
        at, state = None, None
        for f in frames:
            out = []
            for depth, a, b, ids in zip(f["depth"], f["a"], f["b"], f["ids"]):
                if (depth, a, b) != at:
                    if at is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = (depth, a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["depth", "a", "b", "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(*at, state.hexdigest())], columns=["depth", "a", "b", "ends_sha256"])

    done = rows.select("depth", "a", "b", "ids").mapInPandas(digest, "depth bigint, a bigint, b bigint, ends_sha256 string")
    return done.select("depth", F.struct("a", "b").alias("key"), "ends_sha256")


def prefix_report(prefixes: DataFrame, ends: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    tree = nodes(prefixes, ends)
    totals = subtree_totals(tree.withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), ["leaves", "saved"])
    digests = end_digests(ends).select(F.col("depth").alias("_depth"), F.col("key").alias("_key"), "ends_sha256")
    met = tree.join(totals, "id").join(digests, (F.col("id.depth") == F.col("_depth")) & (F.col("key") == F.col("_key")), "left")
    return met.select(
        F.col("id.conv_id").alias("conv_id"),
        F.col("id.depth").alias("depth"),
        F.col("parent.conv_id").alias("parent_conv_id"),
        "n_convs",
        F.col("n_children").cast("bigint").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def report(log: DataFrame) -> DataFrame:
    """The trie of conversations that begin with the first crc32(conv_id) mod 6 turns of conversation conv_id - conv_id mod 100."""
    own = F.col("conv_id")
    prefixes, ends = branch(ranked_turns(log), own - own % 100, F.crc32(own.cast("string").cast("binary")) % 6)
    return prefix_report(prefixes, ends)
