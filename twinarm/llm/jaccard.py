"""N-gram Jaccard join by a token-group matrix: every pair of documents with Jaccard similarity of at least 3/4 is linked.

1. Documents of equal shingle sets form a class ("node"); only one set of each is handled further.
2. Tokens have a global order, rare ones first (a sketch of fixed size counts them; any order gives the same result). Sets that are similar share a token
   among the first n - ceil(3n/4) + 1 of each, so only those prefixes are exchanged, by token.
3. Similar documents are partitioned into groups: each node is compared with the likeliest partners (the node of a token's list with the most popular
   tokens, as the source of copies has no rare ones of its own, and the one before it), verified links are closed into components, and a component's nodes of like size are a group, or several of bounded size.
4. The token-group matrix stores the union of each group's prefix tokens. A query node meets a group of another component where a shared token stands early
   enough in both for the rest to hold the needed overlap (popular tokens stand last, so they seldom do). Then the tokens shared with the union
   bound the overlap with every member; only groups that could hold a similar one are opened, their members bounded one by one in the same way, and the
   rest compared exactly. Nodes in one component need no comparison, and of two components only the smaller one's nodes are queries, so large groups of
   copies never give all their pairs.

Defined results: null and empty texts and texts without words have the empty set and are linked with nothing; repeated rows are equal sets; rows of a null
doc_id take no part and get a null component; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import shingles
from .common import frugal, materialise
from .components import connected

#: Similar: PER * intersection >= PART * union.
PART, PER = 75, 100
#: Counters of the frequency sketch, and of the slices in which tasks send it. The sketch's size doesn't depend on the input.
SKETCH_BITS, SLICE_BITS = 22, 16
#: Up to so many document ids are broadcast (8 bytes each) to pick their texts from a scan; more go through a shuffle join.
BROADCAST_IDS = 400_000
#: Nodes of a token that are ranked in one task, about; the list of a more frequent one is ranked in parts, and then the parts' heads.
LIST_NODES = 4096
#: Groups hold sizes within this factor, and about so many nodes at most.
BAND, GROUP_NODES = 1.15, 1024


def _similar(texts):
    return shingles.sets(texts)


def _node(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _slices(batches, rows: int = 256):
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


_FIRST = "doc_id bigint, n bigint, node bigint, slice int, counts binary"


def survey(docs: DataFrame) -> DataFrame:
    """One row per document (doc_id, n, node), and rows (slice, counts) of the task's token sketch."""

    def scan(batches):
        counts, mask = np.zeros(1 << SKETCH_BITS, np.uint32), np.uint64((1 << SKETCH_BITS) - 1)
        for rows in _slices(batches):
            found = _similar(rows.column("text").to_pylist())
            for tokens in found:
                np.add.at(counts, (tokens & mask).astype(np.int64), 1)
            n = len(found)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array([len(t) for t in found], pa.int64()), pa.array([_node(t) for t in found], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                names=["doc_id", "n", "node", "slice", "counts"],
            )
        parts = counts.reshape(-1, 1 << SLICE_BITS)
        live = [k for k, part in enumerate(parts) if part.any()]
        none = pa.nulls(len(live), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(live, pa.int32()), pa.array([zlib.compress(parts[k].astype("<u4").tobytes(), 1) for k in live], pa.binary())], names=["doc_id", "n", "node", "slice", "counts"])

    return docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).mapInArrow(frugal(scan), _FIRST)


def token_ranks(surveyed: DataFrame) -> np.ndarray:
    """A rank from 0 to 127 for each counter: the logarithm of its count beyond the noise. Its size is fixed, 2**SKETCH_BITS bytes.

    Many rare tokens share a counter where the input is large; what they give any counter is the median of its slice, since frequent tokens are few.
    """

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(1 << SLICE_BITS, np.int64)
        for raw in table.column("counts"):
            total += np.frombuffer(zlib.decompress(raw.as_py()), "<u4")
        beyond = np.maximum(0, total - int(np.median(total)))
        rank = np.minimum(127, np.log2(beyond + 1) * 3).astype(np.uint8)
        return pa.table({"slice": table.column("slice")[:1], "ranks": pa.array([zlib.compress(rank.tobytes())], pa.binary())})

    ranks = np.zeros((1 << (SKETCH_BITS - SLICE_BITS), 1 << SLICE_BITS), np.uint8)
    for r in surveyed.where(F.col("slice").isNotNull()).select("slice", "counts").groupBy("slice").applyInArrow(add, "slice int, ranks binary").collect():
        ranks[r["slice"]] = np.frombuffer(zlib.decompress(r["ranks"]), np.uint8)
    return ranks.ravel()


def least_overlap(x: Column, y: Column) -> Column:
    """The overlap that makes sets of these sizes similar."""
    return F.ceil(F.lit(PART) * (x + y) / F.lit(PER + PART))


def suffix(n: Column) -> Column:
    """Tokens of a set of n that aren't in its prefix."""
    return F.ceil(F.lit(PART) * n / F.lit(PER)) - 1


def _sizes_fit(x: Column, y: Column) -> Column:
    return PER * F.least(x, y) >= PART * F.greatest(x, y)


_PREFIX = "node bigint, n bigint, popular double, prefix array<bigint>"


def prefixes(docs: DataFrame, ranks: np.ndarray) -> DataFrame:
    """Per node: n, the mean rank of its prefix tokens and these tokens, in order; a token's value has its rank in the high bits, so values sort in the global order."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def scan(batches):
        r, mask = shared.value, np.uint64((1 << SKETCH_BITS) - 1)
        for rows in _slices(batches):
            found = [t for t in _similar(rows.column("text").to_pylist()) if len(t)]
            cut = []
            for t in found:
                order = (r[(t & mask).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (t >> np.uint64(8))
                p = len(t) - -(-PART * len(t) // PER) + 1
                cut.append(np.unique(np.partition(order, p - 1)[:p] if p < len(order) else order).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([_node(t) for t in found], pa.int64()), pa.array([len(t) for t in found], pa.int64()), pa.array([float((c >> 56).mean()) for c in cut], pa.float64()), pa.array(cut, pa.list_(pa.int64()))], names=["node", "n", "popular", "prefix"])

    every = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull()).mapInArrow(frugal(scan), _PREFIX)
    return every.groupBy("node").agg(F.first("n").alias("n"), F.first("popular").alias("popular"), F.first("prefix").alias("prefix"))


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, label: str) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar. nodes (node, doc_id) says where to find a node's text."""
    pairs = materialise(pairs, f"{label}-pairs")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    ids = materialise(nodes.join(wanted, "node", "left_semi").select("doc_id").distinct(), f"{label}-ids")
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")

    def scan(batches):
        for rows in _slices(batches):
            found = _similar(rows.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([_node(t) for t in found], pa.int64()), pa.array([t.tobytes() for t in found], pa.binary())], names=["node", "tokens"])

    sets = texts.mapInArrow(frugal(scan), "node bigint, tokens binary").groupBy("node").agg(F.first("tokens").alias("tokens"))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("s")), "a").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("t")), "b")

    def compare(batches):
        for rows in _slices(batches):
            good = []
            for s, t in zip(rows.column("s"), rows.column("t")):
                x, y = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                common = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                good.append(PER * common >= PART * (len(x) + len(y) - common))
            yield rows.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return materialise(both.select("a", "b", "s", "t").mapInArrow(frugal(compare), "a bigint, b bigint"), f"{label}-links")


def _close(ids: DataFrame) -> DataFrame:
    """ids with a broadcast hint if it has few rows."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _likely(shared: DataFrame) -> DataFrame:
    """For each node the partner it shares most lists with, as first of the list and as the one before it."""
    pairs = None
    for other, size in (("head", "head_n"), ("prev", "prev_n")):
        rows = shared.where(F.col(other).isNotNull() & (F.col(other) != F.col("node")) & _sizes_fit(F.col("n"), F.col(size)))
        counted = rows.groupBy("node", "n", other).agg(F.count("*").alias("c"))
        best = counted.where(F.col("c") * 20 >= F.col("n") - suffix(F.col("n"))).groupBy("node").agg(F.max_by(other, F.struct("c", other)).alias("other"))
        best = best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))
        pairs = best if pairs is None else pairs.union(best)
    return pairs.distinct()


def _group(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / float(np.log(BAND))).cast("int")


def _least_of(band: Column) -> Column:
    """A lower bound on the sizes in a band."""
    return F.floor(F.pow(F.lit(BAND), band.cast("double"))).cast("bigint")


#: Bands that a similar set can be apart.
_REACH = int(np.log(PER / PART) / np.log(BAND)) + 1


def _needed(x: Column, y: Column) -> Column:
    """Tokens that prefixes must share for sets of these sizes to be similar."""
    return least_overlap(x, y) - F.greatest(suffix(x), suffix(y))


def _met(rows: DataFrame) -> DataFrame:
    """rows (n and most: the least and the largest size, band, rest: the tokens from the shared one on) for each band of sizes that a similar set can have and the rest allows, as ``other``."""
    each = rows.select("*", F.explode(F.sequence(F.col("band") - _REACH, F.col("band") + _REACH)).alias("other"))
    fewest = F.greatest(_least_of(F.col("other")), F.ceil(PART * F.col("n") / PER))
    fits = (PER * F.col("most") >= PART * _least_of(F.col("other"))) & (PER * _least_of(F.col("other") + 2) >= PART * F.col("n"))
    return each.where(fits & (F.col("rest") >= least_overlap(fewest, F.col("n"))))


def _candidates(rows: DataFrame) -> DataFrame:
    """(node, grp): query nodes and groups of larger components that share a token which stands early enough in both.

    The key joins a token and both bands in one hash; a collision gives a candidate more, which the bound below rejects.
    """
    size = F.struct("nodes", "comp")
    queries = _met(rows.where("asks").select("tok", "node", "n", F.col("n").alias("most"), "nodes", "comp", "band", (F.col("n") - F.col("pos")).alias("rest")))
    queries = queries.select(F.xxhash64("tok", "band", "other").alias("key"), "node", size.alias("own"))
    matrix = rows.where("asked").groupBy("tok", "nodes", "comp", "band", "grp").agg(F.min("n").alias("n"), F.max("n").alias("most"), F.max(F.col("n") - F.col("pos")).alias("rest"))
    matrix = _met(matrix).select(F.xxhash64("tok", "other", "band").alias("key"), "grp", size.alias("theirs"))
    return queries.join(matrix, "key").where("own < theirs").select("node", "grp").distinct()


def _opened(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of different components whose shared prefix tokens allow them to be similar."""
    candidates = materialise(_candidates(rows), "candidates")
    own = rows.join(_close(candidates.select("node").distinct()), "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.collect_set("tok").alias("toks"))
    unions = rows.join(_close(candidates.select("grp").distinct()), "grp", "left_semi").groupBy("grp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.collect_set("tok").alias("union"))
    bound = candidates.join(own, "node").join(unions, "grp")
    lo = F.greatest(F.col("lo"), F.ceil(PART * F.col("n") / PER))
    hi = F.least(F.col("hi"), F.floor(PER * F.col("n") / PART))
    # Between lo and hi the need is least at an end; rounding up may take one.
    need = F.least(_needed(lo, F.col("n")), _needed(hi, F.col("n"))) - 1
    opened = bound.where((lo <= hi) & (F.size(F.array_intersect("toks", "union")) >= need)).select("node", "grp", "n", "toks")
    opened = materialise(opened, "opened")
    members = rows.join(_close(opened.select("grp").distinct()), "grp", "left_semi").groupBy("grp", F.col("node").alias("x")).agg(F.first("n").alias("nx"), F.collect_set("tok").alias("own"))
    pairs = opened.join(members, "grp").where(_sizes_fit(F.col("n"), F.col("nx")))
    pairs = pairs.where(F.size(F.array_intersect("toks", "own")) >= _needed(F.col("n"), F.col("nx")))
    return pairs.select(F.least("node", "x").alias("a"), F.greatest("node", "x").alias("b")).distinct()


def links(docs: DataFrame, members: DataFrame, ranks: np.ndarray) -> DataFrame:
    """Verified links (a, b) between nodes, enough to connect every two nodes that similar pairs connect."""
    nodes = materialise(members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")
    tokens = prefixes(docs, ranks).select("node", "n", "popular", F.posexplode("prefix").alias("pos", "tok"))
    # A token's value tells its frequency (see token_ranks), so a token of a third of all documents is spread over parts at once.
    parts = F.ceil(F.pow(F.lit(2.0), (F.shiftright("tok", 56) + 1) / 3) / LIST_NODES).cast("int")
    tokens = tokens.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    order = (F.desc("popular"), F.asc("n"), F.asc("node"))
    by_part, by_token = Window.partitionBy("tok", "part").orderBy(*order), Window.partitionBy("tok").orderBy(*order)

    def neighbours(at) -> list[Column]:
        return [F.lag("node").over(at).alias("prev"), F.lag("n").over(at).alias("prev_n"), F.first("node").over(at).alias("head"), F.first("n").over(at).alias("head_n")]

    lists = tokens.select("tok", "node", "n", "pos", "popular", "parts", *neighbours(by_part), F.lead("node").over(by_part).isNotNull().alias("more"))
    shared = materialise(lists.where(F.col("prev").isNotNull() | F.col("more") | (F.col("parts") > 1)).drop("more"), "lists")
    heads = shared.where((F.col("parts") > 1) & F.col("prev").isNull()).select("tok", "node", "n", "popular")
    near = _verified(docs, nodes, _likely(shared.drop("popular", "parts", "pos").unionByName(heads.select("tok", "node", "n", *neighbours(by_token)))), "near")
    roots = connected(near)
    roots = roots.join(materialise(roots.groupBy("root").agg(F.count("*").alias("nodes")), "sizes"), "root")
    # From here on only tokens count that occur in more than one component.
    placed = shared.select("tok", "node", "n", "pos").join(_close(roots), "node", "left").select("tok", "node", "n", "pos", F.coalesce("root", "node").alias("comp"), F.coalesce("nodes", F.lit(1)).alias("nodes"))
    size = F.struct("nodes", "comp")
    # Written, so that a frequent token's rows meet it by a plain exchange, which can be split.
    mixed = materialise(placed.groupBy("tok").agg(F.min(size).alias("lo"), F.max(size).alias("hi")).where("lo < hi"), "mixed")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("nodes") / GROUP_NODES))  # so that a group has a bound, however large its component
    # A token's largest component has none to ask there, and its smallest is asked by none.
    grouped = placed.join(mixed, "tok").select("tok", "node", "n", "pos", "comp", "nodes", _group(F.col("n")).alias("band"), (size < F.col("hi")).alias("asks"), (size > F.col("lo")).alias("asked"))
    rows = materialise(grouped.withColumn("grp", F.xxhash64("comp", "band", part)), "matrix")
    return near.union(_verified(docs, nodes, _opened(rows), "far"))


def similar_components(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the least doc_id it is linked with, over any number of links)."""
    surveyed = materialise(survey(docs), "survey")
    members = surveyed.where(F.col("doc_id").isNotNull()).select("doc_id", "n", "node")
    roots = connected(links(docs, members, token_ranks(surveyed)))
    least = members.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(roots, "node", "left")
    least = materialise(least.withColumn("root", F.coalesce("root", "node")), "least")
    final = least.join(materialise(least.groupBy("root").agg(F.min("least").alias("component_id")), "component-ids"), "root").select("node", "component_id")
    linked = members.where("n > 0").join(final, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(alone)
