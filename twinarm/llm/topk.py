"""Exact top-k inner-product search: ball trees per shard, branch and bound by upper bound, the k-th score shared.

1. Space is cut into cells by a binary tree of directions and medians, chosen on a bounded sample; a cell's vectors form one shard, or several of about SHARD_ROWS
   (by a hash of the id, so one vector in a third of all rows is spread too). Each shard's ball tree is built once and stored with it.
2. For a query and a ball (centre c, radius r) no vector inside scores above q.c + |q| r. A query searches one shard of the likeliest cell first; its k-th score there
   is shared with all others: the query goes only to cells whose bound is not below it.
3. In a shard, leaves are opened in falling order of their bound (the least over the leaf's ball and all balls around it) until it lies below the query's k-th score.

A cell's shards are copied for each block of at most about BLOCK_QUERIES of the queries that it gets, never for all. The driver holds the sample, the cutting tree and
a ball for each cell (at most 2**LEVELS a vector length).

Vectors are integers; scores are exact: in floating point while sums of products stay below 2**53, else in integers, and an error ends the search if a score
doesn't fit 64 bits. Ties go to the smaller id. Defined results: rows whose id or vector is null, or that hold null or non-finite components, take no part; equal rows (id and vector)
count once; rows that share the query's id are its own; vectors of other lengths than the query's aren't its candidates; with fewer than
k candidates all are returned; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SHARD_ROWS, LEAF_ROWS = 4096, 64
#: Vectors on which the cells are chosen (about), and levels of the cutting tree at most. Both change the speed alone.
SAMPLE_ROWS, LEVELS = 20_000, 10
#: Queries that meet a shard in one task, about.
BLOCK_QUERIES = 1024
#: The score of nothing.
NONE = np.iinfo(np.int64).min


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, null where the vector can't take part."""
    usable = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


class BallTree:
    """Leaves of vectors under balls; bounds by level."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        points = vectors.astype(float)
        self.levels, parts = [], [np.arange(len(ids))]
        while True:
            centres = np.array([points[p].mean(0) for p in parts])
            radii = np.array([np.sqrt(((points[p] - c) ** 2).sum(1).max()) for p, c in zip(parts, centres)])
            self.levels.append((centres, radii))
            if max(map(len, parts)) <= LEAF_ROWS:
                break
            halves = []
            for p, c in zip(parts, centres):
                by = p[np.argsort(points[p] @ _direction(points[p], c), kind="stable")]
                halves += [by[: len(p) // 2], by[len(p) // 2 :]]
            parts = [h for h in halves if len(h)]
        order = np.concatenate(parts)
        self.ids, self.vectors, self.ends = ids[order], vectors[order], np.cumsum([len(p) for p in parts])

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, ids=self.ids, vectors=self.vectors, ends=self.ends, **{f"{n}{k}": x for k, level in enumerate(self.levels) for n, x in zip("cr", level)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, raw: bytes) -> BallTree:
        tree, held = cls.__new__(cls), np.load(io.BytesIO(raw))
        tree.ids, tree.vectors, tree.ends = (held[n] for n in ("ids", "vectors", "ends"))
        tree.levels = [(held[f"c{k}"], held[f"r{k}"]) for k in range((len(held.files) - 3) // 2)]
        return tree

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds (queries, leaves): the least over a leaf's ball and all balls around it."""
        best = None
        for centres, radii in self.levels:
            own = ball_bounds(queries, centres, radii)
            if best is not None and own.shape[1] == 2 * best.shape[1]:
                own = np.minimum(own, np.repeat(best, 2, axis=1))
            best = own
        return best


def ball_bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Upper bounds of scores (queries, balls)."""
    own = queries @ centres.T + np.sqrt((queries**2).sum(1))[:, None] * radii
    return own + 1e-6 * (np.abs(own) + 1)  # rounding must not close a ball


def _direction(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """From a point far from the centre to the point farthest from that."""
    far = points[((points - centre) ** 2).sum(1).argmax()]
    return points[((points - far) ** 2).sum(1).argmax()] - far


class TopK:
    """The k best of each query so far, as (score, id), best first. floor: scores known to be reached elsewhere, NONE without any."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray):
        self.query_ids, self.queries, self.points, self.floor = query_ids, queries, queries.astype(float), floor
        self.scores = np.full((len(queries), k), NONE)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.scored = np.zeros(len(queries), np.int64)
        self.k = k

    def kth(self) -> np.ndarray:
        return np.maximum(self.scores[:, -1], self.floor)

    def search(self, tree: BallTree) -> None:
        """Branch and bound over one shard."""
        if not len(self.queries):
            return
        bounds = tree.bounds(self.points)
        order = np.argsort(-bounds, axis=1, kind="stable")
        starts = np.concatenate([[0], tree.ends[:-1]])
        for step in range(order.shape[1]):
            leaf = order[:, step]
            live = np.flatnonzero(bounds[np.arange(len(leaf)), leaf] >= self.kth())
            if not len(live):
                return
            by = live[np.argsort(leaf[live], kind="stable")]
            for rows in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
                a, b = starts[leaf[rows[0]]], tree.ends[leaf[rows[0]]]
                self.scored[rows] += b - a
                self._offer(rows, tree.ids[a:b], tree.vectors[a:b])

    def _products(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        q = self.queries[rows]
        most = float(np.abs(self.points[rows]).max(initial=0)) * float(np.abs(vectors.astype(float)).max(initial=0)) * max(1, q.shape[1])
        if most < 2**53:
            return (self.points[rows] @ vectors.T.astype(float)).astype(np.int64)
        if most < 2**62:
            return q @ vectors.T
        whole = q.astype(object) @ vectors.T.astype(object)
        whole[ids[None, :] == self.query_ids[rows][:, None]] = 0
        if any(abs(x) >= 2**63 for x in whole.flat):
            raise OverflowError("a score doesn't fit 64 bits")
        return whole.astype(np.int64)

    def _offer(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = self._products(rows, ids, vectors)
        scores[ids[None, :] == self.query_ids[rows][:, None]] = NONE
        hit = (scores >= self.kth()[rows][:, None]).any(1)
        if not hit.any():
            return
        rows, scores = rows[hit], scores[hit]
        all_scores = np.concatenate([self.scores[rows], scores], 1)
        all_ids = np.concatenate([self.ids[rows], np.where(scores > NONE, ids[None, :], np.iinfo(np.int64).max)], 1)
        best = np.lexsort((all_ids, ~all_scores), axis=1)[:, : self.k]  # ~x falls as x rises, without overflow
        self.scores[rows] = np.take_along_axis(all_scores, best, 1)
        self.ids[rows] = np.take_along_axis(all_ids, best, 1)


def cutting_tree(points: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and medians of the inner nodes, the children of node i being 2 i + 1 (below the median) and 2 i + 2."""
    w, t, parts = np.zeros((2**levels - 1, points.shape[1])), np.full(2**levels - 1, np.inf), [np.arange(len(points))]
    for level in range(levels):
        halves = []
        for k, p in enumerate(parts):
            node = 2**level - 1 + k
            if len(p) > 1:
                w[node] = _direction(points[p], points[p].mean(0))
                along = points[p] @ w[node]
                t[node] = np.median(along)
                halves += [p[along <= t[node]], p[along > t[node]]]
            else:
                halves += [p, p[:0]]
        parts = halves
    return w, t


def cell_of(points: np.ndarray, w: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The cell of each point."""
    at = np.zeros(len(points), np.int64)
    for _ in range(int(np.log2(len(t) + 1))):
        at = 2 * at + 1 + ((points * w[at]).sum(1) > t[at])
    return at - len(t)


def _matrix(column, dim: int) -> np.ndarray:
    return np.array(column.to_pylist(), np.int64).reshape(len(column), dim)


def _by_dim(batch):
    """(dim, rows) of a batch with a column dim."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


_KEY = ["dim", "cell", "salt"]


def placed(vectors: DataFrame) -> DataFrame:
    """vectors (vec_id, v, q) with dim and cell."""
    sized = vectors.withColumn("dim", F.size("v"))
    counts = {r["dim"]: r["n"] for r in sized.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each vector length
    share = int(1_000_000 * min(1.0, SAMPLE_ROWS / max(1, sum(counts.values())))) + 1
    held: dict[int, list] = {}
    for r in sized.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < share).select("dim", "v").toLocalIterator():
        held.setdefault(r["dim"], []).append(r["v"])
    trees = {}
    for dim, n in counts.items():
        levels = min(LEVELS, max(0, int(np.ceil(np.log2(n / SHARD_ROWS)))))
        own = held.get(dim, [])
        trees[dim] = cutting_tree(np.array(own, float).reshape(len(own), dim), levels)
    shared = vectors.sparkSession.sparkContext.broadcast(trees)

    def place(batches):
        for batch in batches:
            for dim, rows in _by_dim(batch):
                cells = cell_of(_matrix(rows.column("v"), dim).astype(float), *shared.value[dim])
                yield rows.append_column("cell", pa.array(cells.astype(np.int32)))

    return sized.mapInArrow(place, "vec_id bigint, v array<bigint>, q boolean, dim int, cell int")


def index(vectors: DataFrame) -> DataFrame:
    """Shards (dim, cell, salt, n, centre, radius, tree) of placed vectors."""
    counts = vectors.groupBy("dim", "cell").agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / SHARD_ROWS))
    salted = vectors.join(F.broadcast(counts.select("dim", "cell", "salts")), ["dim", "cell"])  # at most 2**LEVELS rows a vector length
    keyed = salted.select("dim", "cell", F.pmod(F.xxhash64("vec_id", "v"), F.col("salts")).cast("int").alias("salt"), "vec_id", "v")

    def build(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        dim = rows.column("dim")[0].as_py()
        tree = BallTree(rows.column("vec_id").to_numpy(), _matrix(rows.column("v"), dim))
        (centre,), (radius,) = tree.levels[0]
        return pa.table({**{k: rows.column(k)[:1] for k in _KEY}, "n": pa.array([rows.num_rows]), "centre": pa.array([centre.tolist()], pa.list_(pa.float64())), "radius": [float(radius)], "tree": [tree.to_bytes()]})

    return keyed.groupBy(*_KEY).applyInArrow(build, "dim int, cell int, salt int, n bigint, centre array<double>, radius double, tree binary")


def balls(shards: DataFrame) -> DataFrame:
    """A ball around each cell's shards, and the number of their salts (of which some may have no rows): dim, cell, salts, centre, radius."""

    def around(rows: pa.Table) -> pa.Table:
        centres = np.array(rows.column("centre").to_pylist(), float).reshape(rows.num_rows, -1)
        middle = centres.mean(0)
        radius = float((np.sqrt(((centres - middle) ** 2).sum(1)) + rows.column("radius").to_numpy()).max()) * (1 + 1e-12)
        return pa.table({"dim": rows.column("dim")[:1], "cell": rows.column("cell")[:1], "salts": pa.array([int(rows.column("salt").to_numpy().max()) + 1], pa.int32()), "centre": pa.array([middle.tolist()], pa.list_(pa.float64())), "radius": [radius]})

    return shards.select(*_KEY, "centre", "radius").groupBy("dim", "cell").applyInArrow(around, "dim int, cell int, salts int, centre array<double>, radius double")


_FOUND = "query_id bigint, vec_id bigint, score bigint, scored bigint"


def _meet(shards: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best of each query in the shards that it asks (query_id, v, floor and a shard's key); and how many vectors were scored, in rows without vec_id."""
    blocks = asked.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.max("salts") / BLOCK_QUERIES).cast("int").alias("blocks"))
    blocks = F.broadcast(materialise(blocks, "blocks"))  # at most 2**LEVELS rows a vector length
    left = shards.join(blocks, ["dim", "cell"]).select(*_KEY, "tree", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = asked.join(blocks, ["dim", "cell"]).select(*_KEY, F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), "query_id", "v", "floor")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
        missing = np.zeros(0, bool)
        if left.num_rows and right.num_rows:
            queries = _matrix(right.column("v"), left.column("dim")[0].as_py())
            top = TopK(right.column("query_id").to_numpy(), queries, k, right.column("floor").fill_null(NONE).to_numpy())
            top.search(BallTree.from_bytes(left.column("tree")[0].as_py()))
            row, rank = np.nonzero(top.scores > NONE)
            n = np.arange(len(queries))
            none = np.zeros(len(n), np.int64)
            out = [np.concatenate(x) for x in ((top.query_ids[row], top.query_ids), (top.ids[row, rank], none), (top.scores[row, rank], none), (np.zeros(len(row), np.int64), top.scored))]
            missing = np.concatenate([np.zeros(len(row), bool), np.ones(len(n), bool)])
        return pa.table({"query_id": pa.array(out[0]), "vec_id": pa.array(out[1], mask=missing), "score": pa.array(out[2], mask=missing), "scored": pa.array(out[3])})

    keys = [*_KEY, "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, _FOUND)


def _routed(queries: DataFrame, cells: dict[int, tuple], first: bool) -> DataFrame:
    """Queries (query_id, v, dim, floor) by the shards that they ask: one of the likeliest cell first, then the others of all cells whose bound isn't below the floor."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)

    def route(batches):
        for batch in batches:
            for dim, rows in _by_dim(batch):
                cell, salts, centres, radii = shared.value[dim]
                points = _matrix(rows.column("v"), dim).astype(float)
                ids = rows.column("query_id").to_numpy()
                likeliest = (points @ centres.T).argmax(1)
                own = ids % salts[likeliest]  # the salt of the shard that is asked first
                if first:
                    row, col, salt = np.arange(len(ids)), likeliest, own
                else:
                    bounds = ball_bounds(points, centres, radii)
                    row, col = np.nonzero(bounds >= rows.column("floor").fill_null(NONE).to_numpy()[:, None])
                    times = salts[col]
                    salt = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    row, col = np.repeat(row, times), np.repeat(col, times)
                    new = (col != likeliest[row]) | (salt != own[row])
                    row, col, salt = row[new], col[new], salt[new]
                kept = rows.take(pa.array(row))
                yield kept.append_column("cell", pa.array(cell[col], pa.int32())).append_column("salt", pa.array(salt, pa.int32())).append_column("salts", pa.array(salts[col], pa.int32()))

    return queries.mapInArrow(route, "query_id bigint, v array<bigint>, dim int, floor bigint, cell int, salt int, salts int")


def found(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """The k best of each query in each shard that it asked: query_id, vec_id, score; rows without vec_id say how many vectors were scored."""
    usable = vectors.where(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).select("vec_id", "v")
    usable = usable.groupBy("vec_id", "v").agg(F.lit(1).alias("_one")).drop("_one")
    usable = materialise(placed(usable.withColumn("q", F.coalesce(is_query, F.lit(False)))), "vectors")
    shards = materialise(index(usable), "shards")
    cells: dict[int, list] = {}
    for r in balls(shards).collect():  # at most 2**LEVELS rows a vector length
        cells.setdefault(r["dim"], []).append((r["cell"], r["salts"], r["centre"], r["radius"]))
    cells = {d: (np.array([c[0] for c in own]), np.array([c[1] for c in own]), np.array([c[2] for c in own], float).reshape(len(own), d), np.array([c[3] for c in own])) for d, own in cells.items()}
    queries = usable.where("q").select(F.col("vec_id").alias("query_id"), "v", "dim", F.lit(None).cast("bigint").alias("floor"))
    first = materialise(_meet(shards, materialise(_routed(queries, cells, True), "asked-first"), k), "first")
    floors = first.where("vec_id is not null").groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    rest = queries.join(floors, "query_id", "left").select("query_id", "v", "dim", F.col("least").alias("floor"))
    return first.union(_meet(shards, materialise(_routed(rest, cells, False), "asked"), k))


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """vectors (vec_id, v array<bigint> or null): for each row with is_query, its k best others: query_id, rank, vec_id, score."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    hits = found(vectors, is_query, k).where("vec_id is not null")
    ranked = hits.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= k)
