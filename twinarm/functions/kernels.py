"""Graph kernels for one connected component, in numpy: its lowest eigenpairs, spectral clusters and greedy disjoint cliques."""

from __future__ import annotations

import heapq

import numpy as np


#: Nodes up to which all eigenpairs are computed; larger components get their lowest LOWEST, to RESIDUAL. Entries that a factor of the matrix may have.
DENSE, LOWEST, RESIDUAL, FACTOR = 500, 11, 1e-9, 40_000_000


class Component:
    """A connected component of the overlap graph in which reads of equal arms are one node with a multiplicity.

    Equal reads are joined to each other (by the greatest weight, 2) and to the same others, so the full graph's eigenvectors of L v = x D v (weighted Laplacian against unweighted
    degrees) are constant on such a node, or lie within one and add up to 0 there. The former come from the quotient's matrix, the latter have the value (s + 2) / d each,
    n - 1 times, where s and d are the weight and the number of a read's edges.
    """

    def __init__(self, counts: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray):
        self.m, self.n = np.asarray(counts, float), len(counts)
        self.a, self.b, self.weight = np.asarray(a, np.int64), np.asarray(b, np.int64), np.asarray(weight, float)
        outer = np.zeros(self.n)
        self.degree = self.m - 1
        for x, y in ((self.a, self.b), (self.b, self.a)):
            outer += np.bincount(x, self.weight * self.m[y], self.n)
            self.degree = self.degree + np.bincount(x, self.m[y], self.n)
        self.degree = np.maximum(self.degree, 1)
        root = np.sqrt(self.m / self.degree)
        self.diagonal, self.off = outer / self.degree, -self.weight * root[self.a] * root[self.b]
        self.scale = 1 / np.sqrt(self.m * self.degree)
        self.within = (outer + 2 * self.m) / self.degree

    def dense(self) -> np.ndarray:
        """The symmetric matrix whose eigenvalues are the quotient's."""
        full = np.diag(self.diagonal)
        full[self.a, self.b] = full[self.b, self.a] = self.off
        return full

    def times(self, x: np.ndarray) -> np.ndarray:
        """The matrix times the columns of x, edge by edge."""
        out = self.diagonal[:, None] * x
        for k in range(x.shape[1]):
            out[:, k] += np.bincount(self.a, self.off * x[self.b, k], self.n) + np.bincount(self.b, self.off * x[self.a, k], self.n)
        return out

    def levels(self) -> np.ndarray:
        """Distance of each node from one that lies far out; edges join nodes of equal or neighbouring levels."""
        order = np.argsort(np.concatenate([self.a, self.b]), kind="stable")
        to = np.concatenate([self.b, self.a])[order]
        first = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate([self.a, self.b]), minlength=self.n))])
        start = 0
        for _ in range(2):
            level = np.full(self.n, -1)
            level[start], front, far = 0, np.array([start]), 0
            while len(front):
                lengths = first[front + 1] - first[front]
                at = np.repeat(first[front] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
                near = to[at]
                start, far = int(front[0]), far + 1
                front = np.unique(near[level[near] < 0])
                level[front] = far
        return level

    def solver(self, shift: float):
        """A function that solves (matrix + shift) x = y, or None if a factor would be too large. Levels are joined to blocks, so the matrix is block tridiagonal."""
        level = self.levels()
        sizes = np.bincount(level)
        block_of, at, held = np.empty(len(sizes), np.int64), 0, 0
        for k, size in enumerate(sizes.tolist()):
            if held and held + size > 64:
                at, held = at + 1, 0
            block_of[k], held = at, held + size
        block = block_of[level]
        order = np.argsort(block, kind="stable")
        first = np.concatenate([[0], np.cumsum(np.bincount(block))])
        if int((np.diff(first) ** 2).sum()) * 2 > FACTOR:
            return None
        place = np.empty(self.n, np.int64)
        place[order] = np.arange(self.n)
        x, y = place[self.a], place[self.b]
        lo, hi, off = np.minimum(x, y), np.maximum(x, y), self.off
        by = np.argsort(block[order][lo], kind="stable")
        lo, hi, off = lo[by], hi[by], off[by]
        edge_at = np.searchsorted(block[order][lo], np.arange(at + 2))
        inverse, link, before = [], [], None
        for k in range(at + 1):
            s, e = first[k], first[k + 1]
            own = np.diag(self.diagonal[order[s:e]] + shift)
            i, j, v = (z[edge_at[k] : edge_at[k + 1]] for z in (lo, hi, off))
            inner = j < e
            own[i[inner] - s, j[inner] - s] = own[j[inner] - s, i[inner] - s] = v[inner]
            if before is not None:
                own -= before.T @ inverse[-1] @ before
            inverse.append(np.linalg.inv(own))
            if k < at:
                before = np.zeros((e - s, first[k + 2] - e))
                before[i[~inner] - s, j[~inner] - e] = v[~inner]
                link.append(before)

        def solve(rhs: np.ndarray) -> np.ndarray:
            z = rhs[order]
            for k in range(at):
                z[first[k + 1] : first[k + 2]] -= link[k].T @ (inverse[k] @ z[first[k] : first[k + 1]])
            for k in range(at, -1, -1):
                own = z[first[k] : first[k + 1]]
                if k < at:
                    own = own - link[k] @ z[first[k + 1] : first[k + 2]]
                z[first[k] : first[k + 1]] = inverse[k] @ own
            out = np.empty_like(z)
            out[order] = z
            return out

        return solve

    def lowest(self, count: int = LOWEST) -> tuple[np.ndarray, np.ndarray]:
        """The quotient's lowest eigenvalues and their vectors (columns, a value for each node's reads), all of them up to DENSE nodes.

        Where levels are narrow, as in a tiling, a subspace is iterated with the factored matrix; where they are wide, the graph is tight and a block Krylov space of the matrix itself,
        restarted from its best vectors, converges fast. No matrix of nodes by nodes is formed.
        """
        if self.n <= max(DENSE, 2 * count):
            values, vectors = np.linalg.eigh(self.dense())
        else:
            values, vectors = self._iterated(count)
        vectors = vectors * self.scale[:, None]
        lead = vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])]
        return values, vectors * np.where(lead < 0, -1, 1)

    def _iterated(self, count: int, rounds: int = 400, deep: int = 6) -> tuple[np.ndarray, np.ndarray]:
        x = np.random.default_rng(0).normal(size=(self.n, count + 13))
        x[:, 0] = 1 / self.scale  # the lowest one is known
        x, _ = np.linalg.qr(x)
        solve = self.solver(1e-10)
        for _ in range(rounds):
            if solve:
                basis, _ = np.linalg.qr(solve(x))
            else:
                blocks = [x]
                for _ in range(deep):
                    y = self.times(blocks[-1])
                    for _ in range(2):
                        for b in blocks:
                            y -= b @ (b.T @ y)
                    blocks.append(np.linalg.qr(y)[0])
                basis, _ = np.linalg.qr(np.hstack(blocks))
            moved = self.times(basis)
            values, turn = np.linalg.eigh(basis.T @ moved)
            turn = turn[:, : x.shape[1]]
            x, moved = basis @ turn, moved @ turn
            if np.linalg.norm(moved[:, :count] - x[:, :count] * values[:count], axis=0).max() <= RESIDUAL:
                break
        return values[:count], x[:, :count]

    def spectrum(self, values: np.ndarray, count: int | None = None) -> np.ndarray:
        """The full graph's eigenvalues in order (the lowest count), given the quotient's."""
        times = np.minimum(self.m - 1, count if count is not None else self.m).astype(np.int64)
        return np.sort(np.concatenate([values, np.repeat(self.within, times)]))[:count]


def cluster_count(values: np.ndarray, t: float, first: int = 10) -> int:
    """How many clusters the gaps between the lowest eigenvalues suggest."""
    gaps = np.diff(values[: first + 1])
    if len(gaps) <= 2:
        return 1
    if values[1] > 1 and values[1] >= 10 * np.median(gaps[1:]):
        return 2
    for i, gap in enumerate(gaps):
        base = np.median(gaps[:i]) if i else 1.0
        if gap >= t * base and (base > 0 or gap > 0):
            return i + 2
    return 1


def kmeans(points: np.ndarray, k: int, seed: int = 0, rounds: int = 100, weight: np.ndarray | None = None) -> np.ndarray:
    """Labels by Lloyd's algorithm from a seeded k-means++ start; the best of ten. A point of weight w counts as w points."""
    rng, best = np.random.default_rng(seed), None
    weight = np.ones(len(points)) if weight is None else weight

    def far(centres: np.ndarray) -> np.ndarray:
        return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)[None], 0)

    for _ in range(10):
        centres = points[[rng.choice(len(points), p=weight / weight.sum())]]
        while len(centres) < k:
            d = far(centres).min(1) * weight
            centres = np.vstack([centres, points[rng.choice(len(points), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(points))]])
        for _ in range(rounds):
            label = far(centres).argmin(1)
            held = np.bincount(label, weight, k)
            sums = np.stack([np.bincount(label, weight * points[:, c], k) for c in range(points.shape[1])], 1)
            moved = np.where(held[:, None] > 0, sums / np.maximum(held, 1e-300)[:, None], centres)
            if np.allclose(moved, centres):
                break
            centres = moved
        cost = (((points - centres[label]) ** 2).sum(1) * weight).sum()
        if best is None or cost < best[0] - 1e-12:
            best = (cost, label)
    return best[1]


def spectral(graph: Component, t: float, embedding: str = "columns") -> tuple[int, np.ndarray]:
    """(clusters, label of each node). embedding "columns" gives a node its entries in the first eigenvectors; "rows" the first rows of the matrix, which takes all of them.

    Equal reads share a label: of the first eigenvectors those that would tell them apart (a free choice of axes) are left out.
    """
    if graph.m.sum() <= 1:
        return 1, np.zeros(1, int)
    values, vectors = graph.lowest()
    every = graph.spectrum(values[:LOWEST], LOWEST)
    k = cluster_count(every, t)
    points = vectors[:, : max(1, int((values <= every[k - 1] + 1e-12).sum()))][:, :k]
    if embedding == "rows":
        if graph.n > DENSE:
            raise ValueError(f"embedding 'rows' takes all eigenvectors; this component has {graph.n} different reads, more than {DENSE}")
        points = vectors[: min(k, graph.n)].T
    if k == 1 or graph.n == 1:
        return k, np.zeros(graph.n, int)
    return k, kmeans(points, min(k, graph.n), weight=graph.m)


def _bits(mask: int):
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


class Cliques:
    """Disjoint maximal cliques of a component, the largest first (by reads), of equal ones the first by members.

    They are found one by one. Branch and bound goes over the nodes that are left; what is extended by a node already taken isn't maximal. A clique can't weigh more than the heaviest node of
    each colour class of what may still join it. What is left falls into pieces that don't touch; a piece's best clique stays its best until it is taken.
    """

    def __init__(self, graph: Component):
        self.weight = graph.m.astype(np.int64).tolist()
        self.near = [0] * graph.n
        for a, b in zip(graph.a.tolist(), graph.b.tolist()):
            self.near[a] |= 1 << b
            self.near[b] |= 1 << a

    def _pieces(self, open_: int):
        while open_:
            piece = grown = open_ & -open_
            while grown:
                reach = 0
                for v in _bits(grown):
                    reach |= self.near[v]
                grown = reach & open_ & ~piece
                piece |= grown
            yield piece
            open_ &= ~piece

    def _coloured(self, open_: int) -> tuple[list[int], list[int]]:
        """Nodes by colour class, and for each the most that a clique of it and those before it can weigh."""
        order, bound, total = [], [], 0
        while open_:
            rest, most = open_, 0
            while rest:
                v = (rest & -rest).bit_length() - 1
                rest &= ~(self.near[v] | 1 << v)
                open_ ^= 1 << v
                most = max(most, self.weight[v])
                order.append(v)
                bound.append(total + most)
            total += most
        return order, bound

    def _heaviest(self, piece: int, closed: int) -> int:
        """The weight of the heaviest clique in piece that is maximal when the nodes of closed count too; 0 if there is none."""
        best, stack = 0, [(0, piece, closed, *self._coloured(piece))]
        while stack:
            held, open_, shut, order, bound = stack[-1]
            if not order or held + bound[-1] <= best:
                stack.pop()
                continue
            v = order.pop()
            bound.pop()
            weight, inner, outer = held + self.weight[v], open_ & self.near[v], shut & self.near[v]
            stack[-1] = (held, open_ & ~(1 << v), shut | 1 << v, order, bound)
            if inner:
                stack.append((weight, inner, outer, *self._coloured(inner)))
            elif not outer and weight > best:
                best = weight
        return best

    def _first(self, piece: int, closed: int, goal: int) -> int:
        """Of the maximal cliques of weight goal the first by members, as bits. Nodes are tried in order, so cliques come up in order."""
        stack = [(0, 0, piece, closed, piece)]
        while stack:
            clique, held, open_, shut, todo = stack.pop()
            if not todo:
                continue
            v = (todo & -todo).bit_length() - 1
            bit = 1 << v
            if held + (self._coloured(open_)[1] or [0])[-1] < goal:
                continue
            stack.append((clique, held, open_ & ~bit, shut | bit, todo & ~bit))
            inner, outer = open_ & self.near[v], shut & self.near[v]
            if inner:
                stack.append((clique | bit, held + self.weight[v], inner, outer, inner))
            elif not outer and held + self.weight[v] == goal:
                return clique | bit
        raise AssertionError("no clique of a weight that was found")

    def cover(self) -> np.ndarray:
        """Labels in order of choice; -1 for nodes that are left over."""
        label, n = np.full(len(self.near), -1), len(self.near)
        taken, k, heap = 0, 0, []

        def offer(open_: int) -> None:
            for piece in self._pieces(open_):
                touching = 0
                for v in _bits(piece):
                    touching |= self.near[v]
                closed = touching & taken
                if goal := self._heaviest(piece, closed):
                    clique = self._first(piece, closed, goal)
                    heapq.heappush(heap, (-goal, tuple(_bits(clique)), clique, piece))

        offer((1 << n) - 1)
        while heap:
            _, members, clique, piece = heapq.heappop(heap)
            label[list(members)] = k
            taken |= clique
            k += 1
            offer(piece & ~clique)
        return label
