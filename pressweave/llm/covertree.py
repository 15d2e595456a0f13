"""Exact search for the largest inner products with two cover trees.

A node is a center and a covering radius; its children are centers found farthest
first, so they are as far apart as their radius reaches.  Queries and data are both
indexed.  A pair of nodes is pruned when even the best inner product that the two
radii allow is below the worst k-th score of the query node's queries.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressweave.llm.vectors import finite, search_in_blocks, topk

LEAF, QUERY_LEAF, FAN = 1024, 128, 8


class Tree:
    """Arrays of nodes over a permutation of the points: ``center``, ``radius``, ``items`` (leaves), ``children``."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        self.points, self.leaf, self.fan = points, leaf, fan
        self.center, self.radius, self.items, self.children, self.parent = [], [], [], [], []
        self.norm = np.zeros(0)
        stack = [(np.arange(len(points)), -1)]
        while stack:
            members, parent = stack.pop()
            node = self.add(members, parent)
            if len(members) > leaf:
                stack += [(part, node) for part in self.split(members, node)]
            else:
                self.items[node] = members
        self.center, self.radius = np.array(self.center), np.array(self.radius)
        self.norm = np.linalg.norm(self.center, axis=1)

    def add(self, members: np.ndarray, parent: int) -> int:
        own = self.points[members]
        center = own[np.argmin(((own - own.mean(axis=0)) ** 2).sum(axis=1))]
        self.center.append(center)
        self.radius.append(float(np.sqrt(((own - center) ** 2).sum(axis=1).max())))
        self.items.append(None)
        self.children.append([])
        self.parent.append(parent)
        if parent >= 0:
            self.children[parent].append(len(self.center) - 1)
        return len(self.center) - 1

    def split(self, members: np.ndarray, node: int) -> list[np.ndarray]:
        """By the nearest of ``fan`` centers, each the point farthest from those before; copies of one point by number."""
        own = self.points[members]
        nearest = np.sqrt(((own - self.center[node]) ** 2).sum(axis=1))
        owner = np.zeros(len(members), np.int64)
        if nearest.max() == 0:
            return np.array_split(members, min(self.fan, -(-len(members) // self.leaf)))
        for child in range(1, self.fan):
            far = int(np.argmax(nearest))
            if nearest[far] == 0:
                break
            distance = np.sqrt(((own - own[far]) ** 2).sum(axis=1))
            closer = distance < nearest
            owner[closer], nearest[closer] = child, distance[closer]
        return [part for child in range(self.fan) if len(part := members[owner == child])]


class Search:
    """Best k of every query, kept per leaf of the query tree."""

    def __init__(self, ids, data, query_ids, queries, floors, k):
        self.ids, self.query_ids, self.k = ids, query_ids, k
        self.data, self.queries = Tree(data), Tree(queries, QUERY_LEAF)
        largest = max(np.abs(data).max(initial=0), np.abs(queries).max(initial=0))
        whole = bool((data == np.floor(data)).all() and (queries == np.floor(queries)).all())
        self.exact = whole and largest ** 2 * data.shape[1] >= 2 ** 53
        self.kth = floors.astype(float).copy()
        self.found = {q: (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)) for q, m in enumerate(self.queries.items) if m is not None}
        self.worst = np.array([self.kth[m].min() if m is not None else -np.inf for m in self.queries.items])
        for q in reversed(range(len(self.worst))):
            self.raise_worst(q)

    def raise_worst(self, q: int) -> None:
        if self.queries.items[q] is None:
            self.worst[q] = self.worst[self.queries.children[q]].min()

    def bounds(self, qs: list[int], ds: list[int]) -> np.ndarray:
        """The largest inner product that points of the nodes can have, query nodes by data nodes."""
        q, d = self.queries, self.data
        rq, rd = q.radius[qs][:, None], d.radius[ds][None]
        best = q.center[qs] @ d.center[ds].T + q.norm[qs][:, None] * rd + d.norm[ds][None] * rq + rq * rd
        return best + 1e-9 * (1 + np.abs(best))

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        stack = [(0, 0, np.inf)]
        while stack:
            q, d, bound = stack.pop()
            if bound < self.worst[q]:
                continue
            q_open, d_open = self.queries.children[q], self.data.children[d]
            if not q_open and not d_open:
                self.compare(q, d)
                continue
            split_query = q_open and (not d_open or self.queries.radius[q] >= self.data.radius[d])
            qs, ds = (q_open, [d]) if split_query else ([q], d_open)
            best = self.bounds(qs, ds)
            pairs = [(x, y, best[i, j]) for i, x in enumerate(qs) for j, y in enumerate(ds)]
            stack += sorted(pairs, key=lambda p: p[2])
        rows, at, scores = (np.concatenate(parts) for parts in zip(*self.found.values()))
        return at, rows, scores

    def compare(self, q: int, d: int) -> None:
        asked, members = self.queries.items[q], self.data.items[d]
        a, b = self.queries.points[asked], self.data.points[members]
        scores = (a.astype(np.int64) @ b.astype(np.int64).T).astype(float) if self.exact else a @ b.T
        keep = (scores >= self.kth[asked][:, None]) & (self.ids[members][None] != self.query_ids[asked][:, None])
        i, j = np.nonzero(keep)
        if not len(i):
            return
        rows, at, old = self.found[q]
        rows, at, new = np.concatenate([rows, asked[i]]), np.concatenate([at, members[j]]), np.concatenate([old, scores[i, j]])
        best = topk(new, self.ids[at], rows, self.k)
        rows, at, new = rows[best], at[best], new[best]
        self.found[q] = rows, at, new
        last = np.flatnonzero(np.concatenate([rows[1:] != rows[:-1], [True]]))
        full = np.diff(np.concatenate([[-1], last])) == self.k
        self.kth[rows[last[full]]] = np.maximum(self.kth[rows[last[full]]], new[last[full]])
        self.worst[q] = self.kth[asked].min()
        while (q := self.queries.parent[q]) >= 0:
            self.raise_worst(q)


def dual_tree(ids, data, query_ids, queries, floors, k):
    return Search(ids, data, query_ids, queries, floors, k).run()


def top_inner_products(rows: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of every query with the other rows, ties to the smaller id.

    Vectors that are null, empty or hold null or non-finite components take no part,
    nor do rows without an id; vectors of different lengths do not meet; an empty
    table gives no rows.  Scores are doubles; on whole numbers they are exact up to 2^53.
    """
    vec, identity = F.col(vector_column).cast("array<double>"), F.col(id_column).cast("long")
    good = rows.filter(finite(vec) & identity.isNotNull() & (F.size(vec) > 0)).withColumn("_asked", is_query)
    return search_in_blocks(good.select(identity.alias("id"), vec.alias("vec"), "_asked"), F.col("_asked"), k, dual_tree)
