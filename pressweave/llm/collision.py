"""Approximate nearest neighbours by collision counting.

Every projection of a block's vectors is one sorted array.  A query opens a window
around its own projection in each of them; a vector that lies in enough windows is
verified on the original vectors.  As long as too few vectors are verified, the
windows grow by a factor around the same arrays (virtual rehashing).

Inner products become distances by one more coordinate, which brings all rows of a
block to the same length.  Blocks hold about 8,192 rows: in larger ones vectors whose
lengths differ much lose neighbours (recall 0.86 in one block of 16,384 normal vectors, 0.92 in two).
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressweave.llm.vectors import finite, search_in_blocks, topk

PROJECTIONS = 192
THRESHOLD = 0.895
WIDTH = 2.0
FACTOR = 1.25
VERIFY_SHARE = 0.01
SEED = 11
BLOCK_ROWS = 8_192


class CollisionIndex:
    """Sorted single projections of the vectors of one block."""

    def __init__(self, vectors: np.ndarray, projections: int = PROJECTIONS, seed: int = SEED):
        self.vectors = vectors
        squares = (vectors ** 2).sum(axis=1)
        longest = squares.max(initial=0) or 1.0
        level = np.column_stack([vectors, np.sqrt(np.maximum(longest - squares, 0))]) / np.sqrt(longest)
        self.axes = np.random.default_rng(seed).standard_normal((level.shape[1], projections))
        shown = level @ self.axes
        self.order = np.argsort(shown, axis=0, kind="stable").T.copy()
        self.sorted = np.take_along_axis(shown.T, self.order, axis=1)

    def windows(self, queries: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last place of each query's window in each sorted array."""
        own = queries @ self.axes[:-1]
        low = np.stack([np.searchsorted(s, own[:, j] - half) for j, s in enumerate(self.sorted)], axis=1)
        high = np.stack([np.searchsorted(s, own[:, j] + half, "right") for j, s in enumerate(self.sorted)], axis=1)
        return low, high

    def candidates(self, queries: np.ndarray, k: int, threshold: float = THRESHOLD, width: float = WIDTH, factor: float = FACTOR,
                   share: float = VERIFY_SHARE, own: np.ndarray | int = 0) -> list[np.ndarray]:
        """For queries of length one, the places of the vectors that collide with each often enough.

        ``own`` vectors of each query's id may be among them and do not count.
        """
        n, m = len(self.vectors), len(self.sorted)
        missing = m - int(np.ceil(threshold * m))
        target = np.broadcast_to(np.minimum(n, max(10 * k, share * n) + own), len(queries))
        out: list = [None] * len(queries)
        waiting, half = np.arange(len(queries)), width
        while len(waiting):
            lows, highs = self.windows(queries[waiting], half)
            still = []
            for i, low, high in zip(waiting, lows, highs):
                outside = np.zeros(n, np.uint16)
                for line, a, b in zip(self.order, low, high):
                    outside[line[:a]] += 1
                    outside[line[b:]] += 1
                out[i] = np.flatnonzero(outside <= missing)
                if len(out[i]) < target[i] and not (low == 0).all() & (high == n).all():
                    still.append(i)
            waiting, half = np.array(still, np.int64), half * factor
        return out


def collide(ids, data, query_ids, queries, floors, k):
    """The k best of the rows found for each query; windows miss rows, so none is measured against a floor."""
    rows, at, scores = [], [], []
    in_order = np.sort(ids)
    own = np.searchsorted(in_order, query_ids, "right") - np.searchsorted(in_order, query_ids)
    units = queries / np.linalg.norm(queries, axis=1)[:, None]
    for i, found in enumerate(CollisionIndex(data).candidates(units, k, own=own)):
        score = (data[found] * queries[i]).sum(axis=1)
        keep = ids[found] != query_ids[i]
        found, score = found[keep], score[keep]
        best = topk(score, ids[found], np.zeros(len(found), np.int64), k)
        rows.append(np.full(len(best), i))
        at.append(found[best])
        scores.append(score[best])
    return np.concatenate(at), np.concatenate(rows), np.concatenate(scores)


def nearest(rows: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): of the rows found for every query, the k largest inner products, ties to the smaller id.

    Vectors that are null, empty, zero or hold null or non-finite components take no
    part, nor do rows without an id; vectors of different lengths do not meet; an
    empty table gives no rows.  Every row is indexed and every score is worked out on the original vectors.
    A query has k rows wherever k others can meet it.
    """
    vec, identity = F.col(vector_column).cast("array<double>"), F.col(id_column).cast("long")
    good = rows.filter(finite(vec) & identity.isNotNull() & F.exists(vec, lambda x: x != 0)).withColumn("_asked", is_query)
    return search_in_blocks(good.select(identity.alias("id"), vec.alias("vec"), "_asked"), F.col("_asked"), k, collide, block_rows=BLOCK_ROWS, exact=False)
