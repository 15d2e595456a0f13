"""Searches of a query set against all rows, in blocks.

Rows are dealt to blocks of bounded size by a hash of id and vector, so hot ids and
clusters spread; every (query block, data block) pair is one group.  For an exact search each
query carries a floor, its k-th best score within a bounded sample of the rows: no
row below it can be among its k best, so a block sends only what may count.  A search
that may miss rows has no floor: its k best found rows may lie below any true score.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressweave.llm.common import importable
from pressweave.operators.dedup import first_per_group

BLOCK_ROWS = 16_384
SAMPLE_ROWS = 4_096
HITS = "query_id long, vec_id long, score double"


def finite(vector: Column) -> Column:
    """Vectors that are not null and hold only finite numbers."""
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return vector.isNotNull() & good


def topk(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row (highest score, then smallest id), row by row."""
    order = np.lexsort((ids, -scores, rows))
    first = np.searchsorted(rows[order], rows[order])
    return order[np.arange(len(order)) - first < k]


def floors(queries: DataFrame, sample: DataFrame, k: int, rows: int) -> DataFrame:
    """Adds ``floor`` to queries (id, vec): the k-th best inner product with a sample of the data of at most ``rows`` rows."""
    chosen = sample.orderBy(F.xxhash64("id", F.lit("sample")), "id").limit(rows).toPandas()
    by_size = {n: (g["id"].to_numpy(), np.stack(g["vec"])) for n, g in chosen.groupby(chosen["vec"].map(len))}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, vec in zip(batch["id"], batch["vec"]):
                ids, others = by_size.get(len(vec), (np.empty(0), np.empty((0, len(vec)))))
                scores = (others @ vec)[ids != i]
                out.append(np.partition(scores, -k)[-k] if len(scores) >= k else -np.inf)
            slack = 1e-9 * np.array([1 + abs(f) if np.isfinite(f) else 0 for f in out])
            yield batch.assign(floor=np.array(out) - slack)

    return queries.mapInPandas(run, "id long, vec array<double>, floor double")


def search_in_blocks(data: DataFrame, is_query: Column, k: int, search: Callable, block_rows: int = BLOCK_ROWS,
                     sample_rows: int = SAMPLE_ROWS, exact: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows of every query; data has id and vec (doubles).

    ``search(ids, vectors, query_ids, query_vectors, floors, k)`` gives the rows,
    query places and scores found in one pair of blocks.  Only vectors of one
    length meet.  Rows that repeat an id are not candidates of each other.  Only an
    ``exact`` search gets floors; those of others are -inf.
    """
    spark = data.sparkSession
    importable(spark)
    n, nq = data.agg(F.count(F.lit(1)), F.count(F.when(is_query, 1))).first()
    n_blocks, q_blocks = max(1, math.ceil(n / block_rows)), max(1, math.ceil(nq / block_rows))
    asked = data.filter(is_query).select("id", "vec")
    queries = floors(asked, data.select("id", "vec"), k, sample_rows) if exact else asked.withColumn("floor", F.lit(float("-inf")))
    keys = ["size", "block", "query_block"]
    left = data.select("id", "vec", F.size("vec").alias("size"), F.pmod(F.xxhash64("id", "vec", F.lit("row")), F.lit(n_blocks)).alias("block"),
                       F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("query_block"))
    right = queries.select("id", "vec", "floor", F.size("vec").alias("size"),
                           F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"),
                           F.pmod(F.xxhash64("id", "vec", F.lit("query")), F.lit(q_blocks)).cast("int").alias("query_block"))

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        ids, query_ids = rows["id"].to_numpy(), asked["id"].to_numpy()
        at, place, scores = search(ids, np.stack(rows["vec"]), query_ids, np.stack(asked["vec"]), asked["floor"].to_numpy(), k)
        return pd.DataFrame({"query_id": query_ids[place], "vec_id": ids[at], "score": scores})

    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda rows, asked: run(rows, asked), HITS)
    return first_per_group(hits, ["query_id"], [F.desc("score"), "vec_id"], k, "rank").select("query_id", "rank", "vec_id", "score")
