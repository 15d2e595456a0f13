"""Hard negatives by Four-Russians scoring.

A candidate's whole numbers are cut into bit planes, and the planes into bytes, one
byte for eight dimensions.  For every group of eight dimensions an anchor has a table
of the sums of all 256 subsets of its components there.  A plane's part of an inner
product is then one lookup per byte, and the product is the sum of the planes' parts,
each shifted by its place.  Nothing is rounded.

Rows are dealt to blocks of bounded size; an anchor block meets a candidate block in
one group, first within parts that hold whole labels for the positives, then within all rows.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressweave.llm.common import importable, settled
from pressweave.llm.vectors import finite
from pressweave.operators.dedup import first_per_group

GROUP = 8
BLOCK_ROWS = 8_192
ANCHOR_ROWS = 2_048
TABLE_ANCHORS = 64
CHUNK_ROWS = 1_024
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95


class Planes:
    """The packed bit planes of whole-number vectors (one row each): value = sum of 2^plane * bit, plus ``least``."""

    def __init__(self, values: np.ndarray):
        self.rows, self.dims = values.shape
        groups = math.ceil(self.dims / GROUP)
        self.least = int(values.min(initial=0))
        above = (values - np.int64(self.least)).view(np.uint64)  # differences of 64-bit numbers fit unsigned
        self.count = int(above.max(initial=0)).bit_length()
        self.bytes = np.empty((self.count, groups, self.rows), np.uint8)
        padded = np.zeros((self.rows, groups * GROUP), np.uint64)
        padded[:, :self.dims] = above
        for plane in range(self.count):
            bits = (padded >> np.uint64(plane) & np.uint64(1)).astype(np.uint8)
            self.bytes[plane] = np.packbits(bits, axis=1, bitorder="little").T


def subset_sums(anchors: np.ndarray, dtype=np.int64) -> np.ndarray:
    """(groups, 256, anchors): for each group of eight dimensions and each byte, the sum of the components whose bit is set."""
    n, dims = anchors.shape
    groups = math.ceil(dims / GROUP)
    padded = np.zeros((groups * GROUP, n), dtype)
    padded[:dims] = anchors.T
    sums = np.zeros((groups, 1 << GROUP, n), dtype)
    for bit in range(GROUP):
        sums[:, 1 << bit:2 << bit] = sums[:, :1 << bit] + padded[bit::GROUP][:, None]
    return sums


def fits(anchors: np.ndarray, planes: Planes) -> bool:
    """Whether every partial sum of these products fits 32 bits."""
    widest = np.abs(anchors.astype(float)).sum(axis=1).max(initial=0)
    return widest * 2.0 ** planes.count < 2 ** 30 and widest * abs(planes.least) < 2 ** 30


def products(sums: np.ndarray, totals: np.ndarray, planes: Planes, start: int, stop: int) -> np.ndarray:
    """(rows, anchors): the inner products of candidates ``start`` to ``stop`` with the anchors of the tables."""
    out = np.repeat((totals * planes.least).astype(sums.dtype)[None], stop - start, axis=0)
    part, looked = np.empty_like(out), np.empty_like(out)
    for plane in range(planes.count):
        part[:] = 0
        for table, place in zip(sums, planes.bytes[plane, :, start:stop]):
            np.take(table, place, axis=0, out=looked, mode="clip")
            part += looked
        part <<= plane
        out += part
    return out


def each_product(candidates: np.ndarray, anchors: np.ndarray):
    """(first anchor, first candidate, scores[candidates, anchors]) by chunks of bounded size, all candidates of some anchors first."""
    planes = Planes(candidates)
    for a in range(0, len(anchors), TABLE_ANCHORS):
        some = anchors[a:a + TABLE_ANCHORS]
        sums = subset_sums(some, np.int32 if fits(some, planes) else np.int64)
        totals = some.sum(axis=1)
        for c in range(0, planes.rows, CHUNK_ROWS):
            yield a, c, products(sums, totals, planes, c, min(c + CHUNK_ROWS, planes.rows)).astype(np.int64)


def first_of_rows(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each group: highest score, then smallest id."""
    order = np.lexsort((ids, -score, group))
    ordered = group[order]
    return order[np.arange(len(order)) - np.searchsorted(ordered, ordered) < k]


@dataclass
class Block:
    """Rows of a block: ids, labels as numbers, and vectors; each id's other rows are no partners of it."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray

    def alike(self, anchors: Block, a: int, c: int, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Whether candidate and anchor have one label, and whether they have different ids."""
        rows, own = slice(c, c + shape[0]), slice(a, a + shape[1])
        return (self.labels[rows, None] == anchors.labels[None, own], self.ids[rows, None] != anchors.ids[None, own])


def blocks_of(mine: pd.DataFrame, others: pd.DataFrame) -> tuple[Block, Block]:
    codes, _ = pd.factorize(pd.concat([mine["label"], others["label"]]))
    return (Block(mine["id"].to_numpy(), codes[:len(mine)], np.stack(mine["vec"])),
            Block(others["id"].to_numpy(), codes[len(mine):], np.stack(others["vec"])))


def positives_of(anchors: Block, block: Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor place, candidate place, score) of the k best others of each anchor's label in a block."""
    least = np.full(len(anchors.ids), np.iinfo(np.int64).min)
    done, best, at = [], (np.empty(0, np.int64),) * 3, 0
    for a, c, scores in each_product(block.vectors, anchors.vectors):
        if a != at:
            done.append(best)
            best, at = (np.empty(0, np.int64),) * 3, a
        same, apart = block.alike(anchors, a, c, scores.shape)
        place, group = np.nonzero(same & apart & (scores >= least[a:a + scores.shape[1]]))
        merged = [np.concatenate(x) for x in zip(best, (a + group, c + place, scores[place, group]))]
        top = first_of_rows(merged[0], merged[2], block.ids[merged[1]], k)
        best = tuple(x[top] for x in merged)
        full, first, n = np.unique(best[0], return_index=True, return_counts=True)
        least[full[n == k]] = best[2][(first + n - 1)[n == k]]
    return tuple(np.concatenate(x) for x in zip(*done, best))


def negatives_of(anchors: Block, block: Block, positive_scores, k: int, low: int, high: int) -> tuple[np.ndarray, ...]:
    """(anchor place, positive place, candidate place, score): the first k of other labels between ``low`` and ``high`` per cent of each positive.

    ``positive_scores`` is a masked array with one row per anchor.
    """
    found: list[tuple] = [(np.empty(0, np.int64),) * 4]
    slots, ends = positive_scores.shape[1], np.iinfo(np.int64)
    floor, roof = -(-low * positive_scores // 100), high * positive_scores // 100
    for a, c, scores in each_product(block.vectors, anchors.vectors):
        own = slice(a, a + scores.shape[1])
        same, apart = block.alike(anchors, a, c, scores.shape)
        inside = (scores >= floor[own].min(axis=1).filled(ends.max)) & (scores <= roof[own].max(axis=1).filled(ends.min))
        place, group = np.nonzero(inside & ~same & apart)
        score = scores[place, group]
        for slot in range(slots):
            ok = np.ma.filled((score >= floor[own][group, slot]) & (score <= roof[own][group, slot]), False)
            g, p, s = group[ok], place[ok], score[ok]
            top = first_of_rows(g, s, block.ids[c + p], k)
            found.append((a + g[top], np.full(len(top), slot), c + p[top], s[top]))
    group, slot, place, score = (np.concatenate(x) for x in zip(*found))
    top = first_of_rows(group * slots + slot, score, block.ids[place], k)
    return group[top], slot[top], place[top], score[top]


def hard_negatives(rows: DataFrame, is_anchor: Column, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_rows: int = BLOCK_ROWS,
                   anchor_rows: int = ANCHOR_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) by inner products of whole-number vectors.

    An anchor's positives are its first ``positives`` other rows of its label (highest
    score, then smallest id).  For each, ``rank`` counts the first ``negatives`` rows of
    other labels whose score lies between ``low`` and ``high`` per cent of the
    positive's; a positive without any gives no row.

    Vectors are arrays of whole numbers; products are sums of 64-bit numbers (they
    wrap where they do not fit).  Rows with a null id, label, vector or component, or
    an empty vector, take no part.  Rows that repeat id, label and vector count once;
    other rows of an anchor's id are not its positives or negatives, and every
    distinct row of an anchor's id looks for partners by itself.  Vectors of different
    lengths do not meet; an empty table gives no rows; other columns are not read.

    Labels are dealt to parts of about ``block_rows`` rows, a larger label is a part
    of its own, and a part's rows to blocks by a hash of the whole row: a hot label or
    id spreads over many groups, and many small labels share one.
    """
    spark = rows.sparkSession
    importable(spark)
    data = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).cast("string").alias("label"),
                       F.col(vector_column).cast("array<bigint>").alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("asked"))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda x: x.isNull())
    data = data.filter(good).distinct().withColumn("row", F.xxhash64("id", "label", "vec")).withColumn("size", F.size("vec"))
    data = settled(data, "rows")

    def counted(df: DataFrame, *keys: str) -> DataFrame:
        """Rows and anchors of each key and length of vectors, where there is an anchor."""
        return df.groupBy("size", *keys).agg(F.sum("rows").alias("rows"), F.sum("anchors").alias("anchors")).filter("anchors > 0")

    labels = settled(counted(data.withColumn("rows", F.lit(1)).withColumn("anchors", F.col("asked").cast("int")), "label"), "labels")
    bins = F.greatest(F.ceil(F.sum("rows").over(Window.partitionBy("size")) / block_rows), F.lit(1))
    labels = labels.withColumn("part", F.when(F.col("rows") > block_rows, F.concat(F.lit("label "), "label"))
                               .otherwise(F.concat(F.lit("bin "), F.pmod(F.xxhash64("label"), bins).cast("string"))))
    labels = settled(labels, "labels")
    inner = data.join(labels.select("size", "label", "part"), ["size", "label"])

    def met(mine: DataFrame, others: DataFrame, sizes: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame, list[str]]:
        """Both sides dealt to blocks of their own, with a copy for every block of the other side."""
        plan = settled(sizes.select("size", *keys, F.ceil(F.col("rows") / block_rows).cast("int").alias("_blocks"),
                                    F.ceil(F.col("anchors") / anchor_rows).cast("int").alias("_sets")), "plan")

        def dealt(df: DataFrame, own: str, count: str, other: str, copies: str) -> DataFrame:
            placed = df.join(plan, ["size", *keys]).withColumn(own, F.pmod(F.col("row"), F.col(count)).cast("int"))
            placed = placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(copies) - 1))).drop("_blocks", "_sets")
            return placed.toDF(*placed.columns)  # columns of its own, as both sides come from one table

        return (dealt(mine, "_set", "_sets", "_block", "_blocks"), dealt(others, "_block", "_blocks", "_set", "_sets"), ["size", *keys, "_block", "_set"])

    def near(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(others):
            return pd.DataFrame({"row": [], "anchor_id": [], "positive_id": [], "positive_score": []})
        anchors, block = blocks_of(mine, others)
        group, place, score = positives_of(anchors, block, positives)
        return pd.DataFrame({"row": mine["row"].to_numpy()[group], "anchor_id": anchors.ids[group], "positive_id": block.ids[place], "positive_score": score})

    columns = ["id", "label", "vec", "size", "row"]
    mine, others, keys = met(inner.filter("asked").select(*columns, "part"), inner.select(*columns, "part"), counted(labels, "part"), "part")
    same = mine.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInPandas(
        lambda a, b: near(a, b), "row long, anchor_id long, positive_id long, positive_score long")
    first = first_per_group(same, ["anchor_id", "row"], [F.desc("positive_score"), "positive_id"], positives, "_place")
    # at most ``positives`` entries for each row of an anchor
    wanted = first.groupBy(F.col("anchor_id").alias("id"), "row").agg(F.array_sort(F.collect_list(F.struct("_place", "positive_id", "positive_score"))).alias("_p"))
    wanted = settled(data.filter("asked").join(wanted, ["id", "row"]).select(*columns, F.col("_p.positive_id").alias("positive_ids"),
                                                                             F.col("_p.positive_score").alias("positive_scores")), "positives")

    def far(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        names = ["row", "anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        if not len(mine) or not len(others):
            return pd.DataFrame({name: [] for name in names})
        anchors, block = blocks_of(mine, others)
        scores, chosen = np.ma.masked_all((len(mine), positives), np.int64), np.zeros((len(mine), positives), np.int64)
        for i, (known, which) in enumerate(zip(mine["positive_scores"], mine["positive_ids"])):
            scores[i, :len(known)], chosen[i, :len(known)] = known, which
        group, slot, place, score = negatives_of(anchors, block, scores, negatives, low, high)
        return pd.DataFrame({"row": mine["row"].to_numpy()[group], "anchor_id": anchors.ids[group], "positive_id": chosen[group, slot],
                             "positive_score": scores.data[group, slot], "negative_id": block.ids[place], "negative_score": score})[names]

    every = counted(data.withColumn("rows", F.lit(1)).withColumn("anchors", F.col("asked").cast("int")))
    mine, others, keys = met(wanted, data.select(*columns), every)
    other = mine.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInPandas(
        lambda a, b: far(a, b), "row long, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    best = first_per_group(other, ["anchor_id", "row", "positive_id", "positive_score"], [F.desc("negative_score"), "negative_id"], negatives, "rank")
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def whole_numbers(vector: Column, factor: int) -> Column:
    """floor(factor * x) of every component in double precision; null for a vector with a null or non-finite component."""
    return F.when(finite(vector), F.transform(vector, lambda x: F.floor(factor * x.cast("double"))))
