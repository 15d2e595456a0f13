"""Keep-first and per-group limits.

``row_number() <= k`` is planned with a partial group limit before the shuffle,
so each task sends at most k rows per key: a key that holds a third of all rows
does not load one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(df: DataFrame, keys: list, order: list, k: int = 1, rank_column: str | None = None) -> DataFrame:
    """The first k rows of every group, in an explicit order."""
    name = rank_column or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= k)
    return ranked if rank_column else ranked.drop(name)


def keep_first(df: DataFrame, key: Column, order: list) -> DataFrame:
    return first_per_group(df.withColumn("_key", key), ["_key"], order).drop("_key")


def dense_positions(df: DataFrame, group: str, order: str, position: str, block: int = 1_000_000) -> DataFrame:
    """0-based position of each row inside its group, by an integer order column unique in the group.

    Groups are cut into blocks of the order column, so no window sees more than
    ``block`` rows: the position is the rank in the block plus the rows in the
    blocks before it.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    sizes = blocked.groupBy(group, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_block").orderBy(order)
    return (blocked.withColumn("_rank", F.row_number().over(inside) - 1)
            .join(offsets, [group, "_block"])
            .withColumn(position, F.col("_offset") + F.col("_rank"))
            .drop("_block", "_rank", "_offset"))
