"""Placement by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table; shards
take turns, each claiming the first free slot of its order.  A key is hashed to a
slot, and the slot names its shard: shards get equally many slots (but for one),
and a change of the shard list moves few keys.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressweave.functions.text import bind
from pressweave.llm.common import hash_number

SLOTS = 1619
MOST_SLOTS = 20_011


def key_number(key: Column) -> Column:
    """60 bits of MD5 as a number; any engine can recompute it."""
    return hash_number(F.md5(key.cast("binary")), 15)


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``slot`` and ``shard``, filled by turns; one row of bounded size is computed and spread out.

    ``slots`` must be a prime, larger than the number of shards (100 times it keeps
    shares within one percent) and at most ``MOST_SLOTS``.
    """
    if not 0 < len(shards) < slots <= MOST_SLOTS or any(slots % d == 0 for d in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("slots must be a prime between the number of shards and MOST_SLOTS")
    if len(set(shards)) < len(shards):
        raise ValueError("shard names must be unique")
    n, names = len(shards), F.array(*map(F.lit, shards))

    def preferences(shard: Column) -> Column:
        start = key_number(F.concat(F.lit("offset:"), shard)) % slots
        step = key_number(F.concat(F.lit("skip:"), shard)) % (slots - 1) + 1
        return bind(start, lambda a: bind(step, lambda b: F.transform(
            F.sequence(F.lit(0), F.lit(slots - 1)), lambda j: (a + j * b) % slots)))

    def claims(orders: Column) -> Column:
        """Slots in the order in which they are claimed."""
        return F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)), F.array().cast("array<bigint>"), lambda claimed, t: F.concat(
            claimed, F.slice(F.array_except(F.element_at(orders, t % n + 1), claimed), 1, 1)))

    one = spark.range(1).select(bind(F.transform(names, preferences), claims).alias("claims"))
    return one.select(F.posexplode("claims").alias("turn", "slot")).select(
        "slot", F.element_at(names, F.col("turn") % n + 1).alias("shard"))


def place(df: DataFrame, key: Column, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """Adds ``slot`` and ``shard``.

    The table has at most ``MOST_SLOTS`` rows, so it is broadcast; rows are not
    shuffled, whatever the keys.  A null key is placed like an empty one; equal keys
    meet in one shard.  Columns of the input named slot or shard are replaced.
    """
    placed = df.drop("slot", "shard").withColumn("slot", key_number(F.coalesce(key.cast("string"), F.lit(""))) % slots)
    return placed.join(F.broadcast(lookup_table(df.sparkSession, shards, slots)), "slot", "left")
