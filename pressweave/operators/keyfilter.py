"""A filter of fixed size over the keys of a table of any size.

Before a text is cut into every n-gram or substring, most of them can be ruled out: a
bit table says of each hash whether some key may have it.  The table is worked out by
Spark when the query runs (a scalar subquery), so nothing happens while a plan is
built, and its size does not depend on the number of keys: more keys only let more
pass, and the join behind decides.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTER_BITS = 22
PIECE = 256


def key_filter(hashes: DataFrame, bits: int = FILTER_BITS) -> Column:
    """The bit table of the hashes (a one-column DataFrame of longs), as a Column for any query."""
    name = hashes.columns[0]
    slot = F.pmod(F.col(name), F.lit(1 << bits))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col(name), F.lit(64)).cast("int"))
    held = hashes.select(F.call_function("shiftright", slot, F.lit(6)).alias("part"), bit.alias("bit")).groupBy("part").agg(F.bit_or("bit").alias("bits"))
    parts = hashes.sparkSession.range(0, 1 << (bits - 6), 1, 1).toDF("part").join(held, "part", "left")
    row = F.struct("part", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return parts.agg(F.transform(F.sort_array(F.collect_list(row)), lambda p: p["bits"]).alias("bits")).scalar()


def may_hold(table: Column, hashed: Column, bits: int = FILTER_BITS) -> Column:
    """False only for a hash that is not among the filter's."""
    part = F.call_function("shiftright", F.pmod(hashed, F.lit(1 << bits)), F.lit(6)).cast("int")
    return F.getbit(F.get(table, part), F.pmod(hashed, F.lit(64)).cast("int")) == 1


def distinct_values(df: DataFrame, c: Column) -> Column:
    """The distinct values of a column that has few (lengths), sorted, as one array; worked out when the query runs."""
    return df.agg(F.sort_array(F.collect_set(c)).alias("values")).scalar()


def substrings_of(df: DataFrame, text: str, lengths: Column, into: str) -> DataFrame:
    """A row for every substring of ``text`` that has one of the lengths; texts are cut into pieces first, as long ones are slow to index."""
    keep = df.columns
    n = F.length(text)
    sized = df.select("*", F.explode(lengths).alias("_len")).filter(F.col("_len") <= n)
    starts = sized.select("*", F.explode(F.sequence(F.lit(1), n - F.col("_len") + 1, F.lit(PIECE))).alias("_from"))
    pieces = starts.select(*keep, "_len", F.substring(F.col(text), F.col("_from"), F.col("_len") + (PIECE - 1)).alias("_piece"))
    places = pieces.select(*keep, "_len", "_piece", F.explode(F.sequence(F.lit(1), F.length("_piece") - F.col("_len") + 1)).alias("_at"))
    return places.select(*keep, F.substring(F.col("_piece"), F.col("_at"), F.col("_len")).alias(into))
