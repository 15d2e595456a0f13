"""Connected components of a link table, by alternating star contractions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressweave.llm.common import settled


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node of its component, for every node of a link; loops and null ends are ignored.

    Each round points every node at the smallest node in its neighbourhood, first
    from larger to smaller and then among the smaller ones.  A round is two
    aggregates and two joins; the side that is joined to is unique, so adaptive
    execution splits a hub.  The table of each round is stored, which ends the lineage.
    """
    edges = settled(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
                    .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        edges = settled(small, "stars")
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
