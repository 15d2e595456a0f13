"""Dictionaries kept as tables of any size: persons and organisations as rows of matching terms.

They stay tables: matching, attributes and badges are joins.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressweave.functions.text import norm_text
from pressweave.operators.match import MIN_ALIAS


def longest_first(name: Column, order: Column) -> Column:
    """A rank by which longer names come first, and of equal lengths the one with the smaller order."""
    return (F.lit(1 << 20) - F.length(name)).cast("long") * F.lit(1 << 40) + order.cast("long")


def entity_term_rows(entities: DataFrame) -> DataFrame:
    """(name, aliases, ord) as (rank, term, canonical): normalised spellings, ranked by the name they stand for."""
    spelled = entities.select(longest_first(F.col("name"), F.col("ord")).alias("rank"), F.col("name").alias("canonical"),
                              norm_text(F.col("name")).alias("own"),
                              F.explode_outer(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.lit(""))).alias("alias"))
    alias = norm_text(F.col("alias"))
    terms = spelled.select("rank", F.when(F.col("alias") == "", F.col("own")).when(F.length(alias) >= MIN_ALIAS, alias).alias("term"), "canonical")
    return terms.filter("term <> ''").distinct()


def org_term_rows(aliases: DataFrame) -> DataFrame:
    """(alias, canonical, ord) as (rank, term, canonical): aliases as written, longest first."""
    return aliases.filter(F.trim("alias") != "").select(
        longest_first(F.col("alias"), F.col("ord")).alias("rank"), F.col("alias").alias("term"), "canonical")
