"""Mixing sources to target weights by capped water-filling.

Sources share a budget by weight; a source stops at its greatest number of epochs,
and what it cannot take is shared again by weight until nothing is above.  A source
is then sampled in whole repetitions and, for the fraction, by a seeded order: whole
documents up to the mark, and the part of one document that the mark cuts.
"""
from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressweave.llm.common import hash_number, importable
from pressweave.sources.tables import settle

WEIGHTS = (5, 2, 1)
SHARE, EPOCHS, SEED = 1.5, 2, "mix-1"
BUCKET_DOCS = 256
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """Adds ``target`` to rows of (source, size, weight).

    Every round shares what is left among the sources that are still open, by
    weight, and closes those that would get more than their cap; the rounds are
    one-row aggregates, at most one per source.
    """
    total = sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] * float(share)
    rows = sources.withColumn("_cap", F.col("size") * float(epochs))
    level = 0.0
    while True:
        full = F.col("_cap") < F.col("weight") * F.lit(level)
        spent, open_weight = rows.agg(F.coalesce(F.sum(F.when(full, F.col("_cap"))), F.lit(0.0)),
                                      F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        new = (total - spent) / open_weight if open_weight else level
        if new <= level:
            break
        level = new
    return rows.withColumn("target", F.least("_cap", F.col("weight") * F.lit(level))).drop("_cap")


def source_targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """(source, size, docs, weight, target): sources by code point, null last, with repeating weights.

    The table has one row per source; it is numbered in one window and stored.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    return water_fill(settle(sizes.withColumn("weight", weight), "sources"), share, epochs)


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
        weights=WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: str = SEED, with_row: bool = False) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): how many words of each row the mix takes.

    With ``with_row`` also ``row``, the whole row as a struct.

    A null or empty text has size 0 and nothing is taken of it; a null source is a
    source of its own, the last; repeated rows count each by itself; a null id is
    hashed like an empty one; an empty table gives no rows.  Only these three
    columns are read.  A source is cut into buckets of about ``BUCKET_DOCS``
    documents by hash, and the mark is set in each bucket, so a hot source does not
    meet in one window and the taken words miss the target by less than a word a bucket.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), word_count(F.col(text_column)).alias("size"),
                       *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if with_row else []))
    targets = source_targets(rows.drop("row"), weights, share, epochs).select(
        F.coalesce("source", F.lit("")).alias("_s"), F.isnull("source").alias("_n"), F.col("size").alias("source_size"), "docs", "target")
    joined = rows.join(targets, (F.coalesce(rows.source, F.lit("")) == F.col("_s")) & (F.isnull(rows.source) == F.col("_n"))).drop("_s", "_n")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    bucketed = joined.withColumns({"_order": order, "_buckets": F.ceil(F.col("docs") / BUCKET_DOCS)})
    bucketed = bucketed.withColumn("_bucket", hash_number(F.col("_order"), 8) % F.col("_buckets"))
    group = Window.partitionBy("source", "_bucket")
    upto = group.orderBy("_order", "size").rowsBetween(Window.unboundedPreceding, 0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    summed = bucketed.withColumns({"_all": F.sum("size").over(group), "_upto": F.sum("size").over(upto), "_rate": rate})
    mark = F.floor(F.col("_all") * (F.col("_rate") - F.floor("_rate")) + 0.5)
    extra = F.greatest(F.lit(0), F.least(F.col("size"), mark - F.col("_upto") + F.col("size")))
    return summed.select("doc_id", "source", "size", "source_size", "target",
                         (F.floor("_rate") * F.col("size") + extra).cast("long").alias("taken"), *(["row"] if with_row else []))


def leading_words(text: Column, words: Column) -> Column:
    """The text up to the end of its n-th word; null stays null."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series, counts: pd.Series) -> pd.Series:
        def one(text: str, n: int) -> str:
            ends = (m.end() for m in re.finditer(WORD, text, re.ASCII))
            return text[:next(end for i, end in enumerate(ends, 1) if i == n)]
        return pd.Series([None if t is None else one(t, int(n)) for t, n in zip(texts, counts)], dtype=object)
    return cut(text, words)


def mixed_documents(docs: DataFrame, text_column: str = "text", **parameters) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole repetitions as they are, fractional ones cut after their words."""
    importable(docs.sparkSession)
    shares = mix(docs, text_column=text_column, with_row=True, **parameters).filter("taken > 0").select("size", "taken", "row")
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), F.col("taken") % F.col("size")
    words = F.when(rest > 0, rest).otherwise(0)
    lengths = F.concat(F.array_repeat(F.lit(0).cast("long"), whole), F.when(rest > 0, F.array(words)).otherwise(F.array().cast("array<bigint>")))
    copies = shares.select("row", F.explode(lengths).alias("_words"))
    text = F.col(f"row.`{text_column}`")
    cut = copies.withColumn("_text", leading_words(F.when(F.col("_words") > 0, text), F.col("_words")))
    return cut.select(*[F.coalesce("_text", text).alias(c) if c == text_column else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
