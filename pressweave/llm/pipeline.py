"""A corpus pipeline of four stages; each stage's result is stored and read again as the next one's documents.

Language identification drops what has no language, near-duplicate groups keep one
document, sources are mixed to their targets, and the mix is packed into windows.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressweave.llm import langid, mixing, packing, parity_join
from pressweave.llm.common import importable, settled
from pressweave.operators.dedup import first_per_group

UNDECIDED_CHARS = 200
LEARNT_BYTES = 12 << 20  # beside what earlier stages leave in a worker
DECIDED = ("_lang_pred", "_lang_score", "_lang_ambiguous", "_lang_runner_up")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go, and those of some length whose language stays ambiguous; a missing language is filled in."""
    learnt = docs.filter(~langid.held_out() & F.col("doc_id").isNotNull())
    decided = langid.identify(docs, langid.train(learnt), names=DECIDED)
    rejected = (F.col("_lang_pred") == langid.UNDETERMINED) | (F.col("_lang_ambiguous") & (F.length("text") >= UNDECIDED_CHARS))
    kept = decided.filter(~rejected).withColumn("lang", F.coalesce("lang", "_lang_pred"))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents that with the smallest id stays; a missing id comes last.

    Groups are of texts, not of ids: of two different texts under one id both stay if
    nothing links them.  Rows of one id and text count once; a text without a word
    links with nothing but its own repetition under the same id.
    """
    found = parity_join.components(docs)
    best = first_per_group(found, ["label"], [F.asc_nulls_last("doc_id"), "row"])
    rows = docs.withColumn("_row", parity_join.row_name("doc_id", "text"))
    kept = rows.join(best.select(F.col("row").alias("_row")), "_row", "left_semi")
    return first_per_group(kept, ["_row"], [F.xxhash64(*docs.columns)]).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for; a fractional repetition ends after its words."""
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in windows of up to 1024 tokens, with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), learnt_bytes=LEARNT_BYTES)


STAGES = [("language_id", identify_language), ("near_duplicates", drop_near_duplicates), ("mixing", mix_sources), ("packing", pack_windows)]

#: Learning, the tokenizer and packing cannot be written in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name)
    return docs
