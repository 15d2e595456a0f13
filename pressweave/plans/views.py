"""Articles over the test tables.

Derived columns are computed before the label join, so the whole text enters a
join only where a query asks for it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title (first line), summary (whole text), language, source, n_chars."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("summary"),
        F.col("lang").alias("language"), "source", "n_chars")


def credibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        "doc_id", (3 + 2 * F.col("quality") - F.col("toxic")).cast("double").alias("_cred"))


def with_credibility(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.join(credibility(spark, sf_dir), "doc_id", "left").withColumn(
        "credibility", F.coalesce("_cred", F.lit(3.0))).drop("_cred")


def published() -> F.Column:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    return day.cast("timestamp_ntz")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing columns that need no join: title and summary, dates, category."""
    return docs(spark, sf_dir).select(
        "doc_id", "title", "summary",
        "language", "source", F.col("language").alias("category"), published().alias("published_at"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``listing`` with the credibility of the labels."""
    return with_credibility(listing(spark, sf_dir), spark, sf_dir)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")
