"""Upserts into stored tables.

An article table is a Parquet folder partitioned by publication date.  The article key
is a hash that includes the date, so equal keys have equal dates: a batch reads and
rewrites only the dates it has rows for.  The merged dates are written beside the table
first and then replace the old ones by Spark's dynamic partition overwrite.  A table has
one writer at a time.
"""
from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from pressweave.functions.text import non_empty, text_or_empty
from pressweave.operators.dedup import first_per_group
from pressweave.sources.tables import exists, remove

PARTITION = "published_date"


def upsert(existing: DataFrame, batch: DataFrame, key: str, keep_existing=("created_at",), op: str = "op",
           version: str | None = None) -> DataFrame:
    """Full-outer upsert; ``op`` is insert, update or keep.

    Batch rows win, or with ``version`` those whose version is not below the
    stored row's.  The batch must be unique on the key (see ``keep_first``).
    Columns that one side lacks are kept: a stored value stays where the batch has no such column.
    """
    columns = existing.columns + [c for c in batch.columns if c not in existing.columns]
    types = {f.name: f.dataType for f in [*batch.schema, *existing.schema]}

    def all_of(df: DataFrame) -> Column:
        return F.struct(*[F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in columns])

    old = existing.select(key, all_of(existing).alias("_old"))
    new = batch.select(key, all_of(batch).alias("_new"))
    joined = old.join(new, key, "full_outer")
    if version:
        older = F.col("_new")[version] < F.col("_old")[version]
        joined = joined.withColumn("_new", F.when(~F.coalesce(older, F.lit(False)), F.col("_new")))

    def value(c: str) -> Column:
        if c == key:
            return F.col(key)
        if c in keep_existing or c not in batch.columns:
            return F.when(F.col("_old").isNotNull(), F.col("_old")[c]).otherwise(F.col("_new")[c])
        return F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col("_old")[c])

    kind = (F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "keep").otherwise("update"))
    return joined.select(*[value(c).alias(c) for c in columns], kind.alias(op))


def upsert_counts(upserted: DataFrame) -> DataFrame:
    return upserted.agg(F.count_if(F.col("op") == "insert").alias("inserted"),
                        F.count_if(F.col("op") == "update").alias("updated"),
                        F.count(F.lit(1)).alias("total"))


def roll_up_sources(batch: DataFrame, order: str) -> DataFrame:
    """One row per source name: first non-empty language in input order, highest credibility."""
    language = non_empty(text_or_empty(F.col("language")))
    return batch.groupBy(F.col("source").alias("name")).agg(
        F.min_by(language, F.when(language.isNotNull(), F.col(order))).alias("language"),
        F.max(F.coalesce(F.col("credibility").cast("double"), F.lit(0.0))).alias("credibility"))


def upsert_sources(existing: DataFrame, rolled_up: DataFrame) -> DataFrame:
    """Language is filled only where empty, credibility only raised."""
    new = rolled_up.select("name", F.col("language").alias("_language"), F.col("credibility").alias("_credibility"))
    rest = [c for c in existing.columns if c not in ("name", "language", "credibility")]
    return existing.join(new, "name", "full_outer").select(
        "name",
        F.coalesce(non_empty(F.col("language")), F.col("_language")).alias("language"),
        F.greatest(F.coalesce("credibility", F.lit(0.0)), F.coalesce("_credibility", F.lit(0.0))).alias("credibility"),
        *rest)


def write_counted(df: DataFrame, path: str, mode: str = "error", **counters: Column) -> dict:
    """Write rows and return aggregates over them, counted by the same pass that writes them."""
    seen = Observation()
    df.observe(seen, *[c.alias(name) for name, c in counters.items()]).write.mode(mode).parquet(path)
    return seen.get


def by_date(df: DataFrame) -> DataFrame:
    """Gather rows by date for writing: few files per date, and a date with many rows is split."""
    return df.hint("rebalance", F.col(PARTITION))


def has_key() -> Column:
    return F.coalesce(F.col("external_key") != "", F.lit(False))


def usable(batch: DataFrame) -> DataFrame:
    """Rows with a key, with their date."""
    return batch.filter(has_key()).withColumn(PARTITION, F.to_date("published_at"))


def newest(batch: DataFrame, version: str = "updated_at") -> DataFrame:
    """One row per key: the highest version, on ties the one with the smallest hash of all columns."""
    return first_per_group(batch, ["external_key"], [F.desc(version), F.xxhash64(*batch.columns)])


def stored_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as it is now, all columns that any batch brought; None where nothing is stored."""
    if not exists(spark, path):
        return None
    try:
        rows = spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException:
        if any_file(spark, path):
            raise
        return None
    return rows.withColumn(PARTITION, F.col(PARTITION).cast("date")) if PARTITION in rows.columns else rows


def any_file(spark: SparkSession, path: str) -> bool:
    return not spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path").isEmpty()


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    rows = stored_table(spark, path)
    if rows is None:
        raise FileNotFoundError(path)
    return rows


def write_articles(df: DataFrame, path: str) -> None:
    """Drop and reload: the table is written anew; rows without a key are left out."""
    by_date(usable(df)).write.mode("overwrite").partitionBy(PARTITION).parquet(path)


def upsert_articles(spark: SparkSession, path: str, batch: DataFrame, batch_id: str | int | None = None) -> DataFrame:
    """Merge a batch into the table at ``path`` and return its counters.

    The newest ``updated_at`` wins, inside the batch and against the stored row, so
    the table does not depend on how rows fall into batches.  Rows without a key are
    left out and counted as ``skipped``; stored columns that the batch lacks stay.
    What a batch with an id has merged is kept beside the table until it is in place,
    and its counters for good: repeating the batch, wherever it stopped, changes
    nothing more and returns the same counters.
    """
    staging = f"{path}.staging/batch={uuid.uuid4().hex if batch_id is None else batch_id}"
    landed, merged_at, counters_at, done = (f"{staging}/{name}" for name in ("landed", "merged", "counters", "done"))
    if not exists(spark, f"{counters_at}/_SUCCESS"):
        # the batch is used more than once below, so it is computed once and written
        got = write_counted(batch.withColumn(PARTITION, F.to_date("published_at")), landed, "overwrite", skipped=F.count_if(~has_key()))
        rows = newest(usable(spark.read.parquet(landed)))
        stored, before = stored_table(spark, path), 0
        merged = rows.withColumn("op", F.lit("insert"))
        if stored is not None:
            before = stored.count()
            days = [r[0] for r in rows.select(PARTITION).distinct().collect()]  # a value per day
            touched = F.col(PARTITION).isin([d for d in days if d]) | (F.col(PARTITION).isNull() & F.lit(None in days))
            merged = upsert(stored.filter(touched), rows, "external_key", version="updated_at")
        kinds = write_counted(merged, merged_at, "overwrite", inserted=F.count_if(F.col("op") == "insert"), updated=F.count_if(F.col("op") == "update"))
        counters = (kinds["inserted"], kinds["updated"], got["skipped"], before + kinds["inserted"])
        (spark.createDataFrame([counters], "inserted long, updated long, skipped long, total long").coalesce(1).write.mode("overwrite").parquet(counters_at))
    if not exists(spark, f"{done}/_SUCCESS"):
        rows = spark.read.parquet(merged_at).drop("op")
        by_date(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PARTITION).parquet(path)
        spark.range(1).coalesce(1).write.mode("overwrite").parquet(done)
        remove(spark, landed)
        remove(spark, merged_at)
    return spark.read.parquet(counters_at)


def import_if_empty(spark: SparkSession, path: str, batch: DataFrame) -> bool:
    """Bootstrap: write the batch only when the table is missing or has no row."""
    stored = stored_table(spark, path)
    if stored is not None and not stored.isEmpty():
        return False
    write_articles(batch, path)
    return True


def find_article(spark: SparkSession, path: str, key: str, published: str | None = None) -> DataFrame:
    """The row of a key; with its date only that date's files are read."""
    rows = read_articles(spark, path)
    if published is not None:
        rows = rows.filter(F.col(PARTITION) == F.lit(published).cast("date"))
    return rows.filter(F.col("external_key") == key)
