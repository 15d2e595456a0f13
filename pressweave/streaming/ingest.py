"""Continuous ingest from landed files."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pressweave.operators.dedup import first_per_group
from pressweave.operators.store import upsert_articles, write_counted
from pressweave.sources.tables import exists, remove


def landing(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_batch: int | None = None,
            **options) -> DataFrame:
    """A stream over a landing directory; each new file is read once."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def fresh(df: DataFrame, ts: str, as_of: Column | None = None, window: str = "24 hours") -> DataFrame:
    """Rows inside the freshness window before ``as_of`` (default: now)."""
    now = F.current_timestamp().cast("timestamp_ntz") if as_of is None else as_of
    return df.filter(F.col(ts) >= now - F.expr(f"INTERVAL {window}"))


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Watermark on a column that may be a time-zone-free timestamp."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def windowed_counts(df: DataFrame, ts: str, *labels: str, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Rolling counts per label in event-time windows; rows that land more than ``delay`` after newer ones are left out (``count_stream`` counts all)."""
    return (with_event_time(df, ts, delay).groupBy(F.window(ts, window), *labels)
            .agg(F.count(F.lit(1)).alias("articles"))
            .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *labels, "articles"))


def run_batches(df: DataFrame, write, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def upsert_stream(df: DataFrame, table: str, status: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Upsert every micro-batch into the article table and record its counters.

    A batch that is repeated after a failure, wherever it stopped, gives the same
    table and the same status row, as its counters are kept beside the table.  The
    newest version of a key wins in whatever batch it comes.  Without an interval all landed files are processed and the query stops.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        counters = upsert_articles(spark, table, batch, batch_id)
        (counters.withColumn("finished_at", F.current_timestamp())
         .write.mode("overwrite").parquet(f"{status}/batch_id={batch_id}"))

    return run_batches(df, write, checkpoint, interval)


def distinct_stream(df: DataFrame, key: str, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """One row per key over all batches, whatever the order and the age of the rows.

    A batch is made unique, the row with the smallest hash of its columns first, and
    rows whose key an earlier batch has brought are left out.  Each batch has its own
    folder, so repeating one writes the same rows.  Every batch meets all keys that
    ever came; ``distinct_by_date`` reads those of its own dates only.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = first_per_group(batch, [key], [F.xxhash64(*batch.columns)])
        if batch_id and exists(spark, path):
            known = spark.read.schema(f"{key} string, batch_id long").parquet(path).filter(F.col("batch_id") < batch_id)
            fresh = fresh.join(known.select(key), key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return run_batches(df, write, checkpoint, interval)


def distinct_by_date(df: DataFrame, keys: list[str], ts: str, path: str, checkpoint: str, delay: str = "24 hours",
                     interval: str | None = None) -> StreamingQuery:
    """The distinct values of ``keys`` on each date, as (keys, day, batch_id), with bounded work in every batch.

    The state store drops what it has seen within ``delay`` of event time; the rest of
    a batch meets the stored keys of its own dates, so a row that is repeated later
    than the delay is found as well.  Work and state do not grow with history.  Rows
    older than the watermark are left out (``fresh_stream`` keeps such rows apart).
    Only the keys are written, so a repeated batch writes the same rows.
    """
    dated = with_event_time(df, ts, delay).withColumn("day", F.to_date(ts)).select(*keys, "day", ts)
    once = dated.dropDuplicatesWithinWatermark([*keys, "day"]).drop(ts)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, fresh = batch.sparkSession, batch.distinct()
        if batch_id and exists(spark, path):
            days = [r[0] for r in fresh.select("day").distinct().collect()]  # a value per day
            known = spark.read.parquet(path).filter(F.col("day").isin(days) & (F.col("batch_id") < batch_id))
            fresh = fresh.join(known.select(*keys, "day"), [*keys, "day"], "left_anti")
        (fresh.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day", "batch_id").parquet(path))

    return run_batches(once, write, checkpoint, interval)


def fresh_stream(df: DataFrame, ts: str, path: str, late_path: str, status: str, checkpoint: str, window: str = "24 hours",
                 interval: str | None = None) -> StreamingQuery:
    """Rows within ``window`` of the newest event seen so far; older rows go to a table of late rows, and both are counted.

    The newest event of the batches before comes from their status rows, so a
    repeated batch decides as it did.  The batch is written once, with the counters
    observed in that pass; kept and late rows are folders of one table.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = None
        if batch_id and exists(spark, status):
            newest = spark.read.parquet(status).filter(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
        landed = f"{path}.landed/batch_id={batch_id}"
        got = write_counted(batch, landed, "overwrite", landed=F.count(F.lit(1)), newest=F.max(ts))
        newest = max((t for t in (newest, got["newest"]) if t is not None), default=None)
        late = F.coalesce(F.col(ts) < F.lit(newest).cast(batch.schema[ts].dataType) - F.expr(f"INTERVAL {window}"), F.lit(True))
        rows = spark.read.schema(batch.schema).parquet(landed)
        kept = write_counted(rows.filter(~late), f"{path}/batch_id={batch_id}", "overwrite", n=F.count(F.lit(1)))["n"]
        rows.filter(late).write.mode("overwrite").parquet(f"{late_path}/batch_id={batch_id}")
        remove(spark, landed)
        spark.createDataFrame([(got["landed"], kept, got["landed"] - kept, newest)], "landed long, kept long, late long, newest timestamp_ntz").coalesce(1) \
            .write.mode("overwrite").parquet(f"{status}/batch_id={batch_id}")

    return run_batches(df, write, checkpoint, interval)


def count_stream(df: DataFrame, ts: str, labels: list[str], path: str, checkpoint: str, window: str = "1 hour",
                 interval: str | None = None) -> StreamingQuery:
    """Counts per window and label of every batch, each in its own folder; ``window_counts`` adds them up.

    No row is too late for it and nothing waits for a watermark, so the sums do not depend on how rows fall into batches.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        counts = (batch.groupBy(F.window(F.col(ts).cast("timestamp"), window), *labels).agg(F.count(F.lit(1)).alias("articles"))
                  .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *labels, "articles"))
        counts.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return run_batches(df, write, checkpoint, interval)


def window_counts(spark: SparkSession, path: str, *labels: str) -> DataFrame:
    return spark.read.parquet(path).groupBy("window_start", *labels).agg(F.sum("articles").alias("articles"))


def run_status(spark: SparkSession, status: str) -> DataFrame:
    """One row per finished batch; the last one is the current state."""
    return spark.read.parquet(status)


def stream_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run an append stream over everything landed so far and stop."""
    query = (df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
             .outputMode(mode).trigger(availableNow=True).start())
    query.awaitTermination()
