"""Table files: CSV and Parquet readers and writers, preferred tables, shared scratch space."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressweave import fixed_values as fv

ARTICLE = T.StructType([
    T.StructField(name, kind) for name, kind in [
        ("external_key", T.StringType()), ("title", T.StringType()), ("url", T.StringType()),
        ("raw_date", T.StringType()), ("published_at", T.TimestampNTZType()), ("language", T.StringType()),
        ("category", T.StringType()), ("league", T.StringType()), ("sentiment", T.StringType()),
        ("entity", T.StringType()), ("org_from", T.StringType()), ("org_to", T.StringType()),
        ("fee_text", T.StringType()), ("fee_numeric", T.DoubleType()), ("status", T.StringType()),
        ("summary", T.StringType()), ("image_url", T.StringType()), ("image_caption", T.StringType()),
        ("credibility", T.DoubleType()), ("story_key", T.StringType()), ("source", T.StringType()),
        ("created_at", T.TimestampNTZType()), ("updated_at", T.TimestampNTZType()),
    ]
])
SOURCE = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("credibility", T.DoubleType()), T.StructField("base_url", T.StringType()),
    T.StructField("active", T.BooleanType()),
])


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names.

    Where the session names none, a folder below the warehouse is set: like the
    checkpoint folder, the warehouse is shared by the driver and all executors.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        spark.sparkContext.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints")
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete an intermediate result that ``settle`` or ``shared_dir`` made."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate result to the shared folder and go on from the table.

    Used where several outputs read the same costly rows: they are computed
    once, and a lost executor costs a re-read, not a re-computation.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def header_groups(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files of a CSV folder (or the one file) by their header line."""
    firsts = spark.read.option("wholetext", False).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    heads = (firsts.filter("at = 0").groupBy("file").agg(F.first("value").alias("head"))
             .groupBy("head").agg(F.collect_list("file").alias("files")))
    return {r["head"]: sorted(r["files"]) for r in heads.collect()}


def read_csv(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """All columns as strings: names drift, so types are settled after alias resolution.

    Files with other columns, or the same in another order, are read by their own
    header and put together by name.  ``line_breaks`` allows quoted line breaks,
    which makes a file the unit of work; without it large files are split.
    """
    reader = spark.read.option("header", True).option("multiLine", line_breaks).option("escape", '"').option("enforceSchema", False)
    parts = []
    for _, files in sorted(header_groups(spark, path).items()):
        df = reader.csv(files)
        parts.append(df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns]))
    out = parts[0] if parts else reader.csv(path)
    for df in parts[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def ordered_columns(columns: list[str]) -> list[str]:
    head = [c for c in fv.CSV_COLUMN_ORDER if c in columns]
    return head + [c for c in columns if c not in head and c != fv.CSV_DROPPED_COLUMN]


def write_csv(df: DataFrame, path: str) -> None:
    (df.select(*[F.col(f"`{c}`") for c in ordered_columns(df.columns)])
     .write.mode("overwrite").option("header", True).option("escape", '"').csv(path))


def read_preferred(spark: SparkSession, root: str, names=fv.PREFERRED_TABLES, suffix: str = ".csv") -> DataFrame | None:
    """The first table of the list that exists."""
    for name in names:
        path = f"{root.rstrip('/')}/{name}{suffix}"
        if exists(spark, path):
            return read_csv(spark, path) if suffix == ".csv" else spark.read.parquet(path)
    return None


def read_jdbc(spark: SparkSession, url: str, table: str, partition_column: str | None = None, lower=None, upper=None,
              partitions: int = 32, **options) -> DataFrame:
    """A relational table; give a partition column to read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column:
        reader = (reader.option("partitionColumn", partition_column).option("lowerBound", lower)
                  .option("upperBound", upper).option("numPartitions", partitions))
    return reader.load()


def add_columns(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Additive schema change: missing columns are added (with a default), order follows the schema."""
    defaults = defaults or {}
    out = df
    for f in schema:
        if f.name not in df.columns:
            out = out.withColumn(f.name, F.lit(defaults.get(f.name)).cast(f.dataType))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in schema],
                      *[c for c in df.columns if c not in schema.names])


def read_merged(spark: SparkSession, path: str, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """A stored table whose files have older and newer columns, read as one; what a file lacks, or holds as null, gets its default."""
    rows = add_columns(spark.read.option("mergeSchema", True).parquet(path), schema, defaults)
    return rows.fillna({c: v for c, v in (defaults or {}).items() if v is not None})


def append_missing(df: DataFrame, seeds: DataFrame) -> DataFrame:
    """Union by name; columns that one side lacks become NULL."""
    return df.unionByName(seeds, allowMissingColumns=True)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object file (or a directory of them) as key/value rows."""
    return explode_cache(spark.read.text(path, wholetext=True), "value")


def explode_cache(df: DataFrame, column: str, *keep: str) -> DataFrame:
    parsed = df.select(*keep, F.from_json(column, "map<string,string>").alias("m"))
    return parsed.select(*keep, F.explode("m").alias("key", "value"))


def append_cache(cache: DataFrame, new: DataFrame) -> DataFrame:
    """New keys are added, known keys stay as they are."""
    return cache.unionByName(new.join(cache, "key", "left_anti"))
