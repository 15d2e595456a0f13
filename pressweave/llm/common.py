"""Helpers that the operators of this subpackage share."""
from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import pressweave
from pressweave.sources.tables import settle

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(pressweave.__file__)))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this library from the place where the driver has it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``settle``, after which Spark removes the shuffle files of the query at once: nothing reads them any more."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return settle(df, name)
    finally:
        conf.set(CLEANUP, before) if before is not None else conf.unset(CLEANUP)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash_number(hexadecimal: Column, digits: int) -> Column:
    """The leading digits of a hexadecimal hash as a number."""
    return F.conv(F.substring(hexadecimal, 1, digits), 16, 10).cast("long")


def whole(shown: str | None) -> int | None:
    """A whole number sent as text, as pandas turns number columns with nulls into floats, which round."""
    return None if shown is None else int(shown)


def framed(rows: list[tuple], names: list[str], *nullable: str) -> pd.DataFrame:
    """Rows as a frame whose ``nullable`` columns are whole numbers or null, without rounding."""
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pd.DataFrame({name: pd.array(list(c), "Int64") if name in nullable else pd.Series(list(c), dtype=object if not rows else None)
                         for name, c in zip(names, columns)})
