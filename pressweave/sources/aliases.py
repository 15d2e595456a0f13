"""Resolve drifting column names to canonical ones.

The choice of columns is made once from ``df.columns``; per row it is a coalesce.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressweave.functions.text import clean_value, detect_language, non_empty, text_or_empty


def matches(column: str, alias: str) -> bool:
    name, alias = column.strip().lower(), alias.lower()
    return name == alias or name.startswith(alias + ".")


def _first(columns: list[str]) -> Column:
    values = [non_empty(clean_value(F.col(f"`{c}`"))) for c in columns]
    return F.coalesce(*values, F.lit(""))


def first_by_alias(columns: list[str], aliases) -> Column:
    """First non-empty value; the order of the aliases decides."""
    return _first([c for a in aliases for c in columns if matches(c, a)])


def first_by_column(columns: list[str], aliases) -> Column:
    """First non-empty value; the order of the columns decides."""
    return _first([c for c in columns if any(matches(c, a) for a in aliases)])


def canonical_columns(df: DataFrame) -> DataFrame:
    """Lower-case names; summary filled from resume; image, caption and lang added when missing."""
    out = df.toDF(*[c.strip().lower() for c in df.columns])
    has = set(out.columns)
    resume = text_or_empty(F.col("resume")) if "resume" in has else F.lit("")
    if "summary" in has:
        current = text_or_empty(F.col("summary"))
        out = out.withColumn("summary", F.when(current.isin("", "nan"), resume).otherwise(current)
                             if "resume" in has else current)
    else:
        out = out.withColumn("summary", resume)
    for c in ("image_url", "image_caption"):
        out = out.withColumn(c, text_or_empty(F.col(c)) if c in has else F.lit(""))
    if "lang" not in has:
        out = out.withColumn("lang", detect_language(F.col("title")) if "title" in has else F.lit("fr"))
    for c in ("lang", "title", "url"):
        if c in out.columns:
            out = out.withColumn(c, text_or_empty(F.col(c)))
    return out
