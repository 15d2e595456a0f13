"""Quality, source, ranking and credibility scores."""
from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressweave import fixed_values as fv
from pressweave.functions.text import lit_array, strip, text_or_empty
from pressweave.functions.values import total
from pressweave.operators.keyfilter import distinct_values, key_filter, may_hold, substrings_of


def quality_score(df: DataFrame, placeholders=fv.QUALITY_PLACEHOLDERS) -> Column:
    """Completeness of an annotated row; higher is better."""
    weights = {"entity": 3.0, "org_from": 2.0, "org_to": 2.0, "fee_text": 2.0}
    parts = [F.when(strip(text_or_empty(F.col(f))).isin(placeholders[f]), 0.0).otherwise(w)
             for f, w in weights.items()]
    fee = F.nanvl(F.coalesce(F.col("fee_numeric").cast("double"), F.lit(0.0)), F.lit(0.0))
    status = F.upper(text_or_empty(F.col("status")))
    parts += [
        F.when(fee > 0, 1.0).otherwise(0.0),
        F.when(strip(text_or_empty(F.col("image_url"))).startswith("http"), 1.5).otherwise(0.0),
        F.nanvl(F.coalesce(F.col("credibility").cast("double"), F.lit(0.0)), F.lit(0.0)),
        F.when(status.contains("OFFICIEL"), 2.0).when(status.contains("HERE WE GO"), 1.5)
        .when(status.contains("NEGOCIATION"), 0.5).otherwise(0.0),
        F.least(F.length(text_or_empty(F.col("summary"))) / 200.0, F.lit(2.0)),
    ]
    return total(parts)


def literal_pairs(table: dict) -> Column:
    """The entries of a parameter table, in order, as one literal array<struct<key,value>>; keys in lower case."""
    rows = json.dumps([{"key": str(k).lower(), "value": str(v)} for k, v in table.items()])
    return F.from_json(F.lit(rows), "array<struct<key:string,value:string>>")


def source_score(source: Column, scores: dict[str, int] = fv.SOURCE_SCORES, default: int = fv.DEFAULT_SOURCE_SCORE) -> Column:
    """Score of the first key that contains, or is contained in, the source name.

    For a parameter table; ``contained_value`` does the same with a table of any size.
    """
    name = F.lower(text_or_empty(source))
    found = F.filter(literal_pairs(scores), lambda p: F.contains(name, p["key"]) | F.contains(p["key"], name))
    return F.when(name == "", default).otherwise(F.coalesce(F.get(found, F.lit(0))["value"].cast("int"), F.lit(default)))


def first_contained(name: Column, table: dict[str, str]) -> Column:
    """Value of the first key contained in the name, case-insensitive; '' when none is."""
    low = F.lower(text_or_empty(name))
    found = F.filter(literal_pairs(table), lambda p: F.contains(low, p["key"]))
    return F.when(low == "", "").otherwise(F.coalesce(F.get(found, F.lit(0))["value"], F.lit("")))


def contained_value(df: DataFrame, column: str, table: DataFrame, into: str, both_ways: bool = False) -> DataFrame:
    """Adds the value of the first key (by ``ord``) of a table (key, value, ord) that the column contains; NULL when none is.

    With ``both_ways`` also keys that contain the column.  Containment becomes an
    equi-join of substrings, over distinct names only, so neither side is limited.
    Only substrings as long as some key are made, one at a time, and a filter over
    the keys rules out nearly all of them before the join.
    """
    names = df.select(F.lower(text_or_empty(F.col(column))).alias("_name")).filter("_name <> ''").distinct()
    keys = table.select(F.lower("key").alias("_key"), F.col("value").alias("_value"), F.col("ord").alias("_ord")).filter("_key <> ''")

    def inside(texts: DataFrame, text: str, wanted: DataFrame, key: str) -> DataFrame:
        parts = substrings_of(texts, text, distinct_values(wanted, F.length(key)), "_part")
        likely = parts.filter(may_hold(key_filter(wanted.select(F.xxhash64(key))), F.xxhash64("_part"))).distinct()
        return likely.join(wanted, F.col("_part") == F.col(key)).select("_name", "_value", "_ord")

    hits = inside(names, "_name", keys, "_key")
    if both_ways:
        hits = hits.unionByName(inside(keys, "_key", names, "_name"))
    first = hits.groupBy("_name").agg(F.min_by("_value", "_ord").alias(into))
    return df.withColumn("_name", F.lower(text_or_empty(F.col(column)))).join(first, "_name", "left").drop("_name")


def with_source_score(df: DataFrame, scores: dict[str, int] | DataFrame, default: int = fv.DEFAULT_SOURCE_SCORE, into: str = "credibility") -> DataFrame:
    """Adds the score of ``source``, from a parameter table or a table (key, value, ord) of any size."""
    if isinstance(scores, DataFrame):
        rows = contained_value(df, "source", scores, "_score", both_ways=True)
        return rows.withColumn(into, F.coalesce(F.col("_score").cast("double"), F.lit(float(default)))).drop("_score")
    return df.withColumn(into, source_score(F.col("source"), scores, default).cast("double"))


def age_hours(published: Column, as_of: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", published, as_of) / F.lit(3600e6)


def recency_score(published: Column, as_of: Column) -> Column:
    h = age_hours(published, as_of)
    return (F.when(published.isNull(), 0.5)
            .when(h < 1, 1.0)
            .when(h < 24, F.greatest(F.lit(0.5), 1.0 - h / 24 * 0.5))
            .when(h < 168, F.greatest(F.lit(0.1), 0.5 - (h - 24) / 144 * 0.4))
            .otherwise(0.1))


def engagement_score(reviews: Column, rating: Column) -> Column:
    rated = F.when(rating > 0, F.least(F.lit(1.0), rating / 5.0)).otherwise(0.5)
    score = (F.least(F.lit(1.0), reviews / 10.0) + rated) / 2
    return F.when(F.coalesce(reviews, F.lit(0)) == 0, 0.0).otherwise(score)


def ranking_score(credibility: Column, recency: Column, engagement: Column, source: Column, keywords: Column,
                  weights=fv.RANK_WEIGHTS) -> Column:
    """Weighted score in 0..1; ``keywords`` is an array."""
    values = {
        "credibility": credibility, "recency": recency, "engagement": engagement,
        "source": F.least(F.lit(1.0), source),
        "keywords": F.least(F.lit(1.0), F.greatest(F.size(keywords), F.lit(0)) / 5.0),
    }
    return F.least(F.lit(1.0), total([values[k] * w for k, w in weights.items()]))


def rank_filters(language=None, source=None, min_credibility=None, keywords=None, max_age_hours=None,
                 verified_only=False, as_of: Column | None = None) -> Column:
    """Optional filters; a missing date passes the age test."""
    test = F.lit(True)
    if language:
        test = test & (F.col("language") == language)
    if source:
        test = test & F.lower(text_or_empty(F.col("source"))).contains(source.lower())
    if min_credibility:
        test = test & (F.coalesce("credibility_score", F.lit(0.0)) >= min_credibility)
    if keywords:
        test = test & F.coalesce(F.arrays_overlap("keywords", lit_array(keywords)), F.lit(False))
    if max_age_hours:
        test = test & F.coalesce(age_hours(F.col("published_at"), as_of) <= max_age_hours, F.lit(True))
    if verified_only:
        test = test & F.coalesce("verified", F.lit(False))
    return test


def spam_hits(text: Column, patterns=fv.SPAM_PATTERNS) -> Column:
    """Number of spam markers present."""
    low = F.lower(text)
    return total([F.when(low.rlike(p), 1).otherwise(0) for p in patterns])


def article_credibility(source: Column, spam: Column, text: Column, keywords: Column) -> Column:
    """40 source / 20 spam / 20 text / 20 keywords, every part in 0..1, clipped to 0.15..1."""
    score = source * 0.4 + spam * 0.2 + text * 0.2 + keywords * 0.2
    return F.greatest(F.lit(0.15), F.least(F.lit(1.0), score))


def trust_level(score: Column) -> Column:
    return (F.when(score >= 0.8, "high").when(score >= fv.VERIFIED_THRESHOLD, "good")
            .when(score >= 0.3, "medium").otherwise("low"))
