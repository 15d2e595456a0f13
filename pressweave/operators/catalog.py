"""Search-feed catalog: one search url per group of five names and language."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressweave import fixed_values as fv
from pressweave.operators.dedup import dense_positions

GROUP = 5


def quote(c: Column) -> Column:
    """Percent-encoding with %20 for blanks; / and ~ stay as they are."""
    encoded = F.url_encode(c)
    for was, now in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(was), F.lit(now))
    return encoded


def name_groups(names: DataFrame, category: str, name: str, short: str, order: str) -> DataFrame:
    """(category, chunk, query_names, first_short): consecutive blocks of five names per category."""
    placed = dense_positions(names.select(category, name, short, order), category, order, "_position")
    placed = placed.withColumn("chunk", F.floor(F.col("_position") / GROUP))
    quoted = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), F.col(name)))),
                         lambda x: F.concat(F.lit('"'), x[name], F.lit('"')))
    return placed.groupBy(category, "chunk").agg(
        F.concat(F.lit("("), F.array_join(quoted, " OR "), F.lit(")")).alias("query_names"),
        F.min_by(short, order).alias("first_short"))


def language_configs(spark: SparkSession, languages: dict[str, list[str]] = fv.CATEGORY_LANGUAGES) -> DataFrame:
    """One row per category and language; a handful of rows, so it is broadcast."""
    return F.broadcast(spark.createDataFrame(
        [(c, lang) for c, ls in languages.items() for lang in ls], "category string, language string"))


def _feed_rows(rows: DataFrame, category: str, tag: Column, keywords: dict, editions: dict) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in keywords.items() for x in kv])
    edition = F.create_map(*[F.lit(x) for kv in editions.items() for x in kv])
    query = F.concat_ws(" ", "query_names", F.coalesce(F.element_at(table, F.col("language")), F.lit(keywords["fr"])),
                        F.lit(fv.FRESHNESS_TERM))
    return rows.select(
        F.col(category).alias("category"), "chunk", "language",
        F.concat(tag, F.lit(" ("), F.col("first_short"), F.lit("...)")).alias("name"),
        F.concat(F.lit(fv.FEED_SEARCH_URL), quote(query), F.lit("&"), F.element_at(edition, F.col("language"))).alias("url"))


def person_feeds(groups: DataFrame, category: str, configs: DataFrame, default_languages=fv.DEFAULT_LANGUAGES,
                 keywords=fv.SEARCH_KEYWORDS, editions=fv.EDITIONS) -> DataFrame:
    """Feeds per group and language; categories without a configuration use the default languages."""
    default = F.array(*[F.lit(x) for x in default_languages])
    joined = groups.join(configs.withColumnRenamed("category", category), category, "left")
    languages = F.when(F.col("language").isNotNull(), F.array("language")).otherwise(default)
    rows = joined.select(category, "chunk", "query_names", "first_short", F.explode(languages).alias("language"))
    tag = F.concat(F.lit("VIP "), F.upper("language"))
    return _feed_rows(rows, category, tag, keywords, editions).withColumn("credibility", F.lit(fv.PERSON_FEED_CREDIBILITY))


def coach_feeds(groups: DataFrame, category: str, keywords=fv.SEARCH_KEYWORDS, editions=fv.EDITIONS) -> DataFrame:
    """Two feeds per group of coaches, French and English."""
    rows = groups.withColumn("language", F.explode(F.array(F.lit("fr"), F.lit("en"))))
    tag = F.concat(F.lit("Coach Search "), F.upper("language"))
    return (_feed_rows(rows, category, tag, keywords, editions)
            .withColumn("category", F.lit(fv.COACH_CATEGORY))
            .withColumn("credibility", F.lit(fv.COACH_FEED_CREDIBILITY)))
