"""Filtered, paged and aggregated queries over articles and sources."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressweave import fixed_values as fv
from pressweave.functions.text import non_empty, text_or_empty
from pressweave.functions.values import numeric_fee
from pressweave.operators.annotate import attribute


def article_filter(category=None, league=None, org=None, status=None, source=None, search=None, collation: str | None = None) -> Column:
    """Conjunction of the given filters.  Search values are LIKE patterns, % and _ included; a backslash is itself.

    With a ``collation`` (``UNICODE_CI_AI``: neither case nor accents count) search
    values are plain text that has to be contained under that collation.
    """
    def like(value, *columns):
        if collation:
            return reduce(lambda a, b: a | b, [F.contains(F.collate(F.col(c), collation), F.lit(value)) for c in columns])
        value = value.replace("\\", "\\\\")
        return reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{value}%") for c in columns])

    tests = []
    if category:
        tests.append((F.col("category") == category) | (F.col("league") == category))
    if league:
        tests.append((F.col("league") == league) | (F.col("category") == league))
    if org:
        tests.append(like(org, "org_from", "org_to", "title"))
    if status:
        tests.append(F.col("status") == status)
    if source:
        tests.append(F.col("source") == source)
    if search:
        tests.append(like(search.strip(), "title", "summary", "entity", "org_from", "org_to"))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def page_of(df: DataFrame, page: int, page_size: int, key: str) -> DataFrame:
    """Newest first, undated last; the key settles ties.  Planned as a top-k, not a full sort."""
    if not 1 <= page_size <= 5000 or page < 1:
        raise ValueError("page starts at 1 and page_size lies in 1..5000")
    return (df.orderBy(F.desc_nulls_last("published_at"), F.desc_nulls_last("created_at"), F.asc(key))
            .offset((page - 1) * page_size).limit(page_size))


def find_by(df: DataFrame, column: str, value) -> DataFrame:
    """The rows of one key: a filter that reaches the scan of a stored table."""
    return df.filter(F.col(column) == value)


def with_source(articles: DataFrame, sources: DataFrame, how: str = "inner") -> DataFrame:
    """Join to the source dimension on ``source_id``; Spark picks the strategy from the sizes."""
    return articles.join(sources, "source_id", how)


def category_counts(df: DataFrame) -> DataFrame:
    label = F.coalesce(non_empty(F.col("category")), F.lit(fv.DEFAULT_CATEGORY))
    return (df.groupBy(label.alias("category")).agg(F.count(F.lit(1)).alias("articles"))
            .orderBy(F.desc("articles"), F.asc("category")))


def source_counts(articles: DataFrame, sources: DataFrame) -> DataFrame:
    """Counts are taken by id first; the names join onto one row per source."""
    counts = articles.groupBy("source_id").agg(F.count(F.lit(1)).alias("articles"))
    return (counts.join(sources.select("source_id", "name"), "source_id").groupBy("name")
            .agg(F.sum("articles").alias("articles")).orderBy(F.desc("articles"), F.asc("name")))


def stats(articles: DataFrame) -> DataFrame:
    """Totals and the two count maps as one long table (metric, label, value).

    One scan: everything rolls up from the (category, source) sub-totals.
    """
    label = F.coalesce(non_empty(F.col("category")), F.lit(fv.DEFAULT_CATEGORY))
    base = articles.groupBy(label.alias("category"), "source").agg(
        F.count(F.lit(1)).alias("n"), F.sum("credibility").alias("s"), F.count("credibility").alias("c"))
    sets = base.groupingSets([[], ["category"], ["source"]], "category", "source").agg(
        F.grouping_id().alias("g"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("c").alias("c"))

    def line(metric: str, label: Column, value: Column) -> Column:
        return F.struct(F.lit(metric).alias("metric"), label.alias("label"), value.cast("double").alias("value"))

    none, one = F.lit(""), F.lit(1)
    mean = F.round(F.coalesce(F.try_divide("s", "c"), F.lit(0.0)), 2)
    lines = sets.filter((F.col("g") != 2) | F.col("source").isNotNull()).select(F.inline(
        F.when(F.col("g") == 3, F.array(line("total_articles", none, F.col("n")), line("average_credibility", none, mean)))
        .when(F.col("g") == 1, F.array(line("category", F.col("category"), F.col("n")), line("total_categories", none, one)))
        .otherwise(F.array(line("source", F.col("source"), F.col("n")), line("total_sources", none, one)))))
    # an empty table still has its totals
    names = ("total_articles", "average_credibility", "total_categories", "total_sources")
    zeros = articles.sparkSession.range(1).select(F.inline(F.array(*[line(m, none, F.lit(0.0)) for m in names])))
    return lines.unionByName(zeros).groupBy("metric", "label").agg(F.sum("value").alias("value"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull() & (F.col(column) != "")).distinct()


def org_list(df: DataFrame) -> DataFrame:
    """Distinct organisations of both sides, sorted."""
    both = df.select(F.explode(F.array("org_from", "org_to")).alias("org"))
    return distinct_values(both, "org").orderBy("org")


def served(df: DataFrame, nationalities: dict[str, str], key: str = "id") -> DataFrame:
    """The row as it is served, named by its key: defaults, recomputed fee, nationality lookup."""
    fee = F.coalesce(F.col("fee_numeric"), F.lit(0.0))
    fee_string = text_or_empty(F.col("fee_text"))
    return df.select(
        key, "title",
        F.coalesce(F.col("source"), F.lit(fv.UNKNOWN_SOURCE)).alias("source"),
        F.coalesce(non_empty(F.col("category")), F.lit(fv.DEFAULT_SERVED_CATEGORY)).alias("category"),
        F.coalesce(non_empty(F.col("sentiment")), F.lit(fv.DEFAULT_SENTIMENT)).alias("sentiment"),
        non_empty(F.col("entity")).alias("entity"),
        attribute(F.col("entity"), nationalities).alias("nationality"),
        "org_from", "org_to",
        F.coalesce(non_empty(F.col("league")), F.col("category")).alias("league"),
        non_empty(fee_string).alias("fee_text"),
        F.when((fee == 0) & (fee_string != ""), numeric_fee(fee_string)).otherwise(fee).alias("fee_numeric"),
        F.coalesce(non_empty(F.col("status")), F.lit(fv.STATUS_RUMOUR)).alias("status"),
        F.coalesce(F.col("credibility").cast("double"), F.lit(0.0)).alias("credibility"),
    )
