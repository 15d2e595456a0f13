"""Daily report tables: rows, KPIs, digest and index.

"First seen" follows the report order.  It is an ordering struct, not a global
row number, so nothing is sorted in one task.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressweave import fixed_values as fv
from pressweave.functions.text import (category_slug, clean_value, materialize, non_empty, normalize_category, polish_text,
                                       shorten_clean)
from pressweave.functions.urls import normalize_image_url
from pressweave.functions.values import parse_date
from pressweave.operators.dedup import first_per_group
from pressweave.sources.aliases import first_by_column


def report_order() -> Column:
    """Ascending struct for: date desc (undated last), with image first, title, input order."""
    return F.struct(
        F.coalesce(-F.unix_date(F.col("sort_date").cast("date")), F.lit(2**31 - 1)).alias("d"),
        (~F.col("has_image")).alias("i"), F.col("title").alias("t"), F.col("ord").alias("o"))


def report_rows(raw: DataFrame, ord_column: str) -> DataFrame:
    """Normalised report rows, first of each (title, source, url) in report order."""
    def pick(*aliases):
        return first_by_column(raw.columns, aliases)

    picked = materialize(
        raw, (F.col(ord_column).alias("ord"),),
        title=pick("title", "titre"), source=pick("source"), date=pick("date"),
        category=pick("category", "categorie", "discipline"), summary=pick("summary", "resume"),
        url=pick("url", "lien"), image=pick("image", "image_url"), image_caption=pick("image_caption", "caption"),
        credibility=pick("credibility"))
    polished = materialize(picked, ("ord", "date", "url", "image", "credibility"), **{
        c: polish_text(F.col(c), cleaned=True) for c in ("title", "source", "category", "summary", "image_caption")})
    title, summary = F.col("title"), F.col("summary")
    rows = polished.select(
        "ord", "title", F.coalesce(non_empty(F.col("source")), F.lit(fv.UNKNOWN_SOURCE)).alias("source"), "date",
        normalize_category(F.col("category")).alias("category"),
        F.when((summary == "") | (summary == title), shorten_clean(title, 200)).otherwise(summary).alias("summary"),
        "url", normalize_image_url(F.col("image")).alias("image"), "image_caption", "credibility",
    ).filter(F.col("title") != "")
    rows = materialize(rows, sort_date=parse_date(F.col("date")), has_image=F.col("image") != "")
    return first_per_group(rows, ["title", "source", "url"], [report_order()])


def in_report_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("sort_date"), F.desc("has_image"), F.asc("title"), F.asc("ord"))


def category_kpis(rows: DataFrame) -> DataFrame:
    """Articles, sources, images and mean numeric credibility per category; one two-level aggregate."""
    number = F.col("credibility").try_cast("double")
    per_source = rows.groupBy("category", "source").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("has_image").alias("images"),
        F.sum(number).alias("s"), F.count(number).alias("c"))
    return per_source.groupBy("category").agg(
        F.sum("n").alias("articles"), F.count("source").alias("sources"), F.sum("images").alias("images"),
        F.when(F.sum("c") > 0, F.concat(F.format_number(F.try_divide(F.sum("s"), F.sum("c")), 1), F.lit("/5")))
        .otherwise("N/A").alias("credibility"))


def first_seen(rows: DataFrame, column: str, k: int) -> DataFrame:
    """The first k distinct values of a column per category, in report order."""
    seen = rows.groupBy("category", column).agg(F.min(report_order()).alias("at"))
    return first_per_group(seen, ["category"], ["at"], k, "rank").select("category", column, "rank")


def category_digest(rows: DataFrame) -> DataFrame:
    """One sentence block per category: count, two top titles, three sources.

    ``rows`` is read three times; pass a written table (``sources.tables.settle``).
    """
    def bounded(column, k):
        # at most k values per category are collected
        return first_seen(rows, column, k).groupBy("category").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", column))), lambda x: x[column]).alias(column))

    counts = rows.groupBy("category").agg(F.count(F.lit(1)).alias("articles"))
    digest = counts.join(bounded("title", 2), "category").join(bounded("source", 3), "category")
    plural = F.when(F.col("articles") > 1, "s").otherwise("")
    second = F.try_element_at("title", F.lit(2))
    text = F.concat_ws(
        " ",
        F.concat(F.col("articles").cast("string"), F.lit(" article"), plural, F.lit(" suivi"), plural,
                 F.lit(" aujourd'hui dans "), F.col("category"), F.lit(".")),
        F.concat(F.lit("Temps fort: "), shorten_clean(F.try_element_at("title", F.lit(1)), 110), F.lit(".")),
        F.when(second.isNotNull(), F.concat(F.lit("Autre sujet marquant: "), shorten_clean(second, 110), F.lit("."))),
        F.concat(F.lit("Sources les plus presentes: "), F.array_join("source", ", "), F.lit(".")))
    return digest.select("category", "articles", text.alias("digest"))


def report_index(rows: DataFrame) -> DataFrame:
    """Categories by count, ties by first appearance."""
    per_source = rows.groupBy("category", "source").agg(F.count(F.lit(1)).alias("n"), F.min(report_order()).alias("at"))
    index = per_source.groupBy("category").agg(
        F.sum("n").alias("articles"), F.count("source").alias("sources"), F.min("at").alias("at"))
    return index.orderBy(F.desc("articles"), F.asc("at")).select(
        "category", "articles", "sources",
        F.concat(category_slug(F.col("category")), F.lit("_latest.html")).alias("link"))


def first_appearance(rows: DataFrame) -> DataFrame:
    """Distinct categories in order of first appearance."""
    return rows.groupBy("category").agg(F.min(report_order()).alias("at")).orderBy("at").select("category")


def cards(rows: DataFrame) -> DataFrame:
    """The values shown per article."""
    def shown(c, missing):
        return F.coalesce(non_empty(clean_value(F.col(c))), F.lit(missing))

    return rows.select("ord", "title", "source", "category", shown("date", "Date non renseignee").alias("date"),
                       shorten_clean(F.col("summary"), 260).alias("summary"), shown("url", "#").alias("url"), "image",
                       shown("credibility", "N/A").alias("credibility"))


