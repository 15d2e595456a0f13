"""The four jobs.  Rows that several steps read are computed once and stored (``settle``)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressweave import fixed_values as fv
from pressweave.functions.text import materialize, non_empty, polish_text, shorten, text_or_empty
from pressweave.functions.urls import is_http, normalize_image_url
from pressweave.functions.values import external_key, parse_date, parse_float
from pressweave.operators.annotate import (annotate, bullet_summary, classify, fill_placeholders, headline,
                                           lexicon_sentiment, merge_annotations, skip_off_topic)
from pressweave.operators.dedup import first_per_group
from pressweave.operators.joins import resolve_images
from pressweave.operators.merge import merge_stories
from pressweave.operators.query import article_filter, page_of
from pressweave.operators.report import (cards, category_digest, category_kpis, in_report_order, report_index,
                                         report_rows)
from pressweave.operators.score import with_source_score
from pressweave.operators.store import read_articles, upsert_articles
from pressweave.operators.topic import TopicRules, keep_on_topic
from pressweave.sources.aliases import first_by_alias
from pressweave.sources.feeds import ITEM_LIMIT, SUMMARY_LIMIT, feed_items, land_items
from pressweave.sources.pages import page_image
from pressweave.sources.tables import settle

LOCAL_CREDIBILITY = 4.0


def annotate_job(items: DataFrame, order: str, rules: TopicRules, entities: dict | DataFrame, org_aliases: dict[str, str] | DataFrame,
                 cache: DataFrame, badges: dict[str, str] | DataFrame, pages: DataFrame | None = None,
                 external: DataFrame | None = None, scores: dict[str, int] | DataFrame = fv.SOURCE_SCORES, **lexicon) -> DataFrame:
    """Landed items -> topic filter -> annotation -> image -> story merge -> source score.

    ``order`` is a unique column of whole numbers; ``pages`` has url and image_url.
    Every dictionary may be a parameter or a table of any size.
    """
    if external is not None:
        items = skip_off_topic(items, external, order)
    rows = keep_on_topic(items, rules, keep_norm=True, key=order)
    rows = annotate(rows, entities, org_aliases, key=order, **lexicon).withColumn("credibility", F.lit(LOCAL_CREDIBILITY))
    if external is not None:
        rows = merge_annotations(rows, external, order)
    fields = [F.col(c) for c in ("status", "entity", "org_from", "org_to", "fee_text", "title")]
    status, entity, org_from, org_to, fee, title = fields
    rows = (rows.withColumn("_headline", headline(status, entity, org_from, org_to, fee, title))
            .withColumn("summary", bullet_summary(entity, org_from, org_to, fee, title))
            .withColumn("title", F.col("_headline")).drop("_headline"))
    # the texts have given way to headline and bullets, so the rows that images are looked up for are narrow
    rows = resolve_images(rows, order, cache, badges, pages)
    rows = rows.withColumn("image_url", F.col("best_image")).drop("best_image")
    return with_source_score(merge_stories(rows, order), scores)


def daily_run(feeds: DataFrame, catalog: DataFrame, today: str, path: str, rules: TopicRules, entities: dict | DataFrame, org_aliases: dict[str, str] | DataFrame,
              cache: DataFrame, badges: dict[str, str] | DataFrame, pages: DataFrame | None = None, external: DataFrame | None = None,
              item: Column | None = None, batch_id: str | int | None = None, item_limit: int | None = ITEM_LIMIT, summary_limit: int | None = SUMMARY_LIMIT,
              **rest) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Landed feeds to stored articles and their report: (counters, report tables).

    ``item`` names an item by a whole number (a hash of feed and position unless
    given); ``external`` has it as ``item``.  ``pages`` are landed pages (url, html) that give images.
    """
    found = feed_items(feeds, today, limit=item_limit).withColumn("item", F.xxhash64("feed", "position") if item is None else item)
    landed = land_items(found, catalog, None, summary_limit)
    shown = None if pages is None else pages.select("url", page_image(text_or_empty(F.col("html"))).alias("image_url"))
    articles = annotate_job(landed, "item", rules, entities, org_aliases, cache, badges, shown, external, **rest)
    now = F.current_timestamp().cast("timestamp_ntz")
    articles = articles.withColumns({
        "external_key": external_key(*[F.col(c) for c in ("source", "title", "url", "raw_date")]),
        "published_at": parse_date(F.col("raw_date"), rfc822=True), "created_at": now, "updated_at": now})
    counters = upsert_articles(articles.sparkSession, path, articles, batch_id)
    stored = read_articles(articles.sparkSession, path)
    return counters, report_job(stored.withColumn("date", F.date_format("published_at", "yyyy-MM-dd")), "item")


def normalize_import(raw: DataFrame, order: str, rules: TopicRules, entities: dict | DataFrame, org_aliases: dict[str, str] | DataFrame,
                     classes: dict[str, list[str]] = fv.CLASS_KEYWORDS, default_class: str = fv.DEFAULT_LEAGUE) -> DataFrame:
    """Rows of a CSV with drifting columns as article rows, first row of each key."""
    def pick(*aliases):
        return first_by_alias(raw.columns, aliases)

    rows = materialize(
        raw, (F.col(order).alias("ord"),),
        title=pick("title", "titre"), summary=pick("summary", "summary.1", "resume", "resume.1"), source=pick("source"),
        raw_date=pick("date", "raw_date", "published_at"), url=pick("url", "lien"),
        category=pick("category", "categorie", "discipline", "league"), language=pick("lang", "language"),
        sentiment=pick("sentiment"), image_url=pick("image", "image_url", "image.1", "image_url.1"),
        image_caption=pick("image_caption", "caption"), credibility=pick("credibility", "credibilite"),
        entity=pick("player_name", "player", "entity"), org_from=pick("from_club", "org_from"),
        org_to=pick("to_club", "org_to"), _league=pick("league"), fee_text=pick("transfer_fee", "fee", "fee_text"),
        status=pick("status"))
    polished = ["title", "summary", "source", "category", "image_caption"]
    rest = [c for c in rows.columns if c not in (*polished, "image_url", "credibility")]
    rows = materialize(rows, rest, image_url=normalize_image_url(F.col("image_url")),
                       credibility=parse_float(F.col("credibility")),
                       **{c: polish_text(F.col(c), cleaned=True) for c in polished})
    rows = rows.withColumn("source", F.coalesce(non_empty(F.col("source")), F.lit(fv.UNKNOWN_SOURCE)))
    rows = keep_on_topic(rows.filter(F.col("title") != ""), rules, keep_norm=True, key="ord")
    said = F.concat_ws(" ", "title", "summary")
    rows = materialize(
        rows, [c for c in rows.columns if c not in ("category", "summary", "sentiment")],
        category=F.coalesce(non_empty(F.col("category")), classify(F.col("_norm"), classes, default_class)),
        summary=F.coalesce(non_empty(F.col("summary")), shorten(F.col("title"), 220)),
        _sentiment=F.coalesce(non_empty(F.col("sentiment")), lexicon_sentiment(said)))
    rows = fill_placeholders(rows, entities, org_aliases, key="ord")
    rows = (rows
            .withColumn("league", F.coalesce(non_empty(F.col("_league")), F.col("category")))
            .withColumn("sentiment", F.col("_sentiment"))
            .withColumn("image_url", F.when(is_http(F.col("image_url")), F.col("image_url")))
            .withColumn("external_key", external_key(*[F.col(c) for c in ("source", "title", "url", "raw_date")]))
            .withColumn("published_at", parse_date(F.col("raw_date"), rfc822=True)))
    rows = first_per_group(rows.drop("_league", "_sentiment"), ["external_key"], ["ord"])
    for c in ("url", "language", "image_caption"):
        rows = rows.withColumn(c, non_empty(F.col(c)))
    return rows


def query_job(articles: DataFrame, key: str, page: int = 1, page_size: int = 200, **filters) -> tuple[DataFrame, DataFrame]:
    """(page, total) of a filtered listing."""
    rows = articles.filter(article_filter(**filters))
    return page_of(rows, page, page_size, key), rows.agg(F.count(F.lit(1)).alias("total"))


def report_job(raw: DataFrame, order: str) -> dict[str, DataFrame]:
    """Cards, KPIs, digest and index of the daily report."""
    rows = settle(report_rows(raw, order), "report")
    return {"cards": cards(in_report_order(rows)), "kpis": category_kpis(rows),
            "digest": category_digest(rows), "index": report_index(rows)}


def reannotate(stored: DataFrame, key: str, rules: TopicRules, entities: dict | DataFrame, org_aliases: dict[str, str] | DataFrame, cache: DataFrame,
               badges: dict[str, str] | DataFrame, pages: DataFrame | None = None, **lexicon) -> DataFrame:
    """Drop off-topic rows, recompute entity, organisations, status and image of the rest; other columns stay."""
    kept = keep_on_topic(stored.withColumn("_none", F.lit("")), rules, source="_none", keep_norm=True, key=key).drop("_none")
    fresh = annotate(kept, entities, org_aliases, key=key, fields=["entity", "org_from", "org_to", "status"], **lexicon)
    fresh = resolve_images(fresh, key, cache, badges, pages)
    return fresh.withColumn("image_url", F.col("best_image")).select(*stored.columns)


def backfill_images(stored: DataFrame, key: str, cache: DataFrame, badges: dict[str, str] | DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Fill the image of rows without a good one; other rows stay as they are."""
    current = text_or_empty(F.col("image_url"))
    bad = ~current.startswith("http") | F.lower(current).rlike(fv.PLACEHOLDER_IMAGE_PATTERN)
    done = resolve_images(stored, key, cache, badges, pages)
    return done.withColumn("image_url", F.when(bad & (F.col("best_image") != ""), F.col("best_image"))
                           .otherwise(F.col("image_url"))).select(*stored.columns)


def purge(stored: DataFrame, rules: TopicRules) -> DataFrame:
    """Stored rows that stay: source not blocked and on topic."""
    return keep_on_topic(stored, rules)
