"""Items out of landed feed documents.

A feed document is one landed file (or one row of text).  Its items are taken
inside the row, in document order, so a limit per feed needs no shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressweave import fixed_values as fv
from pressweave.functions.text import bind, clean_html, materialize, non_empty, strip, text_or_empty, unescape
from pressweave.operators.topic import TopicRules, keep_on_topic
from pressweave.sources.pages import feed_page_image

# defaults of the arguments below; None takes everything
ITEM_LIMIT = 25
SUMMARY_LIMIT = 400

CHILDREN = ("title", "link", "description", "pubDate")
CORRUPT = "_corrupt"
ITEM = ", ".join(f"{name} string" for name in (*CHILDREN, CORRUPT))


def read_feed_files(spark: SparkSession, path: str) -> DataFrame:
    """(feed, xml): one row per landed file; the file name without extension names the feed."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]*)", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("feed"), F.col("value").alias("xml"))


def _child(item: Column, tag: str) -> Column:
    """Raw text of the first child element."""
    return F.regexp_extract(item, rf"(?is)<{tag}\b[^>]*?(?<!/)>(.*?)</{tag}\s*>", 1)


def _text(raw: Column) -> Column:
    """Element text: character data as it is, the rest with its references resolved."""
    sections = F.regexp_extract_all(raw, F.lit(r"(?s)<!\[CDATA\[(.*?)\]\]>"), 1)
    # & is escaped inside the sections, so one pass of unescape fits both kinds of text
    escaped = F.reduce(sections, raw, lambda acc, s: F.replace(
        acc, F.concat(F.lit("<![CDATA["), s, F.lit("]]>")), F.replace(s, F.lit("&"), F.lit("&amp;"))))
    return unescape(F.when(raw.contains("<![CDATA["), escaped).otherwise(raw))


def _attribute(element: Column, name: str) -> Column:
    return F.regexp_extract(element, rf"""(?is)\s{name}\s*=\s*["']([^"']*)["']""", 1)


def item_image(item: Column, description: Column) -> Column:
    """Image of an item: enclosure, media element, picture in the description, <image>; '' otherwise."""
    media = F.transform(F.regexp_extract_all(item, F.lit(r"(?is)(<[a-z0-9_:]*(?:content|thumbnail)[a-z0-9_:]*\s[^>]*>)"), 1),
                        lambda e: _attribute(e, "url"))
    picture = bind(F.regexp_extract(description, r"(?is)(<img\b[^>]*>)", 1), lambda e: F.coalesce(
        non_empty(_attribute(e, "src")), _attribute(e, "data-src")))
    image = F.coalesce(non_empty(_attribute(F.regexp_extract(item, r"(?is)(<image\b[^>]*>)", 1), "url")),
                       strip(_child(item, "image")))
    kind = "|".join(e.replace(".", r"\.") for e in fv.IMAGE_EXTENSIONS)
    enclosure = F.filter(F.array(_attribute(F.regexp_extract(item, r"(?is)(<enclosure\b[^>]*>)", 1), "url")),
                         lambda u: F.lower(u).rlike(kind))
    linked = F.filter(F.concat(media, F.array(picture, image)), lambda u: u.startswith("http"))
    return unescape(F.coalesce(F.get(enclosure, F.lit(0)), F.get(linked, F.lit(0)), F.lit("")))


def feed_items(feeds: DataFrame, today: str, keep=("feed",), limit: int | None = ITEM_LIMIT, broken: str | None = None) -> DataFrame:
    """The first ``limit`` items of each feed document, all with ``None``; items without title or link are dropped.

    An item is cut out of its document by its tags and parsed by itself, so one broken
    item does not cost a feed; ``broken`` names a column that says which were no XML.
    """
    items = F.regexp_extract_all("xml", F.lit(r"(?is)(<item\b.*?</item\s*>)"), 1)
    if limit is not None:
        items = F.slice(items, 1, limit)
    rows = feeds.select(*keep, F.posexplode(items).alias("position", "_item"))
    item = F.col("_item")
    rows = materialize(rows, _parsed=F.from_xml(item, ITEM, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    # an item that is no well-formed XML is read by patterns
    parsed, faulty = F.col("_parsed"), F.col("_parsed").isNull() | F.col(f"_parsed.{CORRUPT}").isNotNull()
    children = F.array(*[F.when(faulty, _text(_child(item, t))).otherwise(F.coalesce(parsed[t], F.lit(""))) for t in CHILDREN])
    rows = materialize(rows, (*keep, "position", "_item"), _children=children, _broken=faulty)
    title, link, description, date = (F.element_at("_children", i) for i in (1, 2, 3, 4))
    rows = materialize(
        rows, (*keep, "position", "_broken"), _clean=F.transform(F.array(title, description), clean_html), url=strip(link),
        raw_date=F.coalesce(non_empty(strip(date)), F.lit(today)), _bare=description == "",
        image_url=item_image(item, description))
    title, summary = F.element_at("_clean", 1), F.element_at("_clean", 2)
    return (rows.filter((title != "") & (F.col("url") != ""))
            .select(*keep, "position", title.alias("title"), "url", "raw_date",
                    F.when(F.col("_bare"), title).otherwise(summary).alias("summary"), "image_url",
                    *([F.col("_broken").alias(broken)] if broken else [])))


def land_items(items: DataFrame, catalog: DataFrame, rules: TopicRules | None = None, summary_limit: int | None = SUMMARY_LIMIT) -> DataFrame:
    """Items with the language, category and name of their feed, on topic, summary cut at ``summary_limit`` (``None``: whole).

    The topic test sees the whole summary; the cut comes after it.  Items of a feed
    that the catalog lacks stay, with null source, language and category.
    """
    catalog = catalog.select(F.col("feed"), F.col("name").alias("source"), "language", "category")
    rows = items.join(catalog, "feed", "left")
    if rules is not None:
        rows = keep_on_topic(rows, rules)
    return rows if summary_limit is None else rows.withColumn("summary", F.substring("summary", 1, summary_limit))


def fill_from_pages(items: DataFrame, pages: DataFrame) -> DataFrame:
    """Items without an image take it from the landed page of the same url.

    Only the image address of a page enters the join, not its html.
    """
    images = pages.select("url", feed_page_image(text_or_empty(F.col("html"))).alias("_page_image"))
    images = images.filter(F.col("_page_image") != "").groupBy("url").agg(F.min("_page_image").alias("_page_image"))
    return (items.join(images, "url", "left")
            .withColumn("image_url", F.coalesce(non_empty(F.col("image_url")), "_page_image", F.lit("")))
            .drop("_page_image"))
