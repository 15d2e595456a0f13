"""Cards and metadata out of landed pages (url, html), row-local."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressweave.functions.text import clean_html, clean_text, drop_elements, materialize, non_empty, strip, text_or_empty
from pressweave.functions.urls import clean_image_url, resolve_url

HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""
MIN_TITLE = 10


def _pair(tags) -> str:
    return "(?:" + "|".join(tags) + ")"


def _elements(html: Column, tags) -> Column:
    """Outer html of each element with one of the tags (not nested in itself)."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)(<({_pair(tags)})\b[^>]*>.*?</\2\s*>)"), 1)


def _first_element(html: Column, tags) -> Column:
    return F.regexp_extract(html, rf"(?is)(<({_pair(tags)})\b[^>]*>.*?</\2\s*>)", 1)


def page_cards(pages: DataFrame, source: Column, base_url: Column, today: str,
               containers=("article",), titles=("h1", "h2", "h3"), keep=("page_id",),
               max_containers: int = 30, max_headings: int = 40, enough: int = 5) -> DataFrame:
    """(title, url, date) cards per page.

    First pass: containers with a title of ten characters or more and a link.
    When that gives fewer than five cards, headings that hold a link, or are
    inside one, are added.  A title counts once per page.
    """
    # only simple element names go into the patterns; selectors are parameters
    body = F.regexp_replace(F.regexp_replace(text_or_empty(F.col("html")), r"(?s)<!--.*?-->", ""),
                            r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>", "")
    found = F.transform(F.slice(_elements(F.col("_body"), containers), 1, max_containers), lambda e: F.struct(
        clean_html(_first_element(e, titles)).alias("title"),
        strip(F.regexp_extract(e, HREF, 1)).alias("href"),
        F.coalesce(non_empty(F.substring(
            F.regexp_extract(e, r"""(?is)<time\b[^>]*?\bdatetime\s*=\s*["']([^"']*)["']""", 1), 1, 10)),
            F.lit(today)).alias("date")))
    linked = F.regexp_extract_all(F.col("_body"), F.lit(
        r"""(?is)(<a\b[^>]*>\s*<(h[1-3])\b[^>]*>.*?</\2\s*>|<(h[1-3])\b[^>]*>.*?</\3\s*>)"""), 1)
    headings = F.transform(F.slice(linked, 1, max_headings), lambda e: F.struct(
        clean_html(e).alias("title"), strip(F.regexp_extract(e, HREF, 1)).alias("href"), F.lit(today).alias("date")))

    def usable(cards: Column) -> Column:
        good = F.filter(cards, lambda c: (F.length(c["title"]) >= MIN_TITLE) & (c["href"] != ""))
        names = F.transform(good, lambda c: c["title"])
        return F.filter(good, lambda c, i: F.array_position(names, c["title"]) == i + 1)

    step = pages.select(*keep, source.alias("source"), base_url.alias("_base"), body.alias("_body"))
    step = step.withColumn("_cards", usable(found)).withColumn(
        "_more", F.when(F.size("_cards") < enough, usable(headings)))
    taken = F.transform(F.col("_cards"), lambda c: c["title"])
    extra = F.filter(F.coalesce("_more", F.slice("_cards", 1, 0)), lambda c: ~F.array_contains(taken, c["title"]))
    step = step.withColumn("_all", F.when(F.size("_cards") < enough, F.concat("_cards", extra)).otherwise(F.col("_cards")))
    return (step.select(*keep, "source", "_base", F.posexplode("_all").alias("position", "c"))
            .select(*keep, "source", "position", F.col("c.title").alias("title"),
                    resolve_url(F.col("_base"), F.col("c.href")).alias("url"), F.col("c.date").alias("date")))


def meta_raw(html: Column, attribute: str, value: str) -> Column:
    """Raw content of the first <meta attribute="value">, attributes in either order; NULL when absent or empty."""
    name, quote = rf"\b{attribute}\s*=\s*", r"""["']"""
    tag = F.regexp_extract(html, rf"(?is)(<meta\b(?=[^>]*?{name}{quote}{value}{quote})[^>]*>)", 1)
    content = F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*(?:"([^"]*)"|'[^']*')""", 1)
    single = F.regexp_extract(tag, r"""(?is)\bcontent\s*=\s*'([^']*)'""", 1)
    return F.coalesce(non_empty(content), non_empty(single))


def metas(html: Column, *groups) -> Column:
    """array<string>: for each group of (attribute, value) pairs its first non-empty cleaned content, or ''.

    Groups are cleaned together, in one pass over the array.
    """
    first = F.array(*[F.coalesce(*[meta_raw(html, a, v) for a, v in pairs], F.lit("")) for pairs in groups])
    return F.transform(first, lambda v: clean_text(clean_html(v)))


def first_paragraph(html: Column, limit: int = 300, longer_than: int = 60) -> Column:
    """First paragraph of more than 60 characters, outside navigation and scripts, cut at the limit."""
    body = drop_elements(html, "script", "style", "nav", "header", "footer", "aside")
    inner = F.regexp_extract_all(body, F.lit(r"(?is)<p\b[^>]*>(.*?)</p\s*>"), 1)
    texts = F.filter(F.transform(inner, lambda p: clean_text(clean_html(p))), lambda t: F.length(t) > longer_than)
    first = F.coalesce(F.try_element_at(texts, F.lit(1)), F.lit(""))
    return F.when(F.length(first) > limit, F.concat(F.substring(first, 1, limit), F.lit("..."))).otherwise(first)


DESCRIPTION = [("property", "og:description"), ("name", "description"), ("name", "twitter:description")]
IMAGE = [("property", "og:image"), ("name", "twitter:image"), ("property", "twitter:image")]
CAPTION = [("property", "og:image:alt"), ("name", "twitter:image:alt")]
OG_IMAGE = [("property", "og:image"), ("name", "og:image")]
TWITTER_IMAGE = [("property", "twitter:image"), ("name", "twitter:image")]


def page_metadata(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, url, summary, image_url, image_caption) of each page.

    A paragraph is searched only on pages without a description.
    """
    html = text_or_empty(F.col("html"))
    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    step = materialize(pages.select(key, "url", "html"), _meta=metas(html, DESCRIPTION, IMAGE, CAPTION))
    description, image, caption = (F.element_at("_meta", i) for i in (1, 2, 3))
    step = materialize(step, (key, "url", "_meta"),
                       summary=F.when(description != "", description).otherwise(first_paragraph(html)))
    return step.select(
        key, "url", "summary",
        F.when(image == "", "").otherwise(resolve_url(base, image)).alias("image_url"),
        F.coalesce(non_empty(caption), F.col("summary")).alias("image_caption"))


def page_image(html: Column) -> Column:
    """Usable preview image: og:image, then twitter:image; '' otherwise."""
    usable = F.filter(F.transform(metas(html, OG_IMAGE, TWITTER_IMAGE), lambda u: clean_image_url(u)), lambda u: u != "")
    return F.coalesce(F.try_element_at(usable, F.lit(1)), F.lit(""))


def feed_page_image(html: Column) -> Column:
    """Page image for feed items: og:image, twitter:image, then the first picture unless it is a logo or icon."""
    first = F.regexp_extract(html, r"(?is)(<img\b[^>]*>)", 1)
    src = F.coalesce(*[non_empty(F.regexp_extract(first, rf"""(?is)\s{a}\s*=\s*["']([^"']*)["']""", 1))
                       for a in ("src", "data-src")], F.lit(""))
    plain = F.when(~F.lower(src).rlike("logo|icon"), src).otherwise("")
    choices = F.concat(metas(html, OG_IMAGE, TWITTER_IMAGE), F.array(plain))
    return F.coalesce(F.try_element_at(F.filter(choices, lambda u: u.startswith("http")), F.lit(1)), F.lit(""))
