"""Links and image addresses."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressweave import fixed_values as fv
from pressweave.functions.text import clean_text, contains_any, strip, text_or_empty


def is_http(c: Column) -> Column:
    return c.startswith("http://") | c.startswith("https://")


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1))


def url_path(c: Column) -> Column:
    path = F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*$", "")


def resolve_url(base: Column, href: Column) -> Column:
    joined = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(href, F.lit("/")))
    return F.when(href.startswith("http"), href).otherwise(joined)


def normalize_image_url(c: Column) -> Column:
    t = strip(text_or_empty(c))
    path = F.replace(t, F.lit("\\"), F.lit("/"))
    path = F.regexp_replace(F.regexp_replace(path, "^data/images/", ""), "^images/", "")
    local = F.concat(F.lit("/images/"), F.ltrim(path, F.lit("/")))
    return F.when(t == "", "").when(is_http(t) | t.startswith("/images/"), t).otherwise(local)


def clean_image_url(c: Column, markers=fv.BAD_IMAGE_MARKERS) -> Column:
    """A usable remote image address or ''; wiki thumbnails are asked for at 600 px."""
    t = text_or_empty(c)
    sized = F.when(t.contains("upload.wikimedia.org"), F.regexp_replace(t, r"/\d+px-", "/600px-")).otherwise(t)
    bad = ~t.startswith("http") | contains_any(F.lower(t), markers)
    return F.when(bad, "").otherwise(strip(sized))


def is_remote_image(c: Column) -> Column:
    return is_http(clean_text(c))


def is_wiki_image(c: Column) -> Column:
    host = url_host(clean_text(c))
    test = F.lit(False)
    for suffix in fv.WIKI_HOSTS:
        test = test | host.endswith(suffix)
    return test


def is_article_like_url(c: Column) -> Column:
    """Deep path, a slug with four dashes, or an upper-case id in the slug."""
    path = F.btrim(url_path(clean_text(c)), F.lit("/"))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    slug = F.try_element_at(segments, F.lit(-1))
    dashes = F.length(slug) - F.length(F.replace(slug, F.lit("-"), F.lit("")))
    return F.when(path == "", False).otherwise(
        (F.size(segments) >= 3) | (dashes >= 4) | slug.rlike("[A-Z0-9]{6,}"))
