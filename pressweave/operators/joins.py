"""Lookup joins: badge and image resolution, token-overlap titles."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressweave import fixed_values as fv
from pressweave.functions.text import materialize, non_empty, strip, text_or_empty, tokenize
from pressweave.functions.urls import clean_image_url, is_article_like_url, is_wiki_image
from pressweave.operators.score import contained_value, first_contained
from pressweave.sources.tables import settle

SALT_ROWS = 10_000


def needs_summary(summary: Column) -> Column:
    return strip(text_or_empty(summary)).isin("", "nan")


def needs_image(image: Column) -> Column:
    value = strip(text_or_empty(image))
    return value.isin("", "nan") | is_wiki_image(value)


def needs_page(url: Column, summary: Column, image: Column) -> Column:
    """The landed page is worth reading for this row."""
    return is_article_like_url(url) & (needs_summary(summary) | needs_image(image))


def resolve_images(df: DataFrame, key: str, cache: DataFrame, badges: dict[str, str] | DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Add ``best_image``: own image, person, buyer badge, seller badge, page image, ''; ``key`` is unique.

    ``cache`` holds (key, value): ``player:<name>`` and ``badge:<organisation>`` in lower
    case; of a key that repeats the smallest value counts, as with pages of one url.
    ``badges`` are a parameter table or a table (key, value, ord) of any size.  Only
    the keys of rows without an image of their own travel, all kinds in one join, and
    one narrow row per hit comes back.  The rows are written once to the shared folder,
    as every kind of lookup reads them and the result does.
    """
    df = settle(df, "image-rows")
    entity = strip(text_or_empty(F.col("entity")))
    entity = F.when(~entity.isin(fv.IMAGE_ENTITY_PLACEHOLDERS) & (F.length(entity) >= 3), F.lower(entity))

    def org(c):
        raw = text_or_empty(F.col(c))
        return F.when(~raw.isin("", *fv.IMAGE_ORG_PLACEHOLDERS), strip(raw))

    url = text_or_empty(F.col("url"))
    wants_page = url.startswith("http") & ~url.contains(fv.NO_PAGE_IMAGE_HOST)
    own = non_empty(clean_image_url(F.col("image_url")))
    wanting = df.select(F.col(key).alias("_id"), own.alias("_own"), entity.alias("_entity"), org("org_to").alias("_to"), org("org_from").alias("_from"),
                        F.when(wants_page, url).alias("_url")).filter("_own IS NULL").drop("_own")

    def asked(place: int, k: Column) -> Column:
        return F.struct(F.lit(place).alias("_place"), k.alias("_key"))

    known = cache.filter(F.col("value") != "").groupBy(F.col("key").alias("_key")).agg(F.min("value").alias("_value"))
    lookups = [asked(1, F.concat(F.lit("player:"), "_entity")), asked(2, F.concat(F.lit("badge:"), F.lower("_to"))), asked(4, F.concat(F.lit("badge:"), F.lower("_from")))]
    if pages is not None:
        # the url of a page is a key like the others, told apart by a mark no name begins with
        image = clean_image_url(F.col("image_url"))
        shown = pages.select(F.concat(F.lit("\u0001"), "url").alias("_key"), image.alias("_value")).filter("_value <> ''")
        known = known.unionByName(shown.groupBy("_key").agg(F.min("_value").alias("_value")))
        lookups.append(asked(6, F.concat(F.lit("\u0001"), "_url")))
    keys = wanting.select("_id", F.inline(F.filter(F.array(*lookups), lambda x: x["_key"].isNotNull())))
    hits = keys.join(known, "_key").select("_id", "_place", "_value")
    for place, side in ((3, "_to"), (5, "_from")):
        if isinstance(badges, DataFrame):
            named = contained_value(wanting.select("_id", side).filter(F.col(side).isNotNull()), side, badges, "_value")
        else:
            named = wanting.select("_id", non_empty(first_contained(F.col(side), badges)).alias("_value"))
        hits = hits.unionByName(named.filter("_value <> ''").select("_id", F.lit(place).alias("_place"), "_value"))
    best = hits.groupBy("_id").agg(F.min(F.struct("_place", "_value")).alias("_best")).select("_id", F.col("_best._value").alias("_found"))
    out = df.withColumn("_id", F.col(key)).join(best, "_id", "left")
    return out.withColumn("best_image", F.coalesce(own, "_found", F.lit(""))).drop("_id", "_found")


def needed_overlap(size: Column) -> Column:
    """Tokens that must be shared, from the number of title tokens."""
    return (F.when(size <= 2, size).when(size <= 4, F.lit(2))
            .otherwise(F.greatest(F.lit(2), F.floor(size / 3)).cast("int")))


def title_matches(title: Column, candidate: Column) -> Column:
    """The same test for one pair of texts in one row."""
    t, c = tokenize(title), tokenize(candidate)
    shared = F.size(F.array_intersect(t, c))
    return (F.size(t) > 0) & (F.size(c) > 0) & (shared >= needed_overlap(F.size(t)))


def token_overlap_join(titles: DataFrame, title_key: str, title: str,
                       candidates: DataFrame, candidate_key: str, candidate: str,
                       stop_words=fv.STOP_WORDS, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(title_key, candidate_key, overlap) for all pairs that pass the overlap test; keys are unique.

    Exact, without comparing all pairs.  Tokens have one order, rarest in the
    candidates first.  Of the n title tokens that occur in any candidate at least t
    must be shared, so one of the first n-t+1 is: only those are joined, and a token
    found in many candidates is joined only for titles that have nothing rarer.  A
    pair is taken up at its first shared token alone: with the places of that token in
    both orders, and the tokens behind them, it is dropped unless enough can still be
    shared.  The postings of a token in more than ``salt_rows`` candidates are dealt to
    several keys, which its titles are copied to, so no token loads one task.
    """
    t = titles.select(F.col(title_key).alias("_t"), tokenize(F.col(title), stop_words).alias("_tokens"))
    t = materialize(t, ("_t", "_tokens"), _need=needed_overlap(F.size("_tokens"))).filter(F.size("_tokens") > 0)
    # read three times below, so the candidates are scanned and cut into tokens once
    postings = settle(candidates.select(F.col(candidate_key).alias("_c"), F.explode(tokenize(F.col(candidate), stop_words)).alias("_token")), "postings")
    frequency = settle(postings.groupBy("_token").agg(F.count(F.lit(1)).alias("_df")), "token-counts")

    def placed(rows: DataFrame, owner: str, *keep: str) -> DataFrame:
        """Each token with its place in its owner's order (from 0) and the number of tokens; a window sees the tokens of one text."""
        own, order = Window.partitionBy(owner), Window.partitionBy(owner).orderBy("_df", "_token")
        ranked = rows.join(frequency, "_token").select(owner, *keep, "_token", "_df", (F.row_number().over(order) - 1).alias("_at"), F.count(F.lit(1)).over(own).alias("_n"))
        salts = F.ceil(F.col("_df") / salt_rows).cast("int")
        return ranked.withColumn("_salts", salts)

    titled = settle(placed(t.select("_t", "_need", F.explode("_tokens").alias("_token")), "_t", "_need").filter("_n >= _need"), "title-tokens")
    probes = titled.filter("_at <= _n - _need").select("_t", "_need", "_token", F.col("_at").alias("_ta"), F.col("_n").alias("_tn"),
                                                       F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    found = placed(postings, "_c").select("_c", "_token", F.col("_at").alias("_ca"), F.col("_n").alias("_cn"), F.pmod(F.xxhash64("_c"), "_salts").cast("int").alias("_salt"))
    pairs = (probes.join(found, ["_token", "_salt"]).filter(1 + F.least(F.col("_tn") - F.col("_ta"), F.col("_cn") - F.col("_ca")) > F.col("_need"))
             .select("_t", "_c", "_need").distinct())
    # neither texts nor arrays travel with a pair: overlap is counted on (title, token) and (candidate, token)
    counted = pairs.join(titled.select("_t", "_token"), "_t").join(postings, ["_c", "_token"]).groupBy("_t", "_c", "_need").agg(F.count(F.lit(1)).alias("overlap"))
    return counted.filter(F.col("overlap") >= F.col("_need")).select(F.col("_t").alias(title_key), F.col("_c").alias(candidate_key), "overlap")
