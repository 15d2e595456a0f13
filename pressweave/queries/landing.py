"""Queries on sources: CSV, feeds, pages, caches, catalog."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressweave import fixed_values as fv
from pressweave.operators import catalog as ct
from pressweave.operators.joins import resolve_images
from pressweave.plans.views import docs, pages, table
from pressweave.queries import params as p
from pressweave.queries import sql as s
from pressweave.queries.annotation import ANNOTATED_SQL, MERGE_IMAGE, RULES, annotated
from pressweave.sources import cardtree as ct_pages
from pressweave.sources import feeds as fd
from pressweave.sources import pages as pg
from pressweave.sources import tables as tb

QUERIES: dict = {}


def query(name, sql):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return register


@query("csv_scan", f"WITH {s.DOCS} SELECT doc_id, title, md5(summary) AS summary, source FROM docs")
def csv_scan(spark, sf):
    """Documents exported as CSV files and read back with string columns."""
    path = tb.shared_dir(spark, "csv")
    tb.write_csv(docs(spark, sf).select("doc_id", "title", "summary", "source", F.lit("x").alias("resume")), path)
    back = tb.read_csv(spark, path)
    return back.select(F.col("doc_id").cast("bigint").alias("doc_id"), "title", F.md5("summary").alias("summary"), "source")


@query("seed_union", f"""WITH {s.DOCS} SELECT title, source, language, NULL AS item_id FROM docs
UNION ALL SELECT split_part(text, chr(10), 1), NULL, NULL, item_id FROM benchmark""")
def seed_union(spark, sf):
    seeds = table(spark, sf, "benchmark").select(F.substring_index("text", "\n", 1).alias("title"), "item_id")
    return tb.append_missing(docs(spark, sf).select("title", "source", "language"), seeds)


@query("cache_scan", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def cache_scan(spark, sf):
    return tb.explode_cache(table(spark, sf, "events"), "props", "event_id")


@query("cache_append", """WITH c AS (SELECT c_name AS key, c_mktsegment AS value FROM customer WHERE c_custkey % 2 = 0)
SELECT * FROM c UNION ALL SELECT c_name, 'new' FROM customer WHERE c_name NOT IN (SELECT key FROM c)""")
def cache_append(spark, sf):
    customers = table(spark, sf, "customer")
    known = customers.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("key"), F.col("c_mktsegment").alias("value"))
    return tb.append_cache(known, customers.select(F.col("c_name").alias("key"), F.lit("new").alias("value")))


def landed_feeds(spark, sf) -> DataFrame:
    """Each document as a feed of its own: one item per line."""
    def esc(c):
        return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))

    def item(line, i):
        link = F.concat(F.lit("https://n.example.org/"), F.col("doc_id").cast("string"), F.lit("/"), i.cast("string"))
        img = F.concat(F.lit("https://i.example.org/"), i.cast("string"), F.lit(".jpg"))
        picture = (F.when(i % 5 == 0, F.concat(F.lit('<enclosure url="'), img, F.lit('" type="image/jpeg"/>')))
                   .when(i % 5 == 1, F.concat(F.lit('<media:content url="'), img, F.lit('"/>')))
                   .when(i % 5 == 2, F.concat(F.lit("<image>"), img, F.lit("</image>"))).otherwise(""))
        body = F.when(i % 5 == 3, F.concat(F.lit('&lt;img src="'), img, F.lit('"&gt;'))).otherwise("")
        description = F.when(i % 7 == 6, "").otherwise(F.concat(F.lit("<description>"), body, F.lit("&lt;b&gt;"), esc(line), F.lit("&lt;/b&gt;</description>")))
        date = F.when(i % 3 == 0, F.lit("<pubDate>Tue, 02 Jan 2024</pubDate>")).otherwise("")
        return F.concat(F.lit("<item><title>"), esc(F.substring(line, 1, 80)), F.lit("</title><link>"), link, F.lit("</link>"), description, date, picture, F.lit("</item>"))

    lines = F.transform(F.split("text", "\n"), item)
    return table(spark, sf, "documents").select(
        "doc_id", "source", F.concat(F.lit("<rss><channel><title>f</title>"), F.array_join(lines, ""), F.lit("</channel></rss>")).alias("xml"))


FEED = f"""lines AS (SELECT doc_id, source, lang, text_lines[i] AS line, i - 1 AS i FROM (SELECT doc_id, source, lang, string_split(text, chr(10)) AS text_lines,
  unnest(range(1, len(text_lines) + 1)) AS i FROM documents)),
f0 AS (SELECT *, {s.strip(s.collapse("substr(line, 1, 80)"))} AS title, 'https://n.example.org/' || doc_id || '/' || i AS url,
 'https://i.example.org/' || i || '.jpg' AS img, {s.strip(s.collapse('line'))} AS body FROM lines),
items AS (SELECT doc_id, source, lang, i AS position, title, url, CASE WHEN i % 3 = 0 THEN 'Tue, 02 Jan 2024' ELSE '{p.TODAY}' END AS raw_date,
 CASE WHEN i % 7 = 6 THEN title ELSE body END AS summary, CASE WHEN i % 5 < 3 OR (i % 5 = 3 AND i % 7 <> 6) THEN img ELSE '' END AS image_url FROM f0 WHERE title <> '')"""


@query("feed_items", f"WITH {FEED} SELECT doc_id, position, title, url, raw_date, md5(summary) AS summary FROM items")
def feed_items(spark, sf):
    items = fd.feed_items(landed_feeds(spark, sf), p.TODAY, keep=("doc_id",), limit=None)
    return items.select("doc_id", F.col("position").cast("bigint").alias("position"), "title", "url", "raw_date", F.md5("summary").alias("summary"))


@query("feed_images", f"WITH {FEED} SELECT url, image_url FROM items")
def feed_images(spark, sf):
    return fd.feed_items(landed_feeds(spark, sf), p.TODAY, keep=("doc_id",), limit=None).select("url", "image_url")


@query("feed_landing", f"""WITH {FEED}, n AS (SELECT *, {s.norm("title || ' ' || summary")} AS norm FROM items)
SELECT url, source, lang AS language, summary FROM n WHERE norm <> '' AND NOT {s.contains_any(s.norm('source'), p.BLOCKED)}
AND ({s.hit('norm', RULES.entities + RULES.orgs)} OR (({s.any_pattern('norm', p.TOPIC)} OR {s.contains_any("(title || ' ' || summary)", p.TOPIC_RAW)}) AND NOT {s.any_pattern('norm', p.OFF_TOPIC)}))""")
def feed_landing(spark, sf):
    catalog = table(spark, sf, "documents").select(
        F.col("doc_id").alias("feed"), F.col("source").alias("name"), F.col("lang").alias("language"), F.col("lang").alias("category"))
    items = fd.feed_items(landed_feeds(spark, sf).withColumnRenamed("doc_id", "feed"), p.TODAY, limit=None)
    return fd.land_items(items, catalog, RULES, summary_limit=None).select("url", "source", "language", "summary")


@query("feed_unknown", f"""WITH {FEED} SELECT url, CASE WHEN doc_id % 2 = 0 THEN source END AS source, CASE WHEN doc_id % 2 = 0 THEN lang END AS language, md5(substr(summary, 1, 400)) AS summary
FROM items WHERE position < 25""")
def feed_unknown(spark, sf):
    """The limits of a landing run, and feeds that the catalog lacks."""
    catalog = table(spark, sf, "documents").filter("doc_id % 2 = 0").select(
        F.col("doc_id").alias("feed"), F.col("source").alias("name"), F.col("lang").alias("language"), F.col("lang").alias("category"))
    items = fd.feed_items(landed_feeds(spark, sf).withColumnRenamed("doc_id", "feed"), p.TODAY)
    return fd.land_items(items, catalog).select("url", "source", "language", F.md5("summary").alias("summary"))


BASE = "regexp_extract(url, '^(https?://[^/?#]+)', 1)"


CARDS_SQL = f"""WITH b AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g') AS h FROM pages),
l AS (SELECT page_id, url, unnest(regexp_extract_all(h, '(?is)<li\\b[^>]*>.*?</li\\s*>')[:30]) AS e, generate_subscripts(regexp_extract_all(h, '(?is)<li\\b[^>]*>.*?</li\\s*>')[:30], 1) AS i FROM b),
t AS (SELECT page_id, url, i, trim(regexp_replace(regexp_extract(e, '(?is)<a\\b[^>]*>(.*?)</a\\s*>', 1), '<[^>]*>', '', 'g')) AS title, regexp_extract(e, 'href="([^"]*)"', 1) AS href FROM l),
u AS (SELECT *, row_number() OVER (PARTITION BY page_id, title ORDER BY i) AS k FROM t WHERE length(title) >= 10 AND href <> '')
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS position, title, CASE WHEN starts_with(href, 'http') THEN href ELSE {BASE} || '/' || ltrim(href, '/') END AS url,
 '{p.TODAY}' AS date FROM u WHERE k = 1"""


@query("page_cards", CARDS_SQL)
def page_cards(spark, sf):
    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    cards = pg.page_cards(pages(spark, sf), base, base, p.TODAY, containers=("li",), titles=("a",))
    return cards.select("page_id", F.col("position").cast("bigint").alias("position"), "title", "url", "date")


@query("page_cards_tree", CARDS_SQL)
def page_cards_tree(spark, sf):
    """The same cards from a parsed page."""
    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    cards = ct_pages.page_cards(pages(spark, sf), base, base, p.TODAY, containers=("li",), titles=("a",), enough=0)
    return cards.select("page_id", F.col("position").cast("bigint").alias("position"), "title", "url", "date")


@query("page_cards_headings", f"""WITH h AS (SELECT page_id, regexp_extract_all(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1) AS hs FROM pages),
t AS (SELECT page_id, i, trim(regexp_replace(replace(replace(replace(replace(hs[i], '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM (SELECT page_id, hs, unnest(range(1, least(len(hs), 40) + 1)) AS i FROM h))
SELECT page_id, title, 'https://n.example.org/p/' || page_id AS url, '{p.TODAY}' AS date FROM t WHERE length(title) >= 10
QUALIFY row_number() OVER (PARTITION BY page_id, title ORDER BY i) = 1""")
def page_cards_headings(spark, sf):
    """Headings deep inside a link: the page's body stands in one."""
    linked = pages(spark, sf).withColumn("html", F.concat(F.lit('<a href="/p/'), F.col("page_id").cast("string"), F.lit('"><div>'), "html", F.lit("</div></a>")))
    base = F.lit("https://n.example.org")
    return ct_pages.page_cards(linked, base, base, p.TODAY, containers=("none",)).filter("by_heading").select("page_id", "title", "url", "date")


PARAGRAPH_SQL = f"""b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
 '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'), '(?is)<nav\\b[^>]*>.*?</nav\\s*>', ' ', 'g'),
 '(?is)<header\\b[^>]*>.*?</header\\s*>', ' ', 'g'), '(?is)<footer\\b[^>]*>.*?</footer\\s*>', ' ', 'g'), '(?is)<aside\\b[^>]*>.*?</aside\\s*>', ' ', 'g') AS h FROM pages),
l AS (SELECT page_id, url, regexp_extract_all(h, '(?is)<p\\b[^>]*>(.*?)</p\\s*>', 1) AS ps FROM b),
t AS (SELECT page_id, url, list_filter(list_transform(ps, lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\\s+', ' ', 'g'))), lambda x: length(x) > 60) AS ts FROM l),
f AS (SELECT page_id, url, CASE WHEN length(coalesce(ts[1], '')) > 300 THEN substr(ts[1], 1, 300) || '...' ELSE coalesce(ts[1], '') END AS summary FROM t)"""


@query("page_metadata", f"WITH {PARAGRAPH_SQL} SELECT page_id, url, summary, '' AS image_url, summary AS image_caption FROM f")
def page_metadata(spark, sf):
    return pg.page_metadata(pages(spark, sf))


def with_head(html, page_id):
    """A page whose head names a preview image, and a description on every third page."""
    i = page_id.cast("string")
    image = F.when(page_id % 2 == 0, F.concat(F.lit('<meta property="og:image" content="https://p.example.org/'), i, F.lit('.jpg">')))
    text = F.when(page_id % 3 == 0, F.concat(F.lit('<meta name="description" content="Page '), i, F.lit(' &amp; more">')))
    return F.concat_ws("", image, text, html)


@query("feed_page_images", """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'https://i.example.org/own.jpg' WHEN page_id % 2 = 0
 THEN 'https://p.example.org/' || page_id || '.jpg' ELSE '' END AS image_url FROM pages""")
def feed_page_images(spark, sf):
    """Items without a picture take that of their landed page."""
    i = F.col("page_id")
    landed = pages(spark, sf).select("page_id", F.concat(F.lit("https://n.example.org/"), i.cast("string")).alias("url"), with_head(F.col("html"), i).alias("html"))
    items = landed.select("page_id", "url", F.when(i % 5 == 0, "https://i.example.org/own.jpg").otherwise("").alias("image_url"))
    return fd.fill_from_pages(items, landed.select("url", "html")).select("page_id", "image_url")


@query("page_descriptions", f"""WITH {PARAGRAPH_SQL} SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Page ' || page_id || ' & more' ELSE summary END AS summary,
 CASE WHEN page_id % 2 = 0 THEN 'https://p.example.org/' || page_id || '.jpg' ELSE '' END AS image_url FROM f""")
def page_descriptions(spark, sf):
    """Pages that state a description or an image themselves, and pages that do not."""
    i = F.col("page_id")
    return pg.page_metadata(pages(spark, sf).withColumn("html", with_head(F.col("html"), i))).select("page_id", "summary", "image_url")


@query("catalog_expand", f"""WITH n AS (SELECT c_mktsegment AS cat, c_custkey, c_name, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) // 5 AS chunk FROM customer),
g AS (SELECT cat, chunk, '(' || string_agg('"' || c_name || '"', ' OR ' ORDER BY c_custkey) || ')' AS names, arg_min(split_part(c_name, '#', 2), c_custkey) AS short FROM n GROUP BY 1, 2),
cfg AS (SELECT * FROM {s.values([('BUILDING', 'en'), ('BUILDING', 'ar'), ('MACHINERY', 'de')], 'cat, language', 'v')}),
r AS (SELECT g.*, language FROM g JOIN cfg USING (cat) UNION ALL SELECT g.*, x.language FROM g, (VALUES ('fr'), ('en')) x(language) WHERE cat NOT IN (SELECT cat FROM cfg))
SELECT cat AS category, chunk, r.language, 'VIP ' || upper(r.language) || ' (' || short || '...)' AS name,
 '{fv.FEED_SEARCH_URL}' || replace(url_encode(names || ' ' || k.words || ' when:24h'), '%2F', '/') || '&' || e.edition AS url, 0.88 AS credibility
FROM r JOIN {s.values(list(fv.SEARCH_KEYWORDS.items()), 'language, words', 'k')} ON k.language = r.language
JOIN {s.values(list(fv.EDITIONS.items()), 'language, edition', 'e')} ON e.language = r.language""")
def catalog_expand(spark, sf):
    names = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("segment"), "c_name", F.split_part("c_name", F.lit("#"), F.lit(2)).alias("short"), "c_custkey")
    groups = ct.name_groups(names, "segment", "c_name", "short", "c_custkey")
    configs = ct.language_configs(spark, {"BUILDING": ["en", "ar"], "MACHINERY": ["de"]})
    return ct.person_feeds(groups, "segment", configs)


@query("catalog_coaches", f"""WITH n AS (SELECT s_nationkey AS cat, s_suppkey, s_name, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) // 5 AS chunk FROM supplier),
g AS (SELECT cat, chunk, '(' || string_agg('"' || s_name || '"', ' OR ' ORDER BY s_suppkey) || ')' AS names, arg_min(s_name, s_suppkey) AS short FROM n GROUP BY 1, 2)
SELECT '{fv.COACH_CATEGORY}' AS category, chunk, x.language, 'Coach Search ' || upper(x.language) || ' (' || short || '...)' AS name,
 '{fv.FEED_SEARCH_URL}' || replace(url_encode(names || ' ' || k.words || ' when:24h'), '%2F', '/') || '&' || e.edition AS url, 0.85 AS credibility
FROM g, (VALUES ('fr'), ('en')) x(language) JOIN {s.values(list(fv.SEARCH_KEYWORDS.items()), 'language, words', 'k')} ON k.language = x.language
JOIN {s.values(list(fv.EDITIONS.items()), 'language, edition', 'e')} ON e.language = x.language""")
def catalog_coaches(spark, sf):
    names = table(spark, sf, "supplier").select("s_nationkey", "s_name", F.col("s_name").alias("short"), "s_suppkey")
    return ct.coach_feeds(ct.name_groups(names, "s_nationkey", "s_name", "short", "s_suppkey"), "s_nationkey")


# image cache by person and organisation; page images by url
IMAGE_ROWS = f"""{ANNOTATED_SQL}, img AS (SELECT doc_id, entity, org_from, org_to, CASE WHEN doc_id % 5 = 0 THEN {MERGE_IMAGE} WHEN doc_id % 5 = 1 THEN 'https://x.example.org/pixel.gif' ELSE '' END AS own,
 'https://n.example.org/' || doc_id AS url FROM scored),
cache AS (SELECT key, 'https://c.example.org/' || substr(md5(key), 1, 8) || '.png' AS value FROM (SELECT DISTINCT lower(o_key) AS key FROM (
 SELECT 'player:' || entity AS o_key FROM scored WHERE length(entity) % 2 = 0 UNION ALL SELECT 'badge:' || org_to FROM scored WHERE length(org_to) = 6))),
pageimg AS (SELECT 'https://n.example.org/' || page_id AS url, 'https://p.example.org/' || page_id || '.jpg' AS image FROM pages WHERE page_id % 2 = 0),
keyed AS (SELECT *, CASE WHEN starts_with(own, 'http') AND NOT {s.contains_any('lower(own)', fv.BAD_IMAGE_MARKERS)} THEN own END AS good,
 CASE WHEN entity NOT IN {s.lst(fv.IMAGE_ENTITY_PLACEHOLDERS)} AND length(entity) >= 3 THEN 'player:' || lower(entity) END AS k1,
 'badge:' || lower(org_to) AS k2, 'badge:' || lower(org_from) AS k3 FROM img)"""


def badge_case(c):
    return "CASE " + " ".join(f"WHEN contains(lower({c}), {s.q(k.lower())}) THEN {s.q(v)}" for k, v in p.BADGES.items()) + " END"


IMAGE_SQL = f"""coalesce(good, c1.value, CASE WHEN org_to <> '' THEN coalesce(c2.value, {badge_case('org_to')}) END,
 CASE WHEN org_from <> '' THEN coalesce(c3.value, {badge_case('org_from')}) END, pi.image, '')"""
IMAGE_FROM = """keyed d LEFT JOIN cache c1 ON c1.key = k1 LEFT JOIN cache c2 ON c2.key = k2 LEFT JOIN cache c3 ON c3.key = k3 LEFT JOIN pageimg pi ON pi.url = d.url"""


def image_inputs(spark, sf):
    d = F.col("doc_id")
    # the rows and the cache keys both come from the annotation, so it is written once
    rows = tb.settle(annotated(spark, sf).select("doc_id", "entity", "org_from", "org_to", "title", "source"), "annotated").select(
        "*",
        F.when(d % 5 == 0, F.expr(MERGE_IMAGE)).when(d % 5 == 1, "https://x.example.org/pixel.gif").otherwise("").alias("image_url"),
        F.concat(F.lit("https://n.example.org/"), d.cast("string")).alias("url"))
    keys = rows.select(F.explode(F.array(
        F.when(F.length("entity") % 2 == 0, F.concat(F.lit("player:"), F.lower("entity"))),
        F.when(F.length("org_to") == 6, F.concat(F.lit("badge:"), F.lower("org_to"))))).alias("key")).filter(F.col("key").isNotNull()).distinct()
    cache = keys.select("key", F.concat(F.lit("https://c.example.org/"), F.substring(F.md5("key"), 1, 8), F.lit(".png")).alias("value"))
    # every other page is given a preview image in its head
    i = F.col("page_id")
    head = F.when(i % 2 == 0, F.concat(F.lit('<meta property="og:image" content="https://p.example.org/'), i.cast("string"), F.lit('.jpg">'))).otherwise("")
    page_images = table(spark, sf, "pages").select(
        F.concat(F.lit("https://n.example.org/"), i.cast("string")).alias("url"), pg.page_image(F.concat(head, F.col("html"))).alias("image_url"))
    return rows, cache, page_images


@query("image_resolve", f"WITH {IMAGE_ROWS} SELECT doc_id, {IMAGE_SQL} AS image FROM {IMAGE_FROM}")
def image_resolve(spark, sf):
    rows, cache, page_images = image_inputs(spark, sf)
    return resolve_images(rows, "doc_id", cache, p.BADGES, page_images).select("doc_id", F.col("best_image").alias("image"))

