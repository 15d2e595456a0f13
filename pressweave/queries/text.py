"""Queries on scalar functions: text, values, urls."""
from __future__ import annotations

from pyspark.sql import functions as F

from pressweave import fixed_values as fv
from pressweave.functions import text as tx
from pressweave.functions import urls as ux
from pressweave.functions import values as vx
from pressweave.plans.views import docs, pages, published, table
from pressweave.queries import sql as s
from pressweave.sources.aliases import canonical_columns, first_by_alias, first_by_column

QUERIES: dict = {}


def query(name, sql):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return register


def digest(c, name):
    return [F.md5(c).alias(name), F.length(c).cast("bigint").alias(name + "_len")]


def sql_digest(x, name):
    return f"md5({x}) AS {name}, length({x}) AS {name}_len"


# values with padding and missing markers, derived from each document
ODD = """CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN ' NaN ' WHEN 2 THEN 'None' WHEN 3 THEN '  ' || title || ' '
 WHEN 4 THEN 'null' WHEN 5 THEN 'NaT' ELSE title END"""


@query("clean_values", f"""WITH {s.DOCS}, v AS (SELECT doc_id, {ODD} AS v FROM docs)
SELECT doc_id, {s.clean_value('v')} AS value FROM v""")
def clean_values(spark, sf):
    v = docs(spark, sf).select("doc_id", F.expr(ODD.replace("title", "title")).alias("v"))
    return v.select("doc_id", tx.clean_value(F.col("v")).alias("value"))


@query("polish_text", f"""WITH {s.DOCS}, o AS (SELECT doc_id, {s.polish('summary')} AS v FROM docs)
SELECT doc_id, {sql_digest('v', 'polished')} FROM o""")
def polish_text(spark, sf):
    v = docs(spark, sf).select("doc_id", tx.polish_text(F.col("summary")).alias("v"))
    return v.select("doc_id", *digest(F.col("v"), "polished"))


@query("shorten_text", f"""WITH {s.DOCS} SELECT doc_id, {s.shorten('title', 60)} AS title,
{s.shorten('summary', 220)} AS summary FROM docs""")
def shorten_text(spark, sf):
    return docs(spark, sf).select("doc_id", tx.shorten(F.col("title"), 60).alias("title"),
                                  tx.shorten(F.col("summary"), 220).alias("summary"))


NUMBERS = """CASE l_linenumber % 5 WHEN 0 THEN CAST(l_quantity AS VARCHAR(40)) WHEN 1 THEN '' WHEN 2 THEN
 concat(' ', CAST(l_orderkey AS VARCHAR(20)), '.5 ') WHEN 3 THEN concat(CAST(l_orderkey AS VARCHAR(20)), 'x') ELSE NULL END"""


@query("parse_numbers", f"""SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(trim(coalesce(v, '')),
 '^[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast(trim(v) AS DOUBLE) ELSE 0.0 END AS number
FROM (SELECT l_orderkey, l_linenumber, {NUMBERS} AS v FROM lineitem)""")
def parse_numbers(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", vx.parse_float(F.expr(NUMBERS)).alias("number"))


DATES = """CASE o_orderkey % 6 WHEN 0 THEN {iso} WHEN 1 THEN {dmy} WHEN 2 THEN {ymd} WHEN 3 THEN 'Tue, 02 Jan 2024 10:00:00'
 WHEN 4 THEN '' ELSE concat({iso}, 'T10:00:00Z') END"""
SPARK_DATES = DATES.format(iso="date_format(o_orderdate, 'yyyy-MM-dd')", dmy="date_format(o_orderdate, 'd/M/yyyy')",
                           ymd="date_format(o_orderdate, 'yyyy/M/d')")
SQL_DATES = DATES.format(iso="strftime(o_orderdate, '%Y-%m-%d')", dmy="strftime(o_orderdate, '%-d/%-m/%Y')",
                         ymd="strftime(o_orderdate, '%Y/%-m/%-d')")


@query("parse_dates", f"""SELECT o_orderkey, {s.parse_date('v')} AS published_at
FROM (SELECT o_orderkey, {SQL_DATES} AS v FROM orders)""")
def parse_dates(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", vx.parse_date(F.expr(SPARK_DATES)).alias("published_at"))


IMAGES = """CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN concat('https://img.example.org/', source, '.jpg')
 WHEN 2 THEN concat('data/images/', source, '.png') WHEN 3 THEN concat('images/', source) WHEN 4 THEN concat('/images/', source)
 WHEN 5 THEN concat('https://upload.wikimedia.org/a/120px-', source, '.png') WHEN 6 THEN 'https://t.example.org/Pixel.gif'
 ELSE concat('data', chr(92), 'images', chr(92), source) END"""


@query("image_urls", f"""WITH {s.DOCS}, v AS (SELECT doc_id, {IMAGES} AS u FROM docs)
SELECT doc_id, CASE WHEN u = '' THEN '' WHEN starts_with(u, 'http://') OR starts_with(u, 'https://') OR starts_with(u, '/images/')
 THEN u ELSE '/images/' || ltrim(regexp_replace(regexp_replace(replace(u, chr(92), '/'), '^data/images/', ''), '^images/', ''), '/') END AS stored,
 CASE WHEN NOT starts_with(u, 'http') OR {s.contains_any('lower(u)', fv.BAD_IMAGE_MARKERS)} THEN ''
 WHEN contains(u, 'upload.wikimedia.org') THEN regexp_replace(u, '/\\d+px-', '/600px-', 'g') ELSE u END AS usable,
 starts_with(u, 'http') AS remote, regexp_matches(u, '^https?://[^/]*(wikipedia|wikimedia)\\.org(/|$)') AS wiki FROM v""")
def image_urls(spark, sf):
    u = F.col("u")
    return docs(spark, sf).select("doc_id", F.expr(IMAGES).alias("u")).select(
        "doc_id", ux.normalize_image_url(u).alias("stored"), ux.clean_image_url(u).alias("usable"),
        ux.is_remote_image(u).alias("remote"), ux.is_wiki_image(u).alias("wiki"))


def drifting(spark, sf):
    """Documents under drifting column names, empty in places."""
    return docs(spark, sf).select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, "nan").otherwise(F.col("title")).alias("Titre"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("t "), F.col("source"))).alias("TITLE.1"),
        F.when(F.col("doc_id") % 2 == 0, F.col("summary")).alias("resume"),
        F.when(F.col("doc_id") % 5 == 0, F.col("title")).otherwise("").alias("summary"),
        F.col("source").alias("Source"))


@query("alias_resolve", f"""WITH {s.DOCS}, v AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'nan' ELSE title END AS titre,
 CASE WHEN doc_id % 3 = 0 THEN 't ' || source END AS title1, CASE WHEN doc_id % 2 = 0 THEN summary END AS resume,
 CASE WHEN doc_id % 5 = 0 THEN title ELSE '' END AS summary FROM docs)
SELECT doc_id, coalesce(nullif({s.clean_value('title1')}, ''), nullif({s.clean_value('titre')}, ''), '') AS title,
 md5(coalesce(nullif({s.clean_value('summary')}, ''), nullif({s.clean_value('resume')}, ''), '')) AS by_alias,
 md5(coalesce(nullif({s.clean_value('resume')}, ''), nullif({s.clean_value('summary')}, ''), '')) AS by_column FROM v""")
def alias_resolve(spark, sf):
    df = drifting(spark, sf)
    return df.select("doc_id", first_by_alias(df.columns, ["title", "titre"]).alias("title"),
                     F.md5(first_by_alias(df.columns, ["summary", "summary.1", "resume", "resume.1"])).alias("by_alias"),
                     F.md5(first_by_column(df.columns, ["summary", "resume"])).alias("by_column"))


@query("canonical_columns", f"""WITH {s.DOCS}, v AS (SELECT doc_id, title, CASE WHEN doc_id % 2 = 0 THEN summary END AS resume,
 CASE WHEN doc_id % 5 = 0 THEN title ELSE 'nan' END AS summary FROM docs),
 w AS (SELECT *, length(replace(title, ' ', '')) AS n,
  list_slice(regexp_split_to_array({s.strip('lower(title)')}, '\\s+'), 1, 5) AS head FROM v)
SELECT doc_id, title, md5(CASE WHEN summary IN ('', 'nan') THEN coalesce(resume, '') ELSE summary END) AS summary,
 '' AS image_url, '' AS image_caption, CASE WHEN n = 0 THEN 'fr' WHEN
 length(regexp_replace(title, '[^\\x{{600}}-\\x{{6ff}}]', '', 'g')) / n > 0.25 THEN 'ar'
 WHEN list_has_any(head, {s.arr(fv.FRENCH_WORDS)}) THEN 'fr' ELSE 'en' END AS lang FROM w""")
def canonical(spark, sf):
    raw = docs(spark, sf).select(
        "doc_id", F.col("title").alias("Title "), F.when(F.col("doc_id") % 2 == 0, F.col("summary")).alias("RESUME"),
        F.when(F.col("doc_id") % 5 == 0, F.col("title")).otherwise("nan").alias("Summary"))
    out = canonical_columns(raw)
    return out.select("doc_id", "title", F.md5("summary").alias("summary"), "image_url", "image_caption", "lang")


@query("external_keys", f"""WITH {s.DOCS} SELECT doc_id, sha1(concat_ws('|', source, title,
 CASE WHEN doc_id % 4 = 0 THEN '' ELSE 'https://news.example.org/' || CAST(doc_id % 50 AS VARCHAR) END,
 strftime(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER), '%Y-%m-%d'))) AS external_key FROM docs""")
def external_keys(spark, sf):
    url = F.when(F.col("doc_id") % 4 == 0, F.lit(None)).otherwise(
        F.concat(F.lit("https://news.example.org/"), (F.col("doc_id") % 50).cast("string")))
    return docs(spark, sf).select("doc_id", vx.external_key(
        F.col("source"), F.col("title"), url, F.date_format(published(), "yyyy-MM-dd")).alias("external_key"))


@query("title_keys", f"""WITH {s.DOCS} SELECT doc_id,
 substr(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_]+', '', 'g'), 1, 60) AS title_key FROM docs""")
def title_keys(spark, sf):
    return docs(spark, sf).select("doc_id", vx.title_key(F.col("title")).alias("title_key"))


@query("clean_text", f"""WITH {s.DOCS}, o AS (SELECT doc_id, {s.clean_text('summary')} AS v FROM docs)
SELECT doc_id, {sql_digest('v', 'cleaned')} FROM o""")
def clean_text(spark, sf):
    return docs(spark, sf).select("doc_id", tx.clean_text(F.col("summary")).alias("v")).select(
        "doc_id", *digest(F.col("v"), "cleaned"))


@query("tokens", f"""WITH {s.DOCS}, o AS (SELECT doc_id, list_sort({s.tokens('summary')}) AS t FROM docs)
SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens FROM o""")
def tokens(spark, sf):
    t = docs(spark, sf).select("doc_id", F.sort_array(tx.tokenize(F.col("summary"))).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query("clean_html", """WITH a AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'),
 '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g') AS h FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g') AS h FROM a),
c AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', chr(160)),
 '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS h FROM b)
SELECT page_id, md5(trim(regexp_replace(h, '[\\s\\x{a0}]+', ' ', 'g'))) AS text,
 length(trim(regexp_replace(h, '[\\s\\x{a0}]+', ' ', 'g'))) AS text_len FROM c""")
def clean_html(spark, sf):
    return pages(spark, sf).select("page_id", tx.clean_html(F.col("html")).alias("v")).select(
        "page_id", F.md5("v").alias("text"), F.length("v").cast("bigint").alias("text_len"))


@query("fold_text", f"""WITH {s.DOCS}, o AS (SELECT doc_id, {s.norm('summary')} AS v FROM docs)
SELECT doc_id, {sql_digest('v', 'folded')} FROM o""")
def fold_text(spark, sf):
    return docs(spark, sf).select("doc_id", tx.norm_text(F.col("summary")).alias("v")).select(
        "doc_id", *digest(F.col("v"), "folded"))


@query("key_text", f"""WITH {s.DOCS} SELECT doc_id, {s.key_text('title')} AS key_text FROM docs""")
def key_text(spark, sf):
    return docs(spark, sf).select("doc_id", tx.key_text(F.col("title")).alias("key_text"))


@query("entity_keys", f"""SELECT c_custkey, {s.story_key("c_name", "c_mktsegment", "CASE WHEN c_custkey % 3 = 0 THEN '' ELSE n_name END")} AS story_key
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def entity_keys(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    to = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("n_name"))
    return c.select("c_custkey", vx.story_key(F.col("c_name"), F.col("c_mktsegment"), to).alias("story_key"))


@query("url_article_like", """WITH v AS (SELECT page_id, url, trim(regexp_replace(regexp_extract(url,
 '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://[^/?#]*)?([^?#]*)', 1), ';[^/]*$', ''), '/') AS path FROM pages),
w AS (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS seg FROM v)
SELECT page_id, lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?//([^/?#]*)', 1)) AS host, path,
 CASE WHEN path = '' THEN false ELSE len(seg) >= 3 OR length(seg[-1]) - length(replace(seg[-1], '-', '')) >= 4
 OR regexp_matches(seg[-1], '[A-Z0-9]{6,}') END AS article_like FROM w""")
def url_article_like(spark, sf):
    u = F.col("url")
    return pages(spark, sf).select(
        "page_id", ux.url_host(u).alias("host"), F.btrim(ux.url_path(u), F.lit("/")).alias("path"),
        ux.is_article_like_url(u).alias("article_like"))


@query("resolve_urls", """SELECT page_id, x.i AS position, CASE WHEN starts_with(x.h, 'http') THEN x.h ELSE
 rtrim(regexp_extract(url, '^(https?://[^/?#]+)', 1), '/') || '/' || ltrim(x.h, '/') END AS link FROM (
 SELECT page_id, url, unnest(list_transform(list_zip(range(0, len(h)), h), lambda z: {'i': z[1], 'h': z[2]})) AS x FROM (
 SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages))""")
def resolve_urls(spark, sf):
    base = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    return (pages(spark, sf)
            .select("page_id", base.alias("base"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("position", "href"))
            .select("page_id", F.col("position").cast("bigint").alias("position"),
                    ux.resolve_url(F.col("base"), F.col("href")).alias("link")))


@query("lang_detect", f"""WITH {s.DOCS}, w AS (SELECT doc_id, title, length(replace(title, ' ', '')) AS n,
 list_slice(regexp_split_to_array({s.strip('lower(title)')}, '\\s+'), 1, 5) AS head FROM docs)
SELECT CASE WHEN n = 0 THEN 'fr' WHEN length(regexp_replace(title, '[^\\x{{600}}-\\x{{6ff}}]', '', 'g')) / n > 0.25 THEN 'ar'
 WHEN list_has_any(head, {s.arr(fv.FRENCH_WORDS)}) THEN 'fr' ELSE 'en' END AS detected, doc_id FROM w""")
def lang_detect(spark, sf):
    return docs(spark, sf).select("doc_id", tx.detect_language(F.col("title")).alias("detected"))


FEES = """CASE doc_id % 6 WHEN 0 THEN concat(title, ' ', CAST(n_chars % 90 AS VARCHAR(9)), ',5 M€ ok') WHEN 1 THEN concat(title, ' Free transfer')
 WHEN 2 THEN concat(CAST(n_chars % 70 AS VARCHAR(9)), ' Millions pour ', source) WHEN 3 THEN concat('prêt ', title) ELSE title END"""


@query("fees", f"""WITH {s.DOCS}, v AS (SELECT doc_id, {FEES} AS t FROM docs), w AS (SELECT doc_id, {s.fee_text('t')} AS fee_text FROM v)
SELECT doc_id, fee_text, {s.numeric_fee("coalesce(fee_text, '')")} AS fee_numeric FROM w""")
def fees(spark, sf):
    return docs(spark, sf).select("doc_id", vx.fee_text(F.expr(FEES)).alias("fee_text")).select(
        "doc_id", "fee_text", vx.numeric_fee(F.col("fee_text")).alias("fee_numeric"))


@query("category_slugs", f"""WITH {s.DOCS}, v AS (SELECT doc_id, {ODD} AS v FROM docs)
SELECT doc_id, coalesce(nullif(trim(regexp_replace({s.clean_value('v')}, '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), 'categorie') AS slug,
 coalesce(nullif({s.clean_value('v')}, ''), 'Autre') AS category FROM v""")
def category_slugs(spark, sf):
    v = docs(spark, sf).select("doc_id", F.expr(ODD).alias("v"))
    return v.select("doc_id", tx.category_slug(F.col("v")).alias("slug"), tx.normalize_category(F.col("v")).alias("category"))


BIO = """concat('X is a player who plays ', CASE doc_id % 3 WHEN 0 THEN 'as a forward ' ELSE '' END, 'for ',
 CASE doc_id % 4 WHEN 0 THEN 'Serie A club ' WHEN 1 THEN 'the ' ELSE '' END, title, ' and more')"""


@query("bio_org", f"""WITH {s.DOCS}, v AS (SELECT doc_id, trim(regexp_extract({BIO}, {s.q(fv.BIO_ORG_PATTERN)}, 1)) AS o FROM docs)
SELECT doc_id, CASE WHEN length(o) > 2 AND o NOT IN ('the', 'a', 'national team') THEN o ELSE '' END AS org FROM v""")
def bio_org(spark, sf):
    return docs(spark, sf).select("doc_id", tx.current_org(F.expr(BIO)).alias("org"))


@query("token_intersection", f"""SELECT d.doc_id, len(list_intersect(a, b)) AS shared, len(a) AS title_tokens FROM (
 SELECT doc_id, {s.tokens("split_part(text, chr(10), 1)")} AS a, {s.tokens("substr(text, length(split_part(text, chr(10), 1)) + 1)")} AS b FROM documents) d""")
def token_intersection(spark, sf):
    rest = F.substr("summary", F.length("title") + 1)
    t = docs(spark, sf).select("doc_id", tx.tokenize(F.col("title")).alias("a"), tx.tokenize(rest).alias("b"))
    return t.select("doc_id", F.size(F.array_intersect("a", "b")).cast("bigint").alias("shared"),
                    F.size("a").cast("bigint").alias("title_tokens"))


