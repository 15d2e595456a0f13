"""Queries on listing, statistics, reports, ranking and text analysis."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressweave import fixed_values as fv
from pressweave.functions.text import tokenize
from pressweave.functions.values import external_key, title_key
from pressweave.operators import query as qy
from pressweave.operators import report as rp
from pressweave.operators import score as sc
from pressweave.operators import texts as tt
from pressweave.operators.dedup import first_per_group, keep_first
from pressweave.operators.joins import needs_image, needs_page, needs_summary
from pressweave.plans.jobs import query_job
from pressweave.plans.views import articles, docs, listing, published, table, with_credibility
from pressweave.queries import params as p
from pressweave.queries import sql as s
from pressweave.queries.annotation import ANNOTATED_SQL, MERGE_FEE, annotated
from pressweave.queries.text import IMAGES
from pressweave.sources.tables import settle

QUERIES: dict = {}


def query(name, sql):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return register


ARTS = f"""{s.DOCS}, arts AS (SELECT doc_id, title, summary, language, source,
 language AS category, CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS TIMESTAMP) AS published_at, {s.CRED} AS credibility FROM docs d)"""


# categories with blanks and NULLs
def odd_categories(rows):
    d = F.col("doc_id")
    return rows.withColumn("category", F.when(d % 17 == 0, "").when(d % 19 == 0, F.lit(None)).otherwise(F.col("category")))


ODD = f"""{ARTS}, odd AS (SELECT * REPLACE (CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 19 = 0 THEN NULL ELSE category END AS category) FROM arts)"""


@query("category_counts", f"WITH {ODD} SELECT coalesce(nullif(category, ''), 'Autre') AS category, count(*) AS articles FROM odd GROUP BY 1")
def category_counts(spark, sf):
    return qy.category_counts(odd_categories(listing(spark, sf)))


@query("total_count", "SELECT count(*) AS total FROM documents")
def total_count(spark, sf):
    return table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("total"))


def sources(spark, sf) -> DataFrame:
    """Source dimension with ids, one row per name."""
    return docs(spark, sf).groupBy("source").agg(F.min("doc_id").alias("source_id"), F.max("language").alias("language")).withColumnRenamed("source", "name")


def by_source_id(spark, sf) -> DataFrame:
    """Articles that carry a source id; some ids have no source."""
    ids = sources(spark, sf).select(F.col("name").alias("source"), "source_id")
    return listing(spark, sf).join(ids, "source").withColumn(
        "source_id", F.when(F.col("doc_id") % 23 == 0, -1).otherwise(F.col("source_id")))


BY_ID = f"""{ARTS}, srcs AS (SELECT source AS name, min(doc_id) AS source_id, max(language) AS language FROM docs GROUP BY 1),
linked AS (SELECT a.*, CASE WHEN doc_id % 23 = 0 THEN -1 ELSE s.source_id END AS source_id FROM arts a JOIN srcs s ON s.name = a.source)"""


@query("source_counts", f"WITH {BY_ID} SELECT s.name, count(*) AS articles FROM linked l JOIN srcs s USING (source_id) GROUP BY 1")
def source_counts(spark, sf):
    return qy.source_counts(by_source_id(spark, sf), sources(spark, sf))


@query("article_source_join", f"WITH {BY_ID} SELECT doc_id, title, s.name, s.language AS source_language FROM linked l LEFT JOIN srcs s USING (source_id)")
def article_source_join(spark, sf):
    dim = sources(spark, sf).withColumnRenamed("language", "source_language")
    return qy.with_source(by_source_id(spark, sf), dim, "left").select("doc_id", "title", "name", "source_language")


@query("orphan_articles", f"WITH {BY_ID} SELECT doc_id, source_id FROM linked WHERE source_id NOT IN (SELECT source_id FROM srcs)")
def orphan_articles(spark, sf):
    return by_source_id(spark, sf).join(sources(spark, sf), "source_id", "left_anti").select("doc_id", "source_id")


@query("rows_per_source", f"WITH {ARTS} SELECT source, count(*) AS articles FROM arts GROUP BY 1")
def rows_per_source(spark, sf):
    return docs(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("articles")).orderBy(F.desc("articles"), "source")


@query("stats", f"""WITH {ODD}, l AS (SELECT *, coalesce(nullif(category, ''), 'Autre') AS c FROM odd)
SELECT 'total_articles' AS metric, '' AS label, CAST(count(*) AS DOUBLE) AS value FROM l UNION ALL
SELECT 'total_categories', '', CAST(count(DISTINCT c) AS DOUBLE) FROM l UNION ALL SELECT 'total_sources', '', CAST(count(DISTINCT source) AS DOUBLE) FROM l
UNION ALL SELECT 'average_credibility', '', round(coalesce(avg(credibility), 0), 2) FROM l
UNION ALL SELECT 'category', c, CAST(count(*) AS DOUBLE) FROM l GROUP BY 2 UNION ALL SELECT 'source', source, CAST(count(*) AS DOUBLE) FROM l GROUP BY 2""")
def stats(spark, sf):
    return qy.stats(odd_categories(articles(spark, sf)))


def listed(spark, sf) -> DataFrame:
    """Annotated listing rows with credibility and dates."""
    fields = ["entity", "org_from", "org_to", "status", "league", "nationality", "sentiment"]
    rows = annotated(spark, sf, fields).select(
        "doc_id", "source", "language", "title", "summary", "entity", "org_from", "org_to", "status", "league", "nationality",
        "sentiment", F.col("language").alias("category"), published().alias("published_at"), published().alias("created_at"),
        F.expr(MERGE_FEE).alias("fee_text"), F.lit(0.0).alias("fee_numeric"))
    return rows


LISTED = f"""{ANNOTATED_SQL}, listed AS (SELECT doc_id, source, language, title, summary, entity, org_from, org_to, status, league,
 nationality, language AS category, CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS TIMESTAMP) AS published_at, {MERGE_FEE} AS fee_text FROM scored)"""
LISTING = """(category = 'en' OR league = 'en') AND (org_from ILIKE '%ion%' OR org_to ILIKE '%ion%' OR title ILIKE '%ion%')
 AND (title ILIKE '%t_e%ing%' OR summary ILIKE '%t_e%ing%' OR entity ILIKE '%t_e%ing%' OR org_from ILIKE '%t_e%ing%' OR org_to ILIKE '%t_e%ing%')"""
FILTERS = {"category": "en", "org": "ion", "search": " t_e%ing "}


@query("articles_page", f"""WITH {LISTED} SELECT doc_id, title, source, status, published_at FROM listed WHERE {LISTING}
ORDER BY published_at DESC NULLS LAST, doc_id LIMIT 50 OFFSET 50""")
def articles_page(spark, sf):
    page, _ = query_job(listed(spark, sf), "doc_id", page=2, page_size=50, **FILTERS)
    return page.select("doc_id", "title", "source", "status", "published_at")


ACCENTLESS = ["title", "summary", "entity", "org_from", "org_to"]


@query("search_accents", f"""WITH {s.DOCS}, v AS (SELECT doc_id, title, source AS summary, language AS entity, source AS org_from, '' AS org_to FROM docs)
SELECT doc_id, title FROM v WHERE {' OR '.join(f"contains(strip_accents(lower({c})), 'rcion')" for c in ACCENTLESS)}""")
def search_accents(spark, sf):
    """A search in which neither case nor accents count."""
    rows = docs(spark, sf).select("doc_id", "title", F.col("source").alias("summary"), F.col("language").alias("entity"), F.col("source").alias("org_from"), F.lit("").alias("org_to"))
    return rows.filter(qy.article_filter(search=" RCIÓN ", collation="UNICODE_CI_AI")).select("doc_id", "title")


@query("search_total", f"WITH {LISTED} SELECT count(*) AS total FROM listed WHERE {LISTING}")
def search_total(spark, sf):
    return query_job(listed(spark, sf), "doc_id", **FILTERS)[1]


@query("status_source_filter", f"WITH {LISTED} SELECT doc_id, league, status FROM listed WHERE status = '{fv.STATUS_TALKS}' AND source = 'src3' AND (league = 'Other' OR category = 'Other')")
def status_source_filter(spark, sf):
    rows = listed(spark, sf).filter(qy.article_filter(league="Other", status=fv.STATUS_TALKS, source="src3"))
    return rows.select("doc_id", "league", "status")


@query("point_lookup", f"""WITH {s.DOCS}, k AS (SELECT doc_id, title, sha1(concat_ws('|', source, title, '', '')) AS external_key FROM docs)
SELECT * FROM k WHERE external_key = (SELECT external_key FROM k WHERE doc_id = (SELECT min(doc_id) FROM documents)) ORDER BY doc_id LIMIT 1""")
def point_lookup(spark, sf):
    d = docs(spark, sf)
    keyed = d.select("doc_id", "title", external_key(F.col("source"), F.col("title"), F.lit(""), F.lit("")).alias("external_key"))
    smallest = d.agg(F.min("doc_id")).first()[0]
    wanted = qy.find_by(keyed, "doc_id", smallest).first()["external_key"]
    return qy.find_by(keyed, "external_key", wanted).orderBy("doc_id").limit(1)


@query("distinct_lists", f"""WITH {LISTED} SELECT DISTINCT 'league' AS list, league AS value FROM listed WHERE league <> '' UNION ALL
SELECT DISTINCT 'status', status FROM listed WHERE status <> '' UNION ALL SELECT DISTINCT 'source', source FROM listed""")
def distinct_lists(spark, sf):
    # one scan: the distinct pairs of all three lists
    rows = listed(spark, sf)
    pairs = rows.select(F.inline(F.array(*[F.struct(F.lit(c).alias("list"), F.col(c).alias("value")) for c in ("league", "status", "source")])))
    return pairs.filter(F.col("value").isNotNull() & (F.col("value") != "")).distinct()


@query("org_list", f"WITH {LISTED} SELECT org FROM (SELECT org_from AS org FROM listed UNION SELECT org_to FROM listed) WHERE org <> ''")
def org_list(spark, sf):
    return qy.org_list(listed(spark, sf))


@query("serve_projection", f"""WITH {LISTED} SELECT doc_id, title, source, category, 'Neutre' AS sentiment, nullif(entity, '') AS entity,
 n.nationality, org_from, org_to, coalesce(nullif(league, ''), category) AS league, nullif(fee_text, '') AS fee_text,
 {s.numeric_fee('fee_text')} AS fee_numeric, status, {s.CRED} AS credibility FROM listed d LEFT JOIN
 {s.values(list(p.NATIONS.items()), 'name, nationality', 'n')} ON n.name = d.entity""")
def serve_projection(spark, sf):
    rows = with_credibility(listed(spark, sf).drop("nationality", "summary").withColumn("sentiment", F.lit("")), spark, sf)
    return qy.served(rows, p.NATIONS, "doc_id")


@query("needs_enrichment", f"""WITH {s.DOCS}, v AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' WHEN doc_id % 7 = 0 THEN 'nan' ELSE title END AS summary,
 {IMAGES} AS image, 'https://x.example.org/' || source || CASE WHEN doc_id % 2 = 0 THEN '/news/today' ELSE '' END AS url FROM docs)
SELECT doc_id, trim(summary) IN ('', 'nan') AS needs_summary, image IN ('', 'nan') OR regexp_matches(image, '^https?://[^/]*(wikipedia|wikimedia)\\.org(/|$)') AS needs_image,
 contains(url, '/news/') AND (trim(summary) IN ('', 'nan') OR image IN ('', 'nan') OR regexp_matches(image, '^https?://[^/]*(wikipedia|wikimedia)\\.org(/|$)')) AS needs_page FROM v""")
def needs_enrichment(spark, sf):
    d = F.col("doc_id")
    v = docs(spark, sf).select(
        "doc_id", F.when(d % 3 == 0, " ").when(d % 7 == 0, "nan").otherwise(F.col("title")).alias("summary"), F.expr(IMAGES).alias("image"),
        F.concat(F.lit("https://x.example.org/"), F.col("source"), F.when(d % 2 == 0, "/news/today").otherwise("")).alias("url"))
    su, im = F.col("summary"), F.col("image")
    return v.select("doc_id", needs_summary(su).alias("needs_summary"), needs_image(im).alias("needs_image"), needs_page(F.col("url"), su, im).alias("needs_page"))


@query("dedup_title_key", f"""WITH {s.DOCS}, k AS (SELECT *, substr(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_]+', '', 'g'), 1, 60) AS k FROM docs)
SELECT min(doc_id) AS doc_id, arg_min(title, doc_id) AS title FROM k GROUP BY k""")
def dedup_title_key(spark, sf):
    return keep_first(docs(spark, sf).select("doc_id", "title"), title_key(F.col("title")), ["doc_id"])


@query("dedup_text", """SELECT min(doc_id) AS doc_id, md5(text) AS text FROM documents GROUP BY text""")
def dedup_text(spark, sf):
    keyed = docs(spark, sf).select("doc_id", F.md5("summary").alias("text"))
    return first_per_group(keyed, ["text"], ["doc_id"])


@query("per_group_limit", f"""WITH {s.DOCS} SELECT doc_id, source, n FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM docs) WHERE n <= 25""")
def per_group_limit(spark, sf):
    rows = docs(spark, sf).select("doc_id", "source", "n_chars")
    return first_per_group(rows, ["source"], [F.desc("n_chars"), "doc_id"], 25, "n").select("doc_id", "source", "n")


@query("row_cap", f"WITH {s.DOCS} SELECT doc_id, title FROM docs ORDER BY doc_id LIMIT 100")
def row_cap(spark, sf):
    return docs(spark, sf).select("doc_id", "title").orderBy("doc_id").limit(100)


# raw report rows: dates in three formats, some images, text credibility
def report_raw(spark, sf) -> DataFrame:
    d = F.col("doc_id")
    day = published().cast("date")
    rows = docs(spark, sf).select(
        "doc_id", "title", "source", F.when(d % 13 == 0, "null").otherwise(F.col("language")).alias("categorie"),
        F.when(d % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(d % 4 == 1, F.date_format(day, "d/M/yyyy"))
        .when(d % 4 == 2, F.date_format(day, "yyyy/M/d")).otherwise("soon").alias("date"),
        F.when(d % 6 == 0, F.col("title")).otherwise(F.col("summary")).alias("resume"),
        F.concat(F.lit("https://news.example.org/"), (d % 40).cast("string")).alias("url"),
        F.when(d % 3 == 0, F.concat(F.lit("images/"), F.col("source"), F.lit(".png"))).alias("image"))
    rows = with_credibility(rows, spark, sf)
    return rows.withColumn("credibility", F.when(d % 10 == 0, "n/a").otherwise(F.col("credibility").cast("string")))


REPORT = f"""{s.DOCS}, raw AS (SELECT doc_id, title, source, CASE WHEN doc_id % 13 = 0 THEN 'null' ELSE language END AS categorie,
 CASE doc_id % 4 WHEN 0 THEN strftime(day, '%Y-%m-%d') WHEN 1 THEN strftime(day, '%-d/%-m/%Y') WHEN 2 THEN strftime(day, '%Y/%-m/%-d') ELSE 'soon' END AS date,
 CASE WHEN doc_id % 4 < 3 THEN day END AS sort_date, CASE WHEN doc_id % 6 = 0 THEN title ELSE summary END AS resume,
 'https://news.example.org/' || CAST(doc_id % 40 AS VARCHAR) AS url, CASE WHEN doc_id % 3 = 0 THEN '/images/' || source || '.png' ELSE '' END AS image,
 CASE WHEN doc_id % 10 = 0 THEN 'n/a' ELSE CAST({s.CRED} AS VARCHAR) END AS credibility
 FROM (SELECT *, DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS day FROM docs) d),
norm0 AS (SELECT doc_id, {s.polish('title')} AS title, {s.polish('source')} AS source, coalesce(nullif({s.polish('categorie')}, ''), 'Autre') AS category, date,
 sort_date, {s.polish('resume')} AS summary, url, image, credibility FROM raw),
norm1 AS (SELECT * REPLACE (CASE WHEN summary = '' OR summary = title THEN {s.shorten('title', 200)} ELSE summary END AS summary) FROM norm0 WHERE title <> ''),
rep AS (SELECT *, row_number() OVER (ORDER BY sort_date DESC NULLS LAST, (image <> '') DESC, title, doc_id) AS rn FROM norm1
 QUALIFY row_number() OVER (PARTITION BY title, source, url ORDER BY sort_date DESC NULLS LAST, (image <> '') DESC, title, doc_id) = 1)"""


def report(spark, sf):
    return rp.report_rows(report_raw(spark, sf), "doc_id")


@query("report_rows", f"WITH {REPORT} SELECT doc_id AS ord, title, source, category, date, md5(summary) AS summary, url, image, credibility FROM rep")
def report_rows(spark, sf):
    return report(spark, sf).select("ord", "title", "source", "category", "date", F.md5("summary").alias("summary"), "url", "image", "credibility")


@query("report_cards", f"""WITH {REPORT} SELECT doc_id AS ord, title, source, category, coalesce(nullif(date, ''), 'Date non renseignee') AS date,
 {s.shorten('summary', 260)} AS summary, url, image, coalesce(nullif(credibility, ''), 'N/A') AS credibility FROM rep""")
def report_cards(spark, sf):
    return rp.cards(rp.in_report_order(report(spark, sf)))


@query("report_kpis", f"""WITH {REPORT} SELECT category, count(*) AS articles, count(DISTINCT source) AS sources, count(*) FILTER (image <> '') AS images,
 coalesce(printf('%.1f/5', avg(try_cast(credibility AS DOUBLE))), 'N/A') AS credibility FROM rep GROUP BY 1""")
def report_kpis(spark, sf):
    return rp.category_kpis(report(spark, sf))


@query("report_digest", f"""WITH {REPORT}, t AS (SELECT category, title, row_number() OVER (PARTITION BY category ORDER BY min(rn)) AS k FROM rep GROUP BY 1, 2),
so AS (SELECT category, source, row_number() OVER (PARTITION BY category ORDER BY min(rn)) AS k FROM rep GROUP BY 1, 2)
SELECT category, articles, articles || ' article' || pl || ' suivi' || pl || ' aujourd''hui dans ' || category || '.' ||
 ' Temps fort: ' || (SELECT {s.shorten('title', 110)} FROM t WHERE t.category = c.category AND k = 1) || '.' ||
 coalesce(' Autre sujet marquant: ' || (SELECT {s.shorten('title', 110)} FROM t WHERE t.category = c.category AND k = 2) || '.', '') ||
 ' Sources les plus presentes: ' || (SELECT string_agg(source, ', ' ORDER BY k) FROM so WHERE so.category = c.category AND k <= 3) || '.' AS digest
FROM (SELECT category, count(*) AS articles, CASE WHEN count(*) > 1 THEN 's' ELSE '' END AS pl FROM rep GROUP BY 1) c""")
def report_digest(spark, sf):
    # three aggregates read the rows, so they are written once
    return rp.category_digest(settle(report(spark, sf), "report"))


@query("report_index", f"""WITH {REPORT} SELECT category, count(*) AS articles, count(DISTINCT source) AS sources,
 coalesce(nullif(trim(regexp_replace(category, '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), 'categorie') || '_latest.html' AS link FROM rep GROUP BY 1""")
def report_index(spark, sf):
    return rp.report_index(report(spark, sf))


@query("first_appearance", f"WITH {REPORT} SELECT category FROM rep GROUP BY 1 ORDER BY min(rn)")
def first_appearance(spark, sf):
    return rp.first_appearance(report(spark, sf))


# ranking: engagement stands on the turns of the conversation with the same id
AGE_SQL = f"(epoch_us(TIMESTAMP '{p.AS_OF}') - epoch_us(published_at)) / 3600000000.0"
RANKED = f"""{ARTS}, eng AS (SELECT conv_id, count(*) AS turns, avg(length(text) % 6) AS rating FROM conversations GROUP BY 1),
r0 AS (SELECT a.doc_id, a.source, a.language, a.credibility / 5.0 AS credibility_score, CASE WHEN a.doc_id % 29 = 0 THEN NULL ELSE published_at END AS published_at,
 coalesce(turns, 0) AS reviews, coalesce(rating, 0.0) AS rating, {s.tokens('split_part(d.text, chr(10), 1)')} AS keywords, length(a.source) / 6.0 AS source_score
 FROM arts a JOIN documents d USING (doc_id) LEFT JOIN eng ON conv_id = a.doc_id),
r1 AS (SELECT *, {AGE_SQL} AS h, CASE WHEN reviews = 0 THEN 0.0 ELSE (least(1.0, reviews / 10.0) + CASE WHEN rating > 0 THEN least(1.0, rating / 5.0) ELSE 0.5 END) / 2 END AS engagement FROM r0),
r2 AS (SELECT *, CASE WHEN h IS NULL THEN 0.5 WHEN h < 1 THEN 1.0 WHEN h < 24 THEN greatest(0.5, 1.0 - h / 24 * 0.5) WHEN h < 168 THEN greatest(0.1, 0.5 - (h - 24) / 144 * 0.4) ELSE 0.1 END AS recency FROM r1),
r3 AS (SELECT *, least(1.0, credibility_score * 0.40 + recency * 0.20 + engagement * 0.15 + least(1.0, source_score) * 0.15 + least(1.0, len(keywords) / 5.0) * 0.10) AS score FROM r2)"""


def ranked(spark, sf) -> DataFrame:
    as_of = F.lit(p.AS_OF).cast("timestamp_ntz")
    turns = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("reviews"), F.avg(F.length("text") % 6).alias("rating"))
    rows = docs(spark, sf).select("doc_id", "source", "language", tokenize(F.col("title")).alias("keywords"),
                                  F.when(F.col("doc_id") % 29 != 0, published()).alias("published_at"))
    rows = with_credibility(rows, spark, sf).join(turns, "doc_id", "left")
    rows = (rows.withColumn("reviews", F.coalesce("reviews", F.lit(0).cast("bigint"))).withColumn("rating", F.coalesce("rating", F.lit(0.0)))
            .withColumn("credibility_score", F.col("credibility") / 5.0)
            .withColumn("recency", sc.recency_score(F.col("published_at"), as_of))
            .withColumn("engagement", sc.engagement_score(F.col("reviews"), F.col("rating")))
            .withColumn("verified", F.col("credibility_score") >= fv.VERIFIED_THRESHOLD))
    return rows.withColumn("score", sc.ranking_score(F.col("credibility_score"), F.col("recency"), F.col("engagement"),
                                                     F.length("source") / 6.0, F.col("keywords")))


@query("rank", f"WITH {RANKED} SELECT doc_id, round(recency, 6) AS recency, round(engagement, 6) AS engagement, round(score, 6) AS score FROM r3")
def rank(spark, sf):
    return ranked(spark, sf).orderBy(F.desc("score"), "doc_id").select(
        "doc_id", F.round("recency", 6).alias("recency"), F.round("engagement", 6).alias("engagement"), F.round("score", 6).alias("score"))


@query("rank_filter", f"""WITH {RANKED} SELECT doc_id FROM r3 WHERE language = 'en' AND contains(lower(source), 'rc1') AND credibility_score >= 0.5
 AND list_has_any(keywords, ['thing', 'thble', 'ering', 'ertion', 'attion', 'that']) AND coalesce(h <= 400, true) AND credibility_score >= 0.6""")
def rank_filter(spark, sf):
    return ranked(spark, sf).filter(sc.rank_filters(
        language="en", source="RC1", min_credibility=0.5, keywords=["thing", "thble", "ering", "ertion", "attion", "that"], max_age_hours=400,
        verified_only=True, as_of=F.lit(p.AS_OF).cast("timestamp_ntz"))).select("doc_id")


@query("top_keywords", f"""WITH {s.DOCS}, t AS (SELECT doc_id, unnest(list_filter({s.all_tokens('summary')}, lambda t: NOT list_contains({s.arr(fv.STOP_WORDS)}, t))) AS word FROM docs),
c AS (SELECT doc_id, word, count(*) AS count FROM t GROUP BY 1, 2)
SELECT doc_id, rank, word, count FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, word) AS rank FROM c) WHERE rank <= 5""")
def top_keywords(spark, sf):
    return tt.top_keywords(docs(spark, sf), "doc_id", "summary")


@query("extract_summary", f"""WITH {s.DOCS}, t AS (SELECT doc_id, {s.strip(s.collapse('summary'))} AS t FROM docs)
SELECT doc_id, substr(array_to_string(list_slice(string_split(regexp_replace(t, '([.!?]) ', '\\1' || chr(1), 'g'), chr(1)), 1, 3), ' '), 1, 500) AS summary FROM t""")
def extract_summary(spark, sf):
    return docs(spark, sf).select("doc_id", tt.extract_summary(F.col("summary")).alias("summary"))


@query("polarity", f"""WITH {s.DOCS}, t AS (SELECT doc_id, {s.all_tokens('summary')} AS w FROM docs),
c AS (SELECT doc_id, len(list_filter(w, lambda x: list_contains({s.arr(p.POSITIVE)}, x))) AS u, len(list_filter(w, lambda x: list_contains({s.arr(p.NEGATIVE)}, x))) AS d FROM t)
SELECT doc_id, u AS positive_count, d AS negative_count, CASE WHEN u + d > 0 THEN round((u - d) / (u + d), 6) ELSE 0.0 END AS polarity,
 CASE WHEN u > d THEN 'positive' WHEN d > u THEN 'negative' ELSE 'neutral' END AS sentiment FROM c""")
def polarity(spark, sf):
    out = docs(spark, sf).select("doc_id", tt.polarity(F.col("summary"), p.POSITIVE, p.NEGATIVE).alias("p")).select("doc_id", "p.*")
    return out.withColumn("polarity", F.round("polarity", 6))


SPAM_SQL = " + ".join(f"CASE WHEN regexp_matches(lower(summary), {s.q(x)}) THEN 1 ELSE 0 END" for x in p.SPAM)


@query("spam_flags", f"WITH {s.DOCS} SELECT doc_id, {SPAM_SQL} AS spam_hits FROM docs")
def spam_flags(spark, sf):
    return docs(spark, sf).select("doc_id", sc.spam_hits(F.col("summary"), p.SPAM).alias("spam_hits"))


@query("credibility", f"""WITH {s.DOCS}, c AS (SELECT doc_id, greatest(0.15, least(1.0, {s.CRED} / 5.0 * 0.4 + CASE WHEN {SPAM_SQL} = 0 THEN 1.0 ELSE 0.0 END * 0.2
 + least(1.0, length(summary) / 500.0) * 0.2 + least(1.0, len({s.tokens('title')}) / 5.0) * 0.2)) AS score FROM docs d)
SELECT doc_id, round(score, 6) AS credibility, round(score, 6) >= 0.6 AS verified, CASE WHEN round(score, 6) >= 0.8 THEN 'high' WHEN round(score, 6) >= 0.6 THEN 'good'
 WHEN round(score, 6) >= 0.3 THEN 'medium' ELSE 'low' END AS trust FROM c""")
def credibility(spark, sf):
    parts = docs(spark, sf).select(
        "doc_id", F.when(sc.spam_hits(F.col("summary"), p.SPAM) == 0, 1.0).otherwise(0.0).alias("spam"),
        F.least(F.lit(1.0), F.length("summary") / 500.0).alias("text"), F.least(F.lit(1.0), F.size(tokenize(F.col("title"))) / 5.0).alias("keywords"))
    rows = with_credibility(parts, spark, sf)
    score = F.round(sc.article_credibility(F.col("credibility") / 5.0, F.col("spam"), F.col("text"), F.col("keywords")), 6)
    rows = rows.select("doc_id", score.alias("credibility"))
    return rows.select("doc_id", "credibility", (F.col("credibility") >= fv.VERIFIED_THRESHOLD).alias("verified"), sc.trust_level(F.col("credibility")).alias("trust"))


@query("relevance", f"""WITH {s.DOCS} SELECT doc_id, {' + '.join(f"CASE WHEN contains(lower(title), '{w}') THEN 2.0 ELSE 0.0 END + CASE WHEN contains(lower(summary), '{w}') THEN 0.5 ELSE 0.0 END" for w in ('thing', 'qui', 'nicht'))} AS relevance FROM docs""")
def relevance(spark, sf):
    return docs(spark, sf).select("doc_id", tt.relevance(F.col("title"), F.col("summary"), "Thing qui nicht").alias("relevance"))


@query("review_average", """SELECT d.doc_id, count(c.conv_id) AS review_count, round(coalesce(avg(length(c.text) % 6), 0.0), 6) AS avg_rating
FROM documents d LEFT JOIN conversations c ON c.conv_id = d.doc_id GROUP BY 1""")
def review_average(spark, sf):
    reviews = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), (F.length("text") % 6).alias("rating"))
    out = tt.review_averages(docs(spark, sf).select("doc_id"), reviews, "doc_id")
    return out.withColumn("avg_rating", F.round("avg_rating", 6))


@query("press_digest", f"""WITH {ARTS}, u AS (SELECT 'total_articles' AS section, '' AS label, count(*) AS articles FROM arts UNION ALL
SELECT 'category', category, count(*) FROM arts GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM arts GROUP BY 2)
SELECT section, label, articles, '{{"section":"' || section || '","label":"' || label || '","articles":' || articles || '}}' AS line FROM u""")
def press_digest(spark, sf):
    return tt.press_digest(docs(spark, sf).withColumnRenamed("language", "category"))
