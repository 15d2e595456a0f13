"""Queries on upserts, purge, jobs and streams."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressweave import fixed_values as fv
from pressweave.functions.values import external_key
from pressweave.operators import store as st
from pressweave.plans import jobs
from pressweave.plans.views import docs, published, table, with_credibility
from pressweave.queries import params as p
from pressweave.queries import sql as s
from pressweave.queries.annotation import (ANNOTATED_SQL, BULLETS_SQL, HEADLINE_SQL, NORMED, RULES, TOPIC_SQL, first_good)
from pressweave.queries.landing import FEED, IMAGE_FROM, IMAGE_ROWS, IMAGE_SQL, badge_case, image_inputs, landed_feeds, with_head
from pressweave.queries.listing import REPORT, report_raw
from pressweave.sources.tables import ARTICLE, add_columns, read_merged, read_preferred, shared_dir
from pressweave.streaming import ingest

QUERIES: dict = {}


def query(name, sql):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return register


def keyed(spark, sf) -> DataFrame:
    """Rows of the article table; equal texts of one source and day share a key."""
    rows = docs(spark, sf).select("doc_id", "title", "summary", "source", "language", published().alias("published_at"))
    day = F.date_format("published_at", "yyyy-MM-dd")
    return rows.withColumn("external_key", external_key(F.col("source"), F.md5("summary"), (F.col("doc_id") % 400).cast("string"), day))


KEYED = f"""{s.DOCS}, keyed AS (SELECT doc_id, title, source, language, CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) AS TIMESTAMP) AS published_at,
 sha1(concat_ws('|', source, md5(summary), CAST(doc_id % 400 AS VARCHAR), strftime(DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER), '%Y-%m-%d'))) AS external_key FROM docs),
old AS (SELECT external_key, title, language, doc_id AS version, published_at, 0 AS created FROM keyed WHERE doc_id % 3 <> 0 OR doc_id % 2 <> 0 QUALIFY row_number() OVER (PARTITION BY external_key ORDER BY doc_id) = 1),
new AS (SELECT external_key, 'new ' || title AS title, language, -doc_id AS version, published_at, 1 AS created FROM keyed WHERE doc_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY external_key ORDER BY doc_id DESC) = 1),
merged AS (SELECT coalesce(n.external_key, o.external_key) AS external_key, CASE WHEN n.external_key IS NULL THEN o.title ELSE n.title END AS title,
 CASE WHEN n.external_key IS NULL THEN o.version ELSE n.version END AS version, coalesce(o.created, n.created) AS created,
 CASE WHEN o.external_key IS NULL THEN 'insert' WHEN n.external_key IS NULL THEN 'keep' ELSE 'update' END AS op FROM old o FULL JOIN new n USING (external_key))"""


def old_and_new(spark, sf):
    rows = keyed(spark, sf)
    old = rows.filter("doc_id % 3 <> 0 OR doc_id % 2 <> 0").select("external_key", "title", "language", F.col("doc_id").alias("version"), "published_at", F.lit(0).alias("created_at"))
    new = rows.filter("doc_id % 2 = 0").select("external_key", F.concat(F.lit("new "), F.col("title")).alias("title"), "language",
                                               (-F.col("doc_id")).alias("version"), "published_at", F.lit(1).alias("created_at"))
    return (st.first_per_group(old, ["external_key"], ["version"]), st.first_per_group(new, ["external_key"], ["version"]))


@query("upsert_rows", f"WITH {KEYED} SELECT external_key, title, version, created, op FROM merged")
def upsert_rows(spark, sf):
    old, new = old_and_new(spark, sf)
    return st.upsert(old, new, "external_key").select("external_key", "title", "version", F.col("created_at").alias("created"), "op")


@query("upsert_counts", f"WITH {KEYED} SELECT count(*) FILTER (op = 'insert') AS inserted, count(*) FILTER (op = 'update') AS updated, count(*) AS total FROM merged")
def upsert_counts(spark, sf):
    old, new = old_and_new(spark, sf)
    return st.upsert_counts(st.upsert(old, new, "external_key"))


@query("upsert_table", f"WITH {KEYED} SELECT external_key, title, version FROM merged")
def upsert_table(spark, sf):
    """Load the table, upsert a batch twice, read it back."""
    old, new = old_and_new(spark, sf)
    path = shared_dir(spark, "articles")
    st.write_articles(old.withColumn("updated_at", F.col("version")), path)
    for attempt in range(2):
        st.upsert_articles(spark, path, new.withColumn("updated_at", F.abs("version") + 1_000_000_000), attempt)
    return st.read_articles(spark, path).select("external_key", "title", "version")


@query("source_rollup", f"""WITH {s.DOCS}, v AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN '' ELSE language END AS language, {s.CRED} AS credibility FROM docs d)
SELECT source AS name, arg_min(language, doc_id) FILTER (language <> '') AS language, max(credibility) AS credibility FROM v GROUP BY 1""")
def source_rollup(spark, sf):
    rows = docs(spark, sf).select("doc_id", "source", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("language")).alias("language"))
    return st.roll_up_sources(with_credibility(rows, spark, sf), "doc_id")


@query("source_upsert", f"""WITH {s.DOCS}, v AS (SELECT doc_id, source, language, {s.CRED} AS credibility FROM docs d),
new AS (SELECT source AS name, arg_min(language, doc_id) AS language, max(credibility) AS credibility FROM v GROUP BY 1),
old AS (SELECT 'src' || CAST(n_nationkey AS VARCHAR) AS name, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'xx' END AS language, CAST(n_nationkey AS DOUBLE) AS credibility FROM nation)
SELECT coalesce(o.name, n.name) AS name, coalesce(nullif(o.language, ''), n.language) AS language, greatest(coalesce(o.credibility, 0), coalesce(n.credibility, 0)) AS credibility
FROM old o FULL JOIN new n ON o.name = n.name""")
def source_upsert(spark, sf):
    rolled = st.roll_up_sources(with_credibility(docs(spark, sf).select("doc_id", "source", "language"), spark, sf), "doc_id")
    n = F.col("n_nationkey")
    old = table(spark, sf, "nation").select(F.concat(F.lit("src"), n.cast("string")).alias("name"), F.when(n % 2 == 0, "").otherwise("xx").alias("language"), n.cast("double").alias("credibility"))
    return st.upsert_sources(old, rolled)


@query("purge", f"WITH {NORMED} SELECT doc_id, source FROM normed WHERE {TOPIC_SQL}")
def purge(spark, sf):
    return jobs.purge(docs(spark, sf), RULES).select("doc_id", "source")


@query("run_counters", f"""WITH {REPORT} SELECT count(*) AS articles, count(*) FILTER (image <> '') AS with_image,
 count(*) FILTER (coalesce(resume, '') <> '') AS with_summary FROM raw""")
def run_counters(spark, sf):
    """Counted by the pass that writes the rows."""
    got = st.write_counted(report_raw(spark, sf), shared_dir(spark, "report"), articles=F.count(F.lit(1)),
                           with_image=F.count_if(F.coalesce("image", F.lit("")) != ""), with_summary=F.count_if(F.coalesce("resume", F.lit("")) != ""))
    return spark.createDataFrame([(got["articles"], got["with_image"], got["with_summary"])], "articles long, with_image long, with_summary long")


@query("image_backfill", f"""WITH {IMAGE_ROWS}, best AS (SELECT d.doc_id, own, {IMAGE_SQL} AS image FROM {IMAGE_FROM})
SELECT doc_id, CASE WHEN (NOT starts_with(own, 'http') OR regexp_matches(lower(own), '{fv.PLACEHOLDER_IMAGE_PATTERN}')) AND image <> '' THEN image ELSE own END AS image_url FROM best""")
def image_backfill(spark, sf):
    rows, cache, page_images = image_inputs(spark, sf)
    return jobs.backfill_images(rows, "doc_id", cache, p.BADGES, page_images).select("doc_id", "image_url")


LEXICON = {"classes": p.CLASSES, "default_class": p.DEFAULT_CLASS, "status_words": p.STATUS, "wording": p.WORDING}
ENTITY_CACHE = "SELECT 'player:' || lower(c) AS key, 'https://c.example.org/' || md5(c) || '.png' AS value FROM (VALUES ('Queque'), ('Hation')) v(c)"


def image_cache(spark, sf):
    """Person images: a key/value table that the job is given."""
    names = spark.createDataFrame([("Queque",), ("Hation",)], "c string")
    return names.select(F.concat(F.lit("player:"), F.lower("c")).alias("key"), F.concat(F.lit("https://c.example.org/"), F.md5("c"), F.lit(".png")).alias("value"))


JOB_IMAGE = f"coalesce(c.value, {badge_case('org_to')}, {badge_case('org_from')}, '')"
TOPIC_UNSOURCED = TOPIC_SQL.replace("source", "''")


@query("reannotate", f"""WITH {ANNOTATED_SQL}, cache AS ({ENTITY_CACHE}) SELECT doc_id, entity, org_from, org_to, status, 'kept' AS league, {JOB_IMAGE} AS image_url
FROM scored LEFT JOIN cache c ON c.key = 'player:' || lower(entity) WHERE {TOPIC_UNSOURCED}""")
def reannotate(spark, sf):
    stored = docs(spark, sf).select("doc_id", "title", "summary", "source", *[F.lit("old").alias(c) for c in ("entity", "org_from", "org_to", "status")],
                                    F.lit("kept").alias("league"), F.lit("").alias("image_url"), F.lit("").alias("url"))
    out = jobs.reannotate(stored, "doc_id", RULES, p.ENTITIES, p.ORGS, image_cache(spark, sf), p.BADGES, **LEXICON)
    return out.select("doc_id", "entity", "org_from", "org_to", "status", "league", "image_url")


SCORES_SQL = "CASE " + " ".join(f"WHEN contains(lower(source), {s.q(k.lower())}) OR contains({s.q(k.lower())}, lower(source)) THEN {float(v)}" for k, v in p.SOURCE_SCORES.items()) + " ELSE 3.0 END"


@query("annotate_job", f"""WITH {ANNOTATED_SQL}, cache AS ({ENTITY_CACHE}),
done AS (SELECT doc_id, source, entity, org_from, org_to, nationality, league, status, fee_text, fee_numeric, story_key, {HEADLINE_SQL} AS title, {BULLETS_SQL} AS summary, {JOB_IMAGE} AS image_url
 FROM scored LEFT JOIN cache c ON c.key = 'player:' || lower(entity) WHERE {TOPIC_SQL}),
q AS (SELECT *, CASE WHEN entity = 'Joueur Star' THEN 0.0 ELSE 3.0 END + CASE WHEN org_from = '' THEN 0.0 ELSE 2.0 END + CASE WHEN org_to = '' THEN 0.0 ELSE 2.0 END
 + CASE WHEN fee_text = 'Non communiqué' THEN 0.0 ELSE 2.0 END + CASE WHEN fee_numeric > 0 THEN 1.0 ELSE 0.0 END + CASE WHEN starts_with(image_url, 'http') THEN 1.5 ELSE 0.0 END + 4.0
 + CASE WHEN contains(status, 'OFFICIEL') THEN 2.0 WHEN contains(status, 'HERE WE GO') THEN 1.5 WHEN contains(status, 'NEGOCIATION') THEN 0.5 ELSE 0.0 END
 + least(CAST(length(summary) AS DOUBLE) / 200.0, 2.0) AS quality FROM done),
k AS (SELECT *, coalesce(CASE WHEN story_key NOT IN {s.lst(fv.INVALID_STORY_KEYS)} AND entity NOT IN {s.lst(fv.PLACEHOLDERS['entity'] + ['unknown'])} THEN {s.key_text('story_key')} END, chr(1) || doc_id) AS k,
 row_number() OVER (ORDER BY quality DESC, doc_id) AS o, CASE status WHEN '{fv.STATUS_OFFICIAL}' THEN 4 WHEN '{fv.STATUS_AGREED}' THEN 3 WHEN '{fv.STATUS_TALKS}' THEN 2 ELSE 1 END AS sp FROM q)
SELECT arg_min(doc_id, o) AS doc_id, arg_min(title, o) AS title, md5(arg_min(summary, o)) AS summary, {', '.join(first_good(c, fv.PLACEHOLDERS[c]) for c in ('entity', 'org_from', 'org_to', 'league'))},
 arg_min(status, o - sp * CAST(1000000000 AS BIGINT)) AS status, coalesce(arg_min(image_url, o) FILTER (starts_with(image_url, 'http')), arg_min(image_url, o)) AS image_url,
 arg_min({SCORES_SQL}, o) AS credibility FROM k GROUP BY k""")
def annotate_job(spark, sf):
    """Landed items to merged stories."""
    items = docs(spark, sf).select("doc_id", "title", "summary", "source", F.lit("").alias("image_url"), F.lit("").alias("url"))
    out = jobs.annotate_job(items, "doc_id", RULES, p.ENTITIES, p.ORGS, image_cache(spark, sf), p.BADGES, scores=p.SOURCE_SCORES, **LEXICON)
    return out.select("doc_id", "title", F.md5("summary").alias("summary"), "entity", "org_from", "org_to", "league", "status", "image_url", "credibility")


ITEM_ROWS = f"""{FEED}, docs AS (SELECT doc_id * 100000 + position AS doc_id, title, summary, lang AS language, source, CAST(length(summary) AS BIGINT) AS n_chars, image_url AS own, url FROM items)"""
PLACEHOLDER = {c: s.lst(fv.QUALITY_PLACEHOLDERS[c]) for c in ("entity", "org_from", "org_to", "fee_text")}


def external_or(own, other):
    return f"CASE WHEN x.e IS NULL THEN {own} ELSE {other} END AS {own}"


@query("daily_run", f"""WITH {ANNOTATED_SQL.replace(s.DOCS, ITEM_ROWS)}, cache AS ({ENTITY_CACHE}),
ext AS (SELECT doc_id * 100000 AS doc_id, quality = 1 OR toxic = 0 AS is_topic, CASE WHEN doc_id % 2 = 0 THEN 'Ext ' || CAST(doc_id % 5 AS VARCHAR) ELSE '' END AS e,
 CASE WHEN doc_id % 3 = 0 THEN 'Org' ELSE '' END AS f FROM labels),
pageimg AS (SELECT 'https://n.example.org/' || page_id || '/4' AS url, 'https://p.example.org/' || page_id || '.jpg' AS image FROM pages WHERE page_id % 2 = 0),
joined AS (SELECT t.doc_id, t.title, t.source, t.language, t.own, t.url, {external_or('entity', 'x.e')}, {external_or('org_from', 'x.f')}, {external_or('org_to', "''")},
 {external_or('fee_text', "'Non communiqué'")}, {external_or('fee_numeric', '0.0')}, {external_or('status', s.q(fv.STATUS_RUMOUR))}, {external_or('story_key', s.story_key('x.e', 'x.f', "''"))}
 FROM (SELECT * FROM scored WHERE {TOPIC_SQL}) t LEFT JOIN ext x ON x.doc_id = t.doc_id WHERE coalesce(x.is_topic, true)),
done AS (SELECT doc_id, source, language, entity, org_from, org_to, status, fee_text, fee_numeric, story_key, {HEADLINE_SQL} AS title, {BULLETS_SQL} AS summary,
 coalesce(nullif(own, ''), {JOB_IMAGE.replace(", '')", ", p.image, '')")}) AS image_url
 FROM joined LEFT JOIN cache c ON c.key = 'player:' || lower(entity) LEFT JOIN pageimg p ON p.url = joined.url),
q AS (SELECT *, {' + '.join(f"CASE WHEN trim({c}) IN {PLACEHOLDER[c]} THEN 0.0 ELSE {w} END" for c, w in (('entity', 3.0), ('org_from', 2.0), ('org_to', 2.0), ('fee_text', 2.0)))}
 + CASE WHEN fee_numeric > 0 THEN 1.0 ELSE 0.0 END + CASE WHEN starts_with(image_url, 'http') THEN 1.5 ELSE 0.0 END + 4.0
 + CASE WHEN contains(status, 'OFFICIEL') THEN 2.0 WHEN contains(status, 'HERE WE GO') THEN 1.5 WHEN contains(status, 'NEGOCIATION') THEN 0.5 ELSE 0.0 END
 + least(CAST(length(summary) AS DOUBLE) / 200.0, 2.0) AS quality FROM done),
k AS (SELECT *, coalesce(CASE WHEN trim(story_key) NOT IN {s.lst(fv.INVALID_STORY_KEYS)} AND trim(entity) NOT IN {s.lst(fv.PLACEHOLDERS['entity'] + ['unknown'])}
 THEN nullif({s.key_text('story_key')}, '') END, chr(1) || doc_id) AS k, row_number() OVER (ORDER BY round(quality, 9) DESC, doc_id) AS o FROM q),
merged AS (SELECT arg_min(language, o) AS category, arg_min(source, o) AS source,
 coalesce(arg_min(image_url, o) FILTER (starts_with(image_url, 'http')), arg_min(image_url, o)) AS image_url FROM k GROUP BY k)
SELECT category, count(*) AS articles, count(DISTINCT source) AS sources, count(*) FILTER (image_url <> '') AS images FROM merged GROUP BY 1""")
def daily_run(spark, sf):
    """Feeds, pages and an external annotation through to the stored table and its report."""
    d, i = F.col("doc_id"), F.col("page_id")
    catalog = table(spark, sf, "documents").select(d.alias("feed"), F.col("source").alias("name"), F.col("lang").alias("language"), F.col("lang").alias("category"))
    external = table(spark, sf, "labels").select(
        (d * 100000).alias("item"), ((F.col("quality") == 1) | (F.col("toxic") == 0)).alias("is_topic"),
        F.when(d % 2 == 0, F.concat(F.lit("Ext "), (d % 5).cast("string"))).otherwise("").alias("entity"), F.when(d % 3 == 0, "Org").otherwise("").alias("org_from"))
    landed_pages = table(spark, sf, "pages").select(F.concat(F.lit("https://n.example.org/"), i.cast("string"), F.lit("/4")).alias("url"), with_head(F.col("html"), i).alias("html"))
    feeds = landed_feeds(spark, sf).withColumnRenamed("doc_id", "feed")
    _, report = jobs.daily_run(feeds, catalog, p.TODAY, shared_dir(spark, "daily-articles"), RULES, p.ENTITIES, p.ORGS, image_cache(spark, sf), p.BADGES, landed_pages, external,
                               item=F.col("feed") * 100000 + F.col("position"), batch_id=1, item_limit=None, summary_limit=None, scores=p.SOURCE_SCORES, **LEXICON)
    return report["kpis"].select("category", "articles", "sources", "images")


@query("import_job", f"""WITH {REPORT}, v AS (SELECT doc_id, title, source, category, date, sort_date, summary, url, image, coalesce(try_cast(credibility AS DOUBLE), 0.0) AS credibility FROM
 (SELECT n.* REPLACE ({s.polish('r.resume')} AS summary, CASE WHEN {s.polish('r.categorie')} = '' THEN NULL ELSE {s.polish('r.categorie')} END AS category) FROM norm0 n JOIN raw r USING (doc_id)) WHERE title <> ''),
n AS (SELECT *, {s.norm("title || ' ' || summary")} AS norm FROM v), kept AS (SELECT * FROM n WHERE {TOPIC_SQL}),
d AS (SELECT *, sha1(concat_ws('|', source, title, url, date)) AS external_key, coalesce(category, {s.classify('norm', p.CLASSES, p.DEFAULT_CLASS)}) AS cat FROM kept)
SELECT doc_id AS ord, external_key, title, source, cat AS category, cat AS league, md5(summary) AS summary, url, date AS raw_date, CAST(sort_date AS TIMESTAMP) AS published_at, credibility,
 CASE WHEN {s.contains_any("lower(title || ' ' || summary)", fv.SENTIMENT_UP_WORDS)} THEN 'Bullish' WHEN {s.contains_any("lower(title || ' ' || summary)", fv.SENTIMENT_DOWN_WORDS)} THEN 'Bearish' ELSE 'Neutre' END AS sentiment
FROM d QUALIFY row_number() OVER (PARTITION BY external_key ORDER BY doc_id) = 1""")
def import_job(spark, sf):
    raw = report_raw(spark, sf)
    rows = jobs.normalize_import(raw, "doc_id", RULES, p.ENTITIES, p.ORGS, p.CLASSES, p.DEFAULT_CLASS)
    return rows.select("ord", "external_key", "title", "source", "category", "league", F.md5("summary").alias("summary"), "url", "raw_date", "published_at", "credibility", "sentiment")


# --- streams -----------------------------------------------------------------
def landed(spark, rows, name) -> DataFrame:
    """Rows landed as several files, out of order, and streamed one file a batch."""
    path = shared_dir(spark, f"landed-{name}")
    rows.repartition(4, F.md5(F.col(rows.columns[0]).cast("string"))).write.parquet(path)
    return ingest.landing(spark, path, rows.schema, files_per_batch=1)


def stream_documents(spark, sf) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int"))
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("version"),
        external_key(F.col("source"), F.md5("text"), (F.col("doc_id") % 400).cast("string"), F.date_format(day, "yyyy-MM-dd")).alias("external_key"),
        F.substring_index("text", "\n", 1).alias("title"), F.col("doc_id").alias("updated_at"), day.cast("timestamp_ntz").alias("published_at"))
    return landed(spark, rows, "documents")


@query("stream_ingest", f"""WITH {KEYED}, f AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY external_key ORDER BY doc_id DESC) = 1)
SELECT external_key, title, doc_id AS version FROM f""")
def stream_ingest(spark, sf):
    """Landed documents through a stream of upserts into the article table."""
    base = shared_dir(spark, "stream")
    ingest.upsert_stream(stream_documents(spark, sf), base + "/table", base + "/status", base + "/checkpoint").awaitTermination()
    return st.read_articles(spark, base + "/table").select("external_key", "title", "version")


@query("stream_status", """SELECT count(DISTINCT (source, text, doc_id % 400, doc_id % 30)) AS inserted, count(DISTINCT (source, text, doc_id % 400, doc_id % 30)) AS total,
 0 AS skipped FROM documents""")
def stream_status(spark, sf):
    base = shared_dir(spark, "stream")
    ingest.upsert_stream(stream_documents(spark, sf), base + "/table", base + "/status", base + "/checkpoint").awaitTermination()
    status = ingest.run_status(spark, base + "/status")
    return status.agg(F.sum("inserted").alias("inserted"), F.max("total").alias("total"), F.sum("skipped").alias("skipped"))


@query("stream_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def stream_distinct(spark, sf):
    base = shared_dir(spark, "distinct")
    rows = landed(spark, table(spark, sf, "events"), "events").withColumn("key", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    ingest.distinct_stream(rows.select("key", "user_id", "event_type"), "key", base + "/out", base + "/checkpoint").awaitTermination()
    return spark.read.parquet(base + "/out").select("user_id", "event_type")


@query("stream_fresh", f"SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '{p.AS_OF}' - INTERVAL 24 HOURS")
def stream_fresh(spark, sf):
    base = shared_dir(spark, "fresh")
    rows = ingest.fresh(landed(spark, table(spark, sf, "events"), "events"), "ts", F.lit(p.AS_OF).cast("timestamp_ntz")).select("event_id", "user_id")
    ingest.stream_to_table(rows, base + "/out", base + "/checkpoint")
    return spark.read.schema(rows.schema).parquet(base + "/out")


@query("stream_distinct_daily", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def stream_distinct_daily(spark, sf):
    """Landed week by week, with a watermark: batches meet the keys of their own dates only."""
    base, events = shared_dir(spark, "daily"), table(spark, sf, "events")
    week = F.floor((F.dayofmonth("ts") - 1) / 8)
    for k in range(4):  # files are taken in the order they land; a month has four parts
        events.filter(week == k).coalesce(1).write.mode("append").parquet(base + "/in")
    rows = ingest.landing(spark, base + "/in", events.schema, files_per_batch=1)
    ingest.distinct_by_date(rows, ["user_id", "event_type"], "ts", base + "/out", base + "/checkpoint").awaitTermination()
    return spark.read.parquet(base + "/out").select("user_id", "event_type", "day")


@query("stream_fresh_late", "SELECT event_id, user_id, ts FROM events")
def stream_fresh_late(spark, sf):
    """Files out of order: kept and late rows together are all that landed, and the counters say so."""
    base = shared_dir(spark, "late")
    rows = landed(spark, table(spark, sf, "events"), "events")
    ingest.fresh_stream(rows, "ts", base + "/kept", base + "/late", base + "/status", base + "/checkpoint").awaitTermination()
    counts = ingest.run_status(spark, base + "/status").agg(F.sum("landed"), F.sum("kept"), F.sum("late")).first()
    both = [spark.read.schema(rows.schema).parquet(base + part) for part in ("/kept", "/late")]
    if counts[0] != counts[1] + counts[2] or [df.count() for df in both] != [counts[1], counts[2]]:
        raise AssertionError(f"the counters {tuple(counts)} do not fit the rows")
    return both[0].unionByName(both[1]).select("event_id", "user_id", "ts")


@query("stream_event_counts", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS articles FROM events GROUP BY 1, 2")
def stream_event_counts(spark, sf):
    """Hourly counts over all batches."""
    base = shared_dir(spark, "windows")
    ingest.count_stream(landed(spark, table(spark, sf, "events"), "events"), "ts", ["event_type"], base + "/out", base + "/checkpoint").awaitTermination()
    return ingest.window_counts(spark, base + "/out", "event_type")


# --- store and tables -----------------------------------------------------------
@query("bootstrap_if_empty", f"WITH {KEYED} SELECT external_key, title, version FROM old")
def bootstrap_if_empty(spark, sf):
    """The first import fills the table, the second finds it filled."""
    old, new = old_and_new(spark, sf)
    path = shared_dir(spark, "articles")
    for rows in (old, new):
        st.import_if_empty(spark, path, rows.withColumn("updated_at", F.col("version")))
    return st.read_articles(spark, path).select("external_key", "title", "version")


@query("schema_change", "SELECT doc_id, lang AS language, 'new' AS status, CAST(0 AS DOUBLE) AS fee_numeric FROM documents")
def schema_change(spark, sf):
    """Columns that a later schema has are added with their defaults."""
    rows = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"))
    wide = add_columns(rows, ARTICLE, {"status": "new", "fee_numeric": 0.0})
    return wide.select("doc_id", "language", "status", "fee_numeric")


@query("schema_merge", """SELECT doc_id, source, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE lang END AS status, CASE WHEN doc_id % 2 = 0 THEN CAST(0 AS DOUBLE)
 ELSE CAST(n_chars AS DOUBLE) END AS fee_numeric FROM documents""")
def schema_merge(spark, sf):
    """Old files without two columns and new files with them, read as one table."""
    path, rows = shared_dir(spark, "merge"), table(spark, sf, "documents")
    rows.filter("doc_id % 2 = 0").select("doc_id", "source").write.parquet(path)
    rows.filter("doc_id % 2 <> 0").select("doc_id", "source", F.col("lang").alias("status"), F.col("n_chars").cast("double").alias("fee_numeric")).write.mode("append").parquet(path)
    return read_merged(spark, path, ARTICLE, {"status": "new", "fee_numeric": 0.0}).select("doc_id", "source", "status", "fee_numeric")


@query("preferred_table", "SELECT doc_id, source FROM documents")
def preferred_table(spark, sf):
    """Of two CSV tables in a folder the preferred one is read, whose files differ in the order of their columns."""
    root = shared_dir(spark, "preferred")
    rows = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source", "lang")
    even, odd = rows.filter("doc_id % 2 = 0"), rows.filter("doc_id % 2 <> 0").select("lang", "source", "doc_id")
    for part in (even, odd):
        part.write.mode("append").option("header", True).csv(f"{root}/{fv.PREFERRED_TABLES[0]}.csv")
    even.write.option("header", True).csv(f"{root}/{fv.PREFERRED_TABLES[1]}.csv")
    return read_preferred(spark, root).select(F.col("doc_id").cast("long").alias("doc_id"), "source")
