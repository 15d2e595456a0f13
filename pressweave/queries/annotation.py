"""Queries on matching, topic filter, annotation, scores and merge."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressweave import fixed_values as fv
from pressweave.functions.text import materialize, norm_text
from pressweave.operators import annotate as an
from pressweave.operators import match as m
from pressweave.operators import score as sc
from pressweave.operators import topic as tp
from pressweave.operators.joins import token_overlap_join
from pressweave.operators.merge import merge_stories
from pressweave.plans.views import docs, table, with_credibility
from pressweave.queries import params as p
from pressweave.queries import sql as s

QUERIES: dict = {}
ENTITY_TERMS = m.entity_terms(p.ENTITIES)
ORG_TERMS = m.org_terms(p.ORGS)
RULES = tp.TopicRules(entities=[t for t in ENTITY_TERMS if t.term in ("zzqx never", "hation", "thanedble")],
                      orgs=[t for t in ORG_TERMS if t.term in ("anble", "ertion")],
                      blocked=p.BLOCKED, patterns=p.TOPIC, raw_words=p.TOPIC_RAW, off_topic=p.OFF_TOPIC)


def query(name, sql):
    def register(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return register


def combined(spark, sf) -> DataFrame:
    """Documents with the normalised title and text."""
    return materialize(docs(spark, sf), norm=norm_text(F.concat_ws(" ", "title", "summary")))


NORMED = f"""{s.DOCS}, normed AS (SELECT *, {s.norm("title || ' ' || summary")} AS norm, {s.norm('title')} AS norm_title FROM docs)"""

ENTITY_SQL = f"""entity AS (SELECT doc_id, arg_min(canonical, rank) AS name FROM normed, {s.terms(ENTITY_TERMS)}
 WHERE contains(' ' || norm || ' ', ' ' || term || ' ') GROUP BY doc_id)"""

ORG_SQL = f"""org_hits AS (SELECT doc_id, canonical, rank, strpos(' ' || norm || ' ', ' ' || term || ' ') - 1 AS position
 FROM normed, {s.terms(ORG_TERMS)} WHERE contains(' ' || norm || ' ', ' ' || term || ' ')),
org_first AS (SELECT doc_id, canonical, min(rank) AS rank, arg_min(position, rank) AS position FROM org_hits GROUP BY doc_id, canonical),
orgs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position, rank) AS n FROM org_first)"""


@query("entity_match", f"WITH {NORMED}, {ENTITY_SQL} SELECT doc_id, name AS entity FROM entity")
def entity_match(spark, sf):
    hit = m.best_entity(m.phrase_hits(F.col("norm"), ENTITY_TERMS))
    return combined(spark, sf).select("doc_id", hit.alias("entity")).filter(F.col("entity").isNotNull())


@query("entity_match_join", f"WITH {NORMED}, {ENTITY_SQL} SELECT doc_id, name AS entity FROM entity")
def entity_match_join(spark, sf):
    terms = m.terms_table(spark, ENTITY_TERMS)
    hits = m.phrase_hits_join(combined(spark, sf), "doc_id", "norm", terms)
    return hits.groupBy("doc_id").agg(F.min_by("canonical", "rank").alias("entity"))


@query("dictionary_match", f"""WITH {NORMED}, terms AS (SELECT DISTINCT term FROM (SELECT unnest(string_split(norm_title, ' ')) AS term FROM normed) WHERE length(term) >= 4),
hits AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(string_split(norm, ' ')) AS w FROM normed) JOIN terms ON w = term)
SELECT doc_id, count(*) AS terms, first(w ORDER BY length(w) DESC, w) AS longest FROM hits GROUP BY doc_id""")
def dictionary_match(spark, sf):
    """A dictionary that grows with the corpus: every word of a title."""
    rows = materialize(combined(spark, sf), norm_title=norm_text(F.col("title")))
    words = rows.select(F.explode(F.split("norm_title", " ")).alias("term")).filter(F.length("term") >= 4).distinct()
    hits = m.phrase_hits_join(rows, "doc_id", "norm", words.select(F.lit(0).cast("long").alias("rank"), "term", F.col("term").alias("canonical")))
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("terms"), F.min_by("term", F.struct(-F.length("term"), "term")).alias("longest"))


@query("source_scores_by_table", f"""WITH {s.DOCS}, k AS (SELECT 'SRC' || n_nationkey AS key, n_nationkey % 7 AS value, n_nationkey AS ord FROM nation),
h AS (SELECT source, arg_min(value, ord) AS score FROM (SELECT DISTINCT source FROM docs) JOIN k ON contains(source, lower(key)) OR contains(lower(key), source) GROUP BY 1)
SELECT doc_id, docs.source, coalesce(h.score, 3)::INTEGER AS score FROM docs LEFT JOIN h ON h.source = docs.source""")
def source_scores_by_table(spark, sf):
    n = F.col("n_nationkey")
    keys = table(spark, sf, "nation").select(F.concat(F.lit("SRC"), n.cast("string")).alias("key"), (n % 7).cast("int").alias("value"), n.alias("ord"))
    rows = sc.contained_value(docs(spark, sf).select("doc_id", "source"), "source", keys, "score", both_ways=True)
    return rows.withColumn("score", F.coalesce("score", F.lit(3)))


@query("org_match", f"WITH {NORMED}, {ORG_SQL} SELECT doc_id, n, canonical AS org, position FROM orgs")
def org_match(spark, sf):
    d = materialize(combined(spark, sf), hits=m.phrase_hits(F.col("norm"), ORG_TERMS))
    return d.select("doc_id", F.posexplode(m.orgs_in_order(F.col("hits"), F.col("norm"))).alias("n", "o")).select(
        "doc_id", (F.col("n") + 1).cast("bigint").alias("n"), F.col("o.canonical").alias("org"),
        F.col("o.position").cast("bigint").alias("position"))


TOPIC_SQL = f"""CASE WHEN norm = '' THEN false WHEN {s.contains_any(s.norm("coalesce(nullif(source, ''), title)"), p.BLOCKED)} THEN false
 WHEN {s.hit('norm', RULES.entities + RULES.orgs)} THEN true
 ELSE ({s.any_pattern('norm', p.TOPIC)} OR {s.contains_any("(title || ' ' || summary)", p.TOPIC_RAW)})
  AND NOT {s.any_pattern('norm', p.OFF_TOPIC)} END"""
TOPIC_DOCS = NORMED.replace(
    "lang AS language,\n  source,", "lang AS language,\n  CASE WHEN doc_id % 9 = 0 THEN '' ELSE source END AS source,")


def unsourced(spark, sf):
    return docs(spark, sf).withColumn("source", F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("source")))


@query("topic_filter", f"WITH {TOPIC_DOCS} SELECT doc_id, source FROM normed WHERE {TOPIC_SQL}")
def topic_filter(spark, sf):
    return tp.keep_on_topic(unsourced(spark, sf), RULES).select("doc_id", "source")


@query("blocked_sources", f"""WITH {TOPIC_DOCS} SELECT doc_id, source FROM docs
 WHERE {s.contains_any(s.norm("coalesce(nullif(source, ''), title)"), p.BLOCKED)}""")
def blocked_sources(spark, sf):
    return unsourced(spark, sf).filter(tp.is_blocked(F.col("source"), F.col("title"), p.BLOCKED)).select("doc_id", "source")


@query("keyword_filter", f"WITH {s.DOCS} SELECT doc_id, title FROM docs WHERE regexp_matches(title, '(?i)THING')")
def keyword_filter(spark, sf):
    return tp.keyword_filter(docs(spark, sf), "title", "THING").select("doc_id", "title")


@query("purge_counts", f"""WITH {TOPIC_DOCS}, k AS (SELECT {TOPIC_SQL} AS keep FROM normed)
SELECT count(*) AS total, count(*) FILTER (NOT keep) AS purged, count(*) FILTER (keep) AS remaining FROM k""")
def purge_counts(spark, sf):
    return tp.purge_counts(unsourced(spark, sf), RULES)


@query("classify", f"WITH {NORMED} SELECT doc_id, {s.classify('norm', p.CLASSES, p.DEFAULT_CLASS)} AS class FROM normed")
def classify(spark, sf):
    return combined(spark, sf).select("doc_id", an.classify(F.col("norm"), p.CLASSES, p.DEFAULT_CLASS).alias("class"))


@query("classify_encoded", f"WITH {NORMED} SELECT doc_id, {s.classify('norm', p.CLASSES, p.DEFAULT_CLASS)} AS class FROM normed")
def classify_encoded(spark, sf):
    """The class does not change if characters of the text are percent-encoded."""
    raw = F.concat_ws(" ", "title", "summary")
    for plain, coded in (("%", "%25"), ("ó", "%C3%B3"), ("é", "%c3%a9"), ("q", "%71"), (" d", "%20d")):
        raw = F.replace(raw, F.lit(plain), F.lit(coded))
    return docs(spark, sf).select("doc_id", an.classify_text(raw, p.CLASSES, p.DEFAULT_CLASS).alias("class"))


@query("sentiment", f"""WITH {s.DOCS}, t AS (SELECT doc_id, lower(title || ' ' || summary) AS t FROM docs)
SELECT doc_id, CASE WHEN {s.contains_any('t', p.UP_WORDS)} THEN 'Bullish' WHEN {s.contains_any('t', p.DOWN_WORDS)} THEN 'Bearish'
 ELSE 'Neutre' END AS sentiment FROM t""")
def sentiment(spark, sf):
    return docs(spark, sf).select("doc_id", an.lexicon_sentiment(
        F.concat_ws(" ", "title", "summary"), p.UP_WORDS, p.DOWN_WORDS).alias("sentiment"))


@query("status", f"""WITH {s.DOCS}, v AS (SELECT doc_id, {s.status_of('title', p.STATUS)} AS status FROM docs)
SELECT doc_id, status, CASE WHEN contains(status, 'OFFICIEL') OR contains(status, 'HERE WE GO') THEN 'Positif' ELSE 'Neutre' END AS sentiment FROM v""")
def status(spark, sf):
    st = docs(spark, sf).select("doc_id", an.status_of(F.col("title"), p.STATUS).alias("status"))
    return st.withColumn("sentiment", an.status_sentiment(F.col("status")))


def said(prefixes, org):
    return "(" + " OR ".join(f"contains(norm, {s.q(x + ' ')} || {s.norm(org)})" for x in prefixes) + ")"


def pays(org):
    return f"({said(fv.PAYS_ORG_PREFIXES, org)} OR contains(norm, 'ao ' || {s.norm(org)} || ' por'))"


ANNOTATED_SQL = f"""{NORMED}, {ENTITY_SQL}, {ORG_SQL},
parts AS (SELECT d.*, e.name AS known, o1.canonical AS first, o2.canonical AS second, a.org AS current, a.nationality AS nation
 FROM normed d LEFT JOIN entity e USING (doc_id) LEFT JOIN orgs o1 ON o1.doc_id = d.doc_id AND o1.n = 1
 LEFT JOIN orgs o2 ON o2.doc_id = d.doc_id AND o2.n = 2
 LEFT JOIN {s.values([(n, v['org'], v['nationality']) for n, v in p.ENTITIES.items()], 'name, org0, nationality0', 'a0')} ON a0.name = e.name
 LEFT JOIN (SELECT name, nullif(org0, '') AS org, nullif(nationality0, '') AS nationality FROM
  {s.values([(n, v['org'], v['nationality']) for n, v in p.ENTITIES.items()], 'name, org0, nationality0', 'a1')}) a ON a.name = e.name),
branch AS (SELECT *, CASE
 WHEN {s.contains_any('norm_title', p.WORDING['extension'])} THEN 'xx'
 WHEN second IS NOT NULL THEN CASE WHEN {pays('second')} THEN '21' WHEN {pays('first')} THEN '12'
  WHEN {said(['proposta do'], 'first')} THEN '21' WHEN {said(['proposta do'], 'second')} THEN '12'
  WHEN {said(fv.TOWARDS_ORG_PREFIXES, 'second')} THEN '12' WHEN {said(fv.TOWARDS_ORG_PREFIXES, 'first')} THEN '21'
  WHEN current = first THEN '12' WHEN current = second THEN '21' ELSE '12' END
 WHEN first IS NOT NULL THEN CASE WHEN current = first THEN 'c-' WHEN current IS NOT NULL THEN 'c1'
  WHEN {s.contains_any('norm_title', p.WORDING['towards'])} THEN '-1' WHEN {s.contains_any('norm_title', p.WORDING['leaves'])} THEN '1-' ELSE '-1' END
 ELSE 'c-' END AS b FROM parts),
annotated AS (SELECT *,
 coalesce(CASE b[1] WHEN 'x' THEN coalesce(current, first) WHEN '1' THEN first WHEN '2' THEN second WHEN 'c' THEN current END, '') AS org_from,
 coalesce(CASE b[2] WHEN 'x' THEN coalesce(current, first) WHEN '1' THEN first WHEN '2' THEN second END, '') AS org_to,
 coalesce(known, CASE WHEN pair <> '' AND lower(pair) NOT IN {s.lst(p.ORGS)} THEN pair ELSE 'Joueur Star' END) AS entity,
 coalesce(nation, '{fv.DEFAULT_NATIONALITY}') AS nationality,
 {s.status_of('title', p.STATUS)} AS status, {s.classify('norm', p.CLASSES, p.DEFAULT_CLASS)} AS league,
 coalesce({s.fee_text("title || ' ' || summary")}, 'Non communiqué') AS fee_text
 FROM (SELECT *, regexp_extract(title, '(?:^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])([A-ZÀ-ÿ][a-zà-ÿ]+(?:\\s+[A-ZÀ-ÿ][a-zà-ÿ]+))(?:[^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)', 1) AS pair FROM branch)),
scored AS (SELECT *, CASE WHEN fee_text = 'Non communiqué' THEN 0.0 ELSE {s.numeric_fee('fee_text')} END AS fee_numeric,
 {s.story_key('entity', 'org_from', 'org_to')} AS story_key FROM annotated)"""


def annotated(spark, sf, fields=an.ANNOTATED) -> DataFrame:
    """Documents with the local annotation, or some fields of it."""
    return an.annotate(docs(spark, sf), p.ENTITIES, p.ORGS, p.CLASSES, p.DEFAULT_CLASS, p.STATUS, p.WORDING, fields=fields)


@query("direction", f"WITH {ANNOTATED_SQL} SELECT doc_id, org_from, org_to FROM scored")
def direction(spark, sf):
    return annotated(spark, sf, ["org_from", "org_to"]).select("doc_id", "org_from", "org_to")


@query("annotate", f"""WITH {ANNOTATED_SQL} SELECT doc_id, entity, nationality, org_from, org_to, status, league, fee_text,
 fee_numeric, story_key FROM scored""")
def annotate(spark, sf):
    return annotated(spark, sf).select("doc_id", "entity", "nationality", "org_from", "org_to", "status", "league",
                                       "fee_text", "fee_numeric", "story_key")


HEADLINE_SQL = """(CASE WHEN contains(status, 'OFFICIEL') THEN '🚨 OFFICIEL :' WHEN contains(status, 'HERE WE GO') THEN '🔥 HERE WE GO :'
 WHEN contains(status, 'NEGOCIATION') THEN '💬 NÉGOCIATION :' ELSE '📰 RUMEUR :' END || ' ' ||
 CASE WHEN entity <> '' AND org_to <> '' AND org_from <> '' AND org_from <> org_to THEN entity || ' quitte ' || org_from || ' pour ' || org_to || ' — ' || fee_text
 WHEN entity <> '' AND org_to <> '' THEN entity || ' en route vers ' || org_to WHEN entity <> '' THEN 'Mise à jour sur l''avenir de ' || entity ELSE title END)"""
BULLETS_SQL = """concat_ws(chr(10) || chr(10), CASE WHEN entity <> '' AND org_to <> '' THEN '🚨 ' || org_to || ' a trouvé un accord pour ' || entity || '.'
 WHEN entity <> '' THEN '🚨 Mise à jour importante sur l''avenir de ' || entity || '.' ELSE '🚨 ' || title END,
 CASE WHEN org_from <> '' AND org_to <> '' AND org_from <> org_to THEN '🤝 Négociations avancées entre ' || org_from || ' et ' || org_to || '.'
  WHEN org_from = org_to AND org_from <> '' THEN '📝 Prolongation de contrat avec ' || org_from || '.' END,
 CASE WHEN fee_text <> '' AND fee_text <> 'Non communiqué' THEN '💶 Montant convenu : ' || fee_text || ' + bonus et variables.' END,
 '🩺 Visite médicale prévue, termes personnels acceptés.', '💬 Note ce transfert de 1 à 10 ! ⏬')"""


@query("headlines", f"WITH {ANNOTATED_SQL} SELECT doc_id, {HEADLINE_SQL} AS headline, {BULLETS_SQL} AS bullets FROM scored")
def headlines(spark, sf):
    c = [F.col(x) for x in ("entity", "org_from", "org_to", "fee_text", "title")]
    return annotated(spark, sf, ["status", "entity", "org_from", "org_to", "fee_text"]).select("doc_id", an.headline(F.col("status"), *c).alias("headline"),
                                       an.bullet_summary(*c).alias("bullets"))


EXTERNAL_SQL = """external AS (SELECT doc_id, quality = 1 OR toxic = 0 AS is_topic, CASE WHEN doc_id % 2 = 0 THEN 'Ext ' || CAST(doc_id % 5 AS VARCHAR) ELSE '' END AS e,
 CASE WHEN doc_id % 3 = 0 THEN 'Org' ELSE '' END AS f, CASE WHEN doc_id % 4 = 0 THEN 'K-' || CAST(doc_id % 7 AS VARCHAR) ELSE '' END AS k,
 CASE WHEN doc_id % 5 = 0 THEN 3.5 END AS c FROM labels)"""


@query("annotation_merge", f"""WITH {ANNOTATED_SQL}, {EXTERNAL_SQL}
SELECT doc_id, CASE WHEN e IS NULL THEN entity ELSE e END AS entity, CASE WHEN e IS NULL THEN org_from ELSE f END AS org_from,
 CASE WHEN e IS NULL THEN org_to ELSE '' END AS org_to, CASE WHEN e IS NULL THEN league ELSE '{fv.DEFAULT_REMOTE_LEAGUE}' END AS league,
 CASE WHEN e IS NULL THEN 4.0 ELSE coalesce(c, 4.0) END AS credibility,
 CASE WHEN e IS NULL THEN story_key ELSE coalesce(nullif(k, ''), {s.story_key('e', 'f', "''")}) END AS story_key,
 CASE WHEN e IS NULL THEN 'local' ELSE 'external' END AS annotated_by
FROM scored LEFT JOIN external USING (doc_id) WHERE coalesce(is_topic, true)""")
def annotation_merge(spark, sf):
    d = F.col("doc_id")
    ext = table(spark, sf, "labels").select(
        d, ((F.col("quality") == 1) | (F.col("toxic") == 0)).alias("is_topic"),
        F.when(d % 2 == 0, F.concat(F.lit("Ext "), (d % 5).cast("string"))).otherwise("").alias("entity"),
        F.when(d % 3 == 0, "Org").otherwise("").alias("org_from"),
        F.when(d % 4 == 0, F.concat(F.lit("K-"), (d % 7).cast("string"))).otherwise("").alias("story_key"),
        F.when(d % 5 == 0, 3.5).alias("credibility"))
    local = annotated(spark, sf, [f for f in an.ANNOTATED if f != "sentiment"]).drop("summary").withColumn("credibility", F.lit(4.0))
    return an.merge_annotations(local, ext, "doc_id").select(
        "doc_id", "entity", "org_from", "org_to", "league", "credibility", "story_key", "annotated_by")


@query("skip_filter", f"""WITH {s.DOCS} SELECT doc_id, title FROM docs WHERE doc_id NOT IN
 (SELECT doc_id FROM labels WHERE NOT (quality = 1 OR toxic = 0))""")
def skip_filter(spark, sf):
    ext = table(spark, sf, "labels").select("doc_id", ((F.col("quality") == 1) | (F.col("toxic") == 0)).alias("is_topic"))
    return an.skip_off_topic(docs(spark, sf).select("doc_id", "title"), ext, "doc_id")


# rows ready for quality and merge: annotation, image, fee and credibility that vary with the document
MERGE_IMAGE = """CASE doc_id % 5 WHEN 0 THEN concat('https://img.example.org/', source, '.jpg') WHEN 1 THEN '/images/x.png' WHEN 2 THEN 'nan' ELSE '' END"""
MERGE_FEE = """CASE doc_id % 4 WHEN 0 THEN concat(CAST(n_chars % 60 AS VARCHAR(9)), ' M€') WHEN 1 THEN 'Non communiqué' ELSE '' END"""

STORY_SQL = f"""{ANNOTATED_SQL}, stories AS (SELECT d.doc_id, d.title, d.source, d.entity, d.org_from, d.org_to, d.nationality, d.league, d.status, d.story_key,
 length(d.summary) AS summary_len, {MERGE_IMAGE} AS image_url, {MERGE_FEE} AS fee_text,
 CASE WHEN doc_id % 4 = 0 THEN CAST(n_chars % 60 AS DOUBLE) ELSE 0.0 END AS fee_numeric, {s.CRED} AS credibility FROM scored d),
quality AS (SELECT *, CASE WHEN trim(entity) IN {s.lst(fv.QUALITY_PLACEHOLDERS['entity'])} THEN 0.0 ELSE 3.0 END
 + CASE WHEN trim(org_from) IN {s.lst(fv.QUALITY_PLACEHOLDERS['org_from'])} THEN 0.0 ELSE 2.0 END
 + CASE WHEN trim(org_to) IN {s.lst(fv.QUALITY_PLACEHOLDERS['org_to'])} THEN 0.0 ELSE 2.0 END
 + CASE WHEN trim(fee_text) IN {s.lst(fv.QUALITY_PLACEHOLDERS['fee_text'])} THEN 0.0 ELSE 2.0 END
 + CASE WHEN fee_numeric > 0 THEN 1.0 ELSE 0.0 END + CASE WHEN starts_with(image_url, 'http') THEN 1.5 ELSE 0.0 END + credibility
 + CASE WHEN contains(status, 'OFFICIEL') THEN 2.0 WHEN contains(status, 'HERE WE GO') THEN 1.5 WHEN contains(status, 'NEGOCIATION') THEN 0.5 ELSE 0.0 END
 + least(CAST(summary_len AS DOUBLE) / 200.0, 2.0) AS quality FROM stories)"""


def stories(spark, sf) -> DataFrame:
    rows = annotated(spark, sf, ["entity", "org_from", "org_to", "nationality", "league", "status", "story_key"]).select(
        "doc_id", "title", "summary", "source", "entity", "org_from", "org_to", "nationality", "league", "status", "story_key",
        F.expr(MERGE_IMAGE).alias("image_url"), F.expr(MERGE_FEE).alias("fee_text"),
        F.when(F.col("doc_id") % 4 == 0, (F.col("n_chars") % 60).cast("double")).otherwise(0.0).alias("fee_numeric"))
    return with_credibility(rows, spark, sf)


@query("quality_score", f"WITH {STORY_SQL} SELECT doc_id, round(quality, 6) AS quality FROM quality")
def quality_score(spark, sf):
    df = stories(spark, sf)
    return df.select("doc_id", F.round(sc.quality_score(df), 6).alias("quality"))


def first_good(column, placeholders):
    return (f"coalesce(arg_min(trim({column}), o) FILTER (trim({column}) NOT IN {s.lst(placeholders)}), arg_min({column}, o)) AS {column}")


@query("story_merge", f"""WITH {STORY_SQL}, keyed AS (SELECT *, CASE WHEN trim(story_key) NOT IN {s.lst(fv.INVALID_STORY_KEYS)}
  AND trim(entity) NOT IN {s.lst(fv.PLACEHOLDERS['entity'] + ['unknown'])} THEN {s.key_text('story_key')} END AS k,
  row_number() OVER (ORDER BY quality DESC, doc_id) AS o,
  CASE status WHEN '{fv.STATUS_OFFICIAL}' THEN 4 WHEN '{fv.STATUS_AGREED}' THEN 3 WHEN '{fv.STATUS_TALKS}' THEN 2 WHEN '{fv.STATUS_RUMOUR}' THEN 1 ELSE 0 END AS sp FROM quality)
SELECT arg_min(doc_id, o) AS doc_id, arg_min(title, o) AS title, arg_min(source, o) AS source, arg_min(story_key, o) AS story_key,
 {', '.join(first_good(c, fv.PLACEHOLDERS[c]) for c in ('entity', 'org_from', 'org_to', 'fee_text', 'nationality', 'league'))},
 max(fee_numeric) AS fee_numeric, max(credibility) AS credibility, arg_min(status, o - sp * CAST(1000000000 AS BIGINT)) AS status,
 coalesce(arg_min(image_url, o) FILTER (starts_with(image_url, 'http')), arg_min(image_url, o) FILTER (image_url NOT IN ('', 'nan', 'None')), arg_min(image_url, o)) AS image_url
FROM keyed WHERE k IS NOT NULL GROUP BY k
UNION ALL SELECT doc_id, title, source, story_key, entity, org_from, org_to, fee_text, nationality, league, fee_numeric, credibility, status, image_url
FROM keyed WHERE k IS NULL""")
def story_merge(spark, sf):
    return merge_stories(stories(spark, sf), "doc_id").select(
        "doc_id", "title", "source", "story_key", "entity", "org_from", "org_to", "fee_text", "nationality", "league",
        "fee_numeric", "credibility", "status", "image_url")


@query("source_score", f"""WITH {s.DOCS}, n AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 13 = 0 THEN 'RC1' ELSE source END AS source FROM docs)
SELECT doc_id, source, CASE WHEN source = '' THEN 3 {' '.join(f"WHEN contains(lower(source), {s.q(k.lower())}) OR contains({s.q(k.lower())}, lower(source)) THEN {v}" for k, v in p.SOURCE_SCORES.items())} ELSE 3 END AS score FROM n""")
def source_score(spark, sf):
    d = F.col("doc_id")
    named = docs(spark, sf).select("doc_id", F.when(d % 11 == 0, "").when(d % 13 == 0, "RC1").otherwise(F.col("source")).alias("source"))
    return named.select("doc_id", "source", sc.source_score(F.col("source"), p.SOURCE_SCORES).alias("score"))


@query("badge_lookup", f"""WITH {ANNOTATED_SQL} SELECT doc_id, org_to, CASE {' '.join(f"WHEN contains(lower(org_to), {s.q(k.lower())}) THEN {s.q(v)}" for k, v in p.BADGES.items())} ELSE '' END AS badge FROM scored""")
def badge_lookup(spark, sf):
    return annotated(spark, sf, ["org_to"]).select("doc_id", "org_to", sc.first_contained(F.col("org_to"), p.BADGES).alias("badge"))


@query("badge_by_table", f"""WITH {ANNOTATED_SQL} SELECT doc_id, org_to, coalesce(CASE {' '.join(f"WHEN contains(lower(org_to), {s.q(k.lower())}) THEN {s.q(v)}" for k, v in p.BADGES.items())} END, '') AS badge FROM scored""")
def badge_by_table(spark, sf):
    """Badges that are a table of any size."""
    badges = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(p.BADGES.items())], "key string, value string, ord int")
    rows = sc.contained_value(annotated(spark, sf, ["org_to"]).select("doc_id", "org_to"), "org_to", badges, "badge")
    return rows.withColumn("badge", F.coalesce("badge", F.lit("")))


@query("names_in_titles", f"""WITH {s.DOCS}, k AS (SELECT lower(substr(trim(text), 1, 4)) AS key, min(item_id) AS ord FROM benchmark GROUP BY 1),
h AS (SELECT t, arg_min(key, ord) AS name FROM (SELECT DISTINCT lower(title) AS t FROM docs WHERE title <> '') JOIN k ON contains(t, key) GROUP BY 1)
SELECT doc_id, h.name FROM docs LEFT JOIN h ON h.t = lower(title)""")
def names_in_titles(spark, sf):
    """Keys that come from a table, looked for in every title whatever its length."""
    key = F.lower(F.substring(F.trim("text"), 1, 4))
    keys = table(spark, sf, "benchmark").groupBy(key.alias("key")).agg(F.min("item_id").alias("ord")).withColumn("value", F.col("key"))
    return sc.contained_value(docs(spark, sf).select("doc_id", "title"), "title", keys, "name").select("doc_id", "name")


@query("nationality_lookup", f"""WITH {NORMED}, {ENTITY_SQL} SELECT doc_id, e.name AS entity, n.nationality FROM entity e
 LEFT JOIN {s.values(list(p.NATIONS.items()), 'name, nationality', 'n')} ON n.name = e.name""")
def nationality_lookup(spark, sf):
    nations = spark.createDataFrame(list(p.NATIONS.items()), "entity string, nationality string")
    return entity_match(spark, sf).join(nations, "entity", "left")


OVERLAP_STOP = ["the", "and", "que", "die", "der", "und", "les", "des", "los", "las"]


@query("token_overlap_join", f"""WITH {s.DOCS}, t AS (SELECT doc_id, {s.tokens('title', OVERLAP_STOP)} AS t FROM docs),
c AS (SELECT item_id, {s.tokens('text', OVERLAP_STOP)} AS c FROM benchmark),
j AS (SELECT doc_id, item_id, len(t) AS n, len(list_intersect(t, c)) AS overlap FROM t, c)
SELECT doc_id, item_id, overlap FROM j WHERE n > 0 AND overlap >= CASE WHEN n <= 2 THEN n WHEN n <= 4 THEN 2 ELSE greatest(2, n // 3) END""")
def token_overlap(spark, sf):
    out = token_overlap_join(docs(spark, sf), "doc_id", "title", table(spark, sf, "benchmark"), "item_id", "text", OVERLAP_STOP)
    return out.withColumn("overlap", F.col("overlap").cast("bigint"))


@query("annotate_by_tables", f"""WITH {ANNOTATED_SQL} SELECT doc_id, entity, nationality, org_from, org_to FROM scored""")
def annotate_by_tables(spark, sf):
    """The annotation with dictionaries that are tables."""
    people = spark.createDataFrame([(i, n, a["org"], a["nationality"], a["aliases"]) for i, (n, a) in enumerate(p.ENTITIES.items())],
                                   "ord int, name string, org string, nationality string, aliases array<string>")
    orgs = spark.createDataFrame([(i, a, c) for i, (a, c) in enumerate(p.ORGS.items())], "ord int, alias string, canonical string")
    rows = an.annotate(docs(spark, sf), people, orgs, p.CLASSES, p.DEFAULT_CLASS, p.STATUS, p.WORDING, key="doc_id")
    return rows.select("doc_id", "entity", "nationality", "org_from", "org_to")
