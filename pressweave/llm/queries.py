"""Registered queries of the subpackage: the operators over their whole tables, with production parameters."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressweave.llm import (
    best_position,
    collision,
    covertree,
    html_main,
    langid,
    mixing,
    packing,
    parity_join,
    pipeline,
    sharding,
    subset_sums,
    token_codes,
    vectors,
    warc,
    zstd_toxicity,
)
from pressweave.llm.common import table
from pressweave.sources.tables import shared_dir

SHARDS = [f"shard-{i:02d}" for i in range(16)]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.train(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return langid.identify(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_main.extract_main(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False).drop("ids")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = table(spark, sf_dir, "pages").select(F.col("page_id").alias("key"), "url", F.col("html").alias("payload"))
    path = shared_dir(spark, "warc")
    warc.write_archive(captures, path)
    whole = warc.assemble(warc.read_archive(spark, path))
    return whole.select(warc.capture_key(F.col("record_id")).alias("page_id"), "response.payload_bytes", "response.payload_digest",
                        F.col("response.type").alias("record_type"), warc.capture_key(F.col("response.refers_to")).alias("refers_to"))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY CASE WHEN payload_bytes >= 1000 THEN payload_digest ELSE 'small ' || page_id END) AS original
      FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN original = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN original <> page_id THEN original END AS refers_to
FROM r
"""


def op5_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    whole = rows.filter(vectors.finite(F.col("embedding"))).withColumn(
        "embedding", F.transform("embedding", lambda x: F.floor(64 * x.cast("double"))))
    found = covertree.top_inner_products(whole, F.col("vec_id") % 20 == 0, 20)
    return found.withColumn("score", F.col("score").cast("long"))


OP5_SQL = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


def op6_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collision.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS size, count(*) AS docs, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
      FROM r GROUP BY source),
fill(level, prior) AS (
  SELECT 0.0::DOUBLE, -1.0::DOUBLE
  UNION ALL
  SELECT ((SELECT sum(size)::DOUBLE * 1.5 FROM s) - coalesce(sum(CASE WHEN s.size * 2.0::DOUBLE < s.weight * f.level THEN s.size * 2.0::DOUBLE END), 0))
         / nullif(sum(CASE WHEN s.size * 2.0::DOUBLE < s.weight * f.level THEN 0 ELSE s.weight END)::DOUBLE, 0), f.level
  FROM s, fill f WHERE f.level > f.prior GROUP BY f.level),
t AS (SELECT source, size AS source_size, docs, least(size * 2.0::DOUBLE, weight * (SELECT max(level) FROM fill)) AS target FROM s),
j AS (SELECT r.doc_id, r.source, r.size, t.source_size, t.target, md5('mix-1:' || coalesce(r.doc_id::VARCHAR, '')) AS ord,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate, ceil(t.docs / 256)::BIGINT AS buckets
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, ('0x' || substr(ord, 1, 8))::BIGINT % buckets AS bucket FROM j),
w AS (SELECT *, sum(size) OVER (PARTITION BY source, bucket)::DOUBLE AS everything,
             sum(size) OVER (PARTITION BY source, bucket ORDER BY ord, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM b)
SELECT doc_id, size, source_size, target,
       (floor(rate) * size + greatest(0, least(size, floor(everything * (rate - floor(rate)) + 0.5)::BIGINT - upto + size)))::BIGINT AS taken
FROM w
"""


def op8_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parity_join.near_duplicates(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
             ELSE [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)] END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT shared.a, shared.b FROM shared JOIN n x ON x.doc_id = shared.a JOIN n y ON y.doc_id = shared.b
         WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id FROM documents d
LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sharding.place(docs, F.col("doc_id"), SHARDS).select("doc_id", "source", "slot", "shard")


OP9_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, 'shard-' || lpad(i::VARCHAR, 2, '0') AS name FROM range({len(SHARDS)}) t(i)),
pref AS (
  SELECT i, name, ('0x' || substr(md5('offset:' || name), 1, 15))::BIGINT % {sharding.SLOTS} AS start,
         ('0x' || substr(md5('skip:' || name), 1, 15))::BIGINT % {sharding.SLOTS - 1} + 1 AS step FROM shards),
fill(turn, slot, taken) AS (
  SELECT -1::BIGINT, -1::BIGINT, []::BIGINT[]
  UNION ALL
  SELECT f.turn + 1, [x FOR x IN [(p.start + j * p.step) % {sharding.SLOTS} FOR j IN range({sharding.SLOTS})]
                       IF NOT list_contains(f.taken, x)][1] AS free, list_append(f.taken, free)
  FROM fill f JOIN pref p ON p.i = (f.turn + 1) % {len(SHARDS)} WHERE f.turn + 1 < {sharding.SLOTS}),
slots AS (SELECT f.slot, p.name AS shard FROM fill f JOIN pref p ON p.i = f.turn % {len(SHARDS)} WHERE f.turn >= 0)
SELECT d.doc_id, d.source, slots.slot, slots.shard FROM documents d
JOIN slots ON slots.slot = ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SLOTS}
"""


def op10_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "token-codes")
    manifest = token_codes.write_codes(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_codes.read_codes(manifest, path, with_ids=False).drop("ids")


def op11_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_position.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 50)


OP11_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
d AS (SELECT doc_id, terms, len(terms)::BIGINT AS n FROM t WHERE len(terms) > 0),
s AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * any_value(s.docs) + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
i AS (SELECT p.doc_id, p.term, w.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (100 - 50 + (50 * p.n * s.docs) // s.length))) AS impact
      FROM p JOIN w ON w.term = p.term, s),
r AS (SELECT q.item_id, i.doc_id, sum(i.impact)::BIGINT AS score FROM q JOIN i ON i.term = q.term GROUP BY ALL HAVING sum(i.impact) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM r QUALIFY rank <= 50
"""


def op12_zstd_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = zstd_toxicity.train(docs.filter(~F.col("held_out")).select("doc_id", "text"), table(spark, sf_dir, "labels"))
    scored = zstd_toxicity.score(docs.select("doc_id", "held_out", "text"), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= zstd_toxicity.THRESHOLD).cast("int"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.withColumn("label", label).withColumn("embedding", subset_sums.whole_numbers(F.col("embedding"), 256))
    return subset_sums.hard_negatives(rows, F.col("vec_id") % 50 == 0)


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.e, c.e)::BIGINT AS score
      FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""


QUERIES = {
    "op1_language_id": (op1_language_id, None),
    "op2_html_main_text": (op2_html_main_text, None),
    "op3_packing": (op3_packing, None),
    "op4_warc": (op4_warc, OP4_SQL),
    "op5_cover_tree": (op5_cover_tree, OP5_SQL),
    "op6_collision_counting": (op6_collision_counting, None),
    "op7_mixing": (op7_mixing, OP7_SQL),
    "op8_parity_join": (op8_parity_join, OP8_SQL),
    "op9_sharding": (op9_sharding, OP9_SQL),
    "op10_token_codes": (op10_token_codes, None),
    "op11_best_position": (op11_best_position, OP11_SQL),
    "op12_zstd_toxicity": (op12_zstd_toxicity, None),
    "op13_hard_negatives": (op13_hard_negatives, OP13_SQL),
    "pipeline": (pipeline.run, pipeline.ORACLE_SQL),
}


def registry() -> dict:
    return dict(QUERIES)
