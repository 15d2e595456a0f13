import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from pressweave.operators.joins import resolve_images
from pressweave.operators.topic import TopicRules
from pressweave.operators.match import org_terms
from pressweave.plans import jobs
from pressweave.sources import cardtree as ctree
from pressweave.sources import feeds as fd
from pressweave.sources import pages as pg
from pressweave.operators import store as st
from pressweave.sources import tables as tb
from pressweave.streaming import ingest

FEED = """<?xml version="1.0"?><rss xmlns:media="m"><channel><title>chan</title>
<item><title>Blue &amp;amp; <![CDATA[x]]></title><link> https://a.b/1 </link><description><![CDATA[<p>Hello <img src="https://i/1.jpg"> &amp; all</p>]]></description><pubDate>Tue, 02 Jan 2024</pubDate></item>
<item><title>Second</title><link>https://a.b/2</link><enclosure url="https://i/2.PNG" type="image/png"/><description>&lt;b&gt;Blue&lt;/b&gt; text</description></item>
<item><title>Third blue</title><link>https://a.b/3</link><enclosure url="https://i/3.mp3"/><media:thumbnail url="https://i/3.jpg"/></item>
<item><title>Fourth blue</title><link>https://a.b/4</link><image url="https://i/4.gif"/></item>
<item><title></title><link>https://a.b/5</link></item><item><title>no link</title></item>
<item><title>Sixth blue</title><link>https://a.b/6</link></item></channel></rss>"""
PAGE = """<html><head><meta content='D &eacute;' property="og:description"><meta name="twitter:image" content="/i.png"></head><body><nav><p>%s</p></nav>
<p>short</p></body></html>""" % ("n" * 80)


def test_feed_items(spark, tmp_path):
    (tmp_path / "f1.xml").write_text(FEED)
    (tmp_path / "f2.xml").write_text("<rss>" + "".join(f"<item><title>t{i} blue</title><link>http://x/{i}</link></item>" for i in range(40)) + "</rss>")
    items = fd.feed_items(fd.read_feed_files(spark, str(tmp_path)), "2024-02-01")
    one = items.filter("feed = 'f1'").orderBy("position").collect()
    assert [r["url"] for r in one] == [f"https://a.b/{i}" for i in (1, 2, 3, 4, 6)]
    assert [r["image_url"] for r in one] == ["https://i/1.jpg", "https://i/2.PNG", "https://i/3.jpg", "https://i/4.gif", ""]
    assert [r["summary"] for r in one] == ["Hello & all", "Blue text", "Third blue", "Fourth blue", "Sixth blue"]
    assert one[0]["raw_date"] == "Tue, 02 Jan 2024" and one[1]["raw_date"] == "2024-02-01"
    assert items.filter("feed = 'f2'").count() == 25
    catalog = spark.createDataFrame([("f1", "Feed One", "en", "c")], "feed string, name string, language string, category string")
    rules = TopicRules(orgs=org_terms({"blue": "Blues"}), patterns=[])
    landed = fd.land_items(items, catalog, rules)
    assert {r["url"][-1] for r in landed.filter("source IS NOT NULL").collect()} == {"1", "2", "3", "4", "6"} and one[0]["title"] == "Blue & x"
    pages = spark.createDataFrame([("https://a.b/6", '<img class="a" src="https://i/logo.png">'), ("https://a.b/6", '<meta property="og:image" content="https://i/6.jpg">')], "url string, html string")
    assert fd.fill_from_pages(landed, pages).filter("url = 'https://a.b/6'").first()["image_url"] == "https://i/6.jpg"


def test_page_metadata(spark):
    df = spark.createDataFrame([(1, "https://a.b/x", PAGE), (2, "https://a.b/y", f"<p>{'w' * 61}</p><p>{'z' * 400}</p>"), (3, "u", "<p class='x'>" + "k" * 301 + "</p>"), (4, "u", None)],
                               "page_id int, url string, html string")
    got = {r["page_id"]: (r["summary"], r["image_url"], r["image_caption"]) for r in pg.page_metadata(df).collect()}
    assert got[1] == ("D é", "https://a.b/i.png", "D é") and got[2] == ("w" * 61, "", "w" * 61)
    assert got[3][0] == "k" * 300 + "..." and got[4] == ("", "", "")


def test_page_cards(spark):
    few = '<article><h2>A long enough title</h2><a href="/p1">x</a><time datetime="2024-01-05T10:00"></time></article><article><h2>short</h2><a href="/p2"></a></article>' \
          '<article><h3>A long enough title</h3><a href="/p3">x</a></article><h1><a href="https://z/q">Heading with link</a></h1><a href="h2"><h2>Inside a link here</h2></a><h3>No link heading</h3>'
    many = "".join(f'<article><h2>Title number {i:03d}</h2><a href="{i}">x</a></article>' for i in range(35)) + '<h1><a href="q">Heading with link</a></h1>'
    df = spark.createDataFrame([(1, few), (2, many)], "page_id int, html string")
    cards = pg.page_cards(df, F.lit("S"), F.lit("https://b/"), "2024-02-01").orderBy("page_id", "position").collect()
    one = [(r["title"], r["url"], r["date"]) for r in cards if r["page_id"] == 1]
    assert one == [("A long enough title", "https://b/p1", "2024-01-05"), ("Heading with link", "https://z/q", "2024-02-01"), ("Inside a link here", "https://b/h2", "2024-02-01")]
    assert len([r for r in cards if r["page_id"] == 2]) == 30


def test_cards_of_a_parsed_page(spark):
    nested = "<article><div><article><h2>An inner card &amp; more</h2><a href=/in>x</a></article></div><h2>The outer card title</h2><a href='/out'>y</a></article>"
    # the outer container's first title and link are the inner ones, a title counts once, and a heading without a link gives none
    assert ctree.cards_of(nested, "T") == [("An inner card & more", "/in", "T", False)]
    deep = "<a href='/outer'><section><div><h2>A heading <b>deep</b> inside</h2></div></section></a><h3><span><a href=/own>Its own link here</a></span></h3><h1>No link at all here</h1>"
    assert ctree.cards_of(deep, "T") == [("A heading deep inside", "/outer", "T", True), ("Its own link here", "/own", "T", True)]
    dated = "<li><script>var a = '<a href=no>'</script><a href=' /x '>Ten letters long</a><time datetime=2024-05-06T10:00></time></li>" * 2
    assert ctree.cards_of(dated, "T", ("li",), ("a",)) == [("Ten letters long", "/x", "2024-05-06", False)]
    many = "".join(f"<article><h2>Title number {i:03d}</h2><a href={i}>x</a></article>" for i in range(60))
    assert len(ctree.cards_of(many, "T")) == 30 and len(ctree.cards_of(many, "T", max_containers=None)) == 60
    assert ctree.cards_of("<div>" * 20_000 + "<h1>A heading far down</h1>" + "</p></div>" * 20_000, "T") == []
    df = spark.createDataFrame([(1, nested), (2, None), (3, ""), (4, deep)], "page_id int, html string")
    rows = ctree.page_cards(df, F.lit("S"), F.lit("https://b/"), "T").collect()
    assert {(r["page_id"], r["url"]) for r in rows} >= {(1, "https://b/in"), (4, "https://b/outer"), (4, "https://b/own")} and {r["page_id"] for r in rows} == {1, 4}


def test_image_priority(spark):
    rows = [(1, "https://x/ok.jpg", "Ana", "Real X", "", "u1"), (2, "https://x/pixel.png", "Ana", "Real X", "", "u1"), (3, "", "Joueur Star", "Real X", "", "u1"),
            (4, None, "Zed", "Club Cible", "Foo", "u1"), (5, "", "", "", "", "http://p/1"), (6, "", "", "", "", "none")]
    df = spark.createDataFrame(rows, "id int, image_url string, entity string, org_to string, org_from string, url string")
    cache = spark.createDataFrame([("player:ana", "http://c/ana"), ("badge:foo", "http://c/foo")], "key string, value string")
    pages = spark.createDataFrame([("http://p/1", "http://p/1.jpg")], "url string, image_url string")
    got = [r["best_image"] for r in resolve_images(df, "id", cache, {"real": "http://b/real"}, pages).orderBy("id").collect()]
    assert got == ["https://x/ok.jpg", "http://c/ana", "http://b/real", "http://c/foo", "http://p/1.jpg", ""]


def test_import_and_report(spark):
    raw = spark.createDataFrame([(1, "Premier sujet football", "BBC Sport", "fr", "https://e/1", "2026-04-26", "Resume 1", "Football", 5), (2, "Premier sujet football", "BBC Sport", "fr", "https://e/1", "2026-04-26", "dup", "Football", 5),
                                 (3, "recette de cuisine", "X", "fr", "u", "26/4/2026", "", "", 1)], "ord int, title string, source string, lang string, url string, date string, resume string, category string, credibility int")
    out = jobs.normalize_import(raw.withColumn("player_name", F.lit("Joueur Star")), "ord", TopicRules(), {"Petit": {"aliases": []}}, {"blue": "Blues"}).collect()
    assert len(out) == 1 and out[0]["summary"] == "Resume 1" and out[0]["published_at"] == dt.datetime(2026, 4, 26) and out[0]["league"] == "Football"
    assert out[0]["entity"] == "Joueur Star" and out[0]["fee_text"] == "Non communiqué" and out[0]["credibility"] == 5.0
    report = jobs.report_job(raw.filter("ord <> 2"), "ord")
    kpis = {r["category"]: tuple(r) for r in report["kpis"].collect()}
    assert kpis["Football"] == ("Football", 1, 1, 0, "5.0/5") and kpis["Autre"][4] == "1.0/5"
    digest = {r["category"]: r["digest"] for r in report["digest"].collect()}
    assert digest["Football"] == "1 article suivi aujourd'hui dans Football. Temps fort: Premier sujet football. Sources les plus presentes: BBC Sport."
    assert [r["link"] for r in report["index"].collect()] == ["Football_latest.html", "Autre_latest.html"]
    assert report["cards"].first()["title"] == "Premier sujet football"


def landing_rows(spark, path, rows):
    spark.createDataFrame(rows, "external_key string, title string, published_at timestamp_ntz, updated_at int").coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch_and_repeats_are_harmless(spark):
    base = tb.shared_dir(spark, "s")
    day = dt.datetime(2024, 1, 1)

    def run():
        stream = ingest.landing(spark, base + "/in", spark.read.parquet(base + "/in").schema, files_per_batch=1)
        ingest.upsert_stream(stream, base + "/table", base + "/status", base + "/cp").awaitTermination()
        return {r["external_key"]: r["title"] for r in st.read_articles(spark, base + "/table").collect()}

    landing_rows(spark, base + "/in", [("a", "A", day, 1), ("b", "B", day, 1)])
    assert run() == {"a": "A", "b": "B"}
    time.sleep(0.1)
    landing_rows(spark, base + "/in", [("a", "A", day, 1), ("b", "B", day, 1)])
    time.sleep(1.1)
    landing_rows(spark, base + "/in", [("c", "C", None, 1), ("a", "A3", day, 2)])
    assert run() == {"a": "A3", "b": "B", "c": "C"}
    status = ingest.run_status(spark, base + "/status")
    assert status.agg(F.sum("inserted")).first()[0] == 3 and status.count() == 3


def test_late_rows_are_dropped_by_the_watermark(spark):
    base = tb.shared_dir(spark, "w")

    def land(*hours):
        spark.createDataFrame([(h, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for h in hours], "k int, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(base + "/in")

    def run():
        stream = ingest.landing(spark, base + "/in", spark.read.parquet(base + "/in").schema)
        ingest.stream_to_table(ingest.windowed_counts(stream, "ts"), base + "/out", base + "/cp")
        return {r["window_start"].hour: r["articles"] for r in spark.read.parquet(base + "/out").filter("window_start < '2024-01-02'").collect()}

    land(3, 1, 2, 1, 20)
    assert run() == {1: 2, 2: 1, 3: 1}
    land(1, 23, 60)
    assert run() == {1: 2, 2: 1, 3: 1, 20: 1, 23: 1}  # the late row of hour 1 is not counted


def test_streams_do_not_depend_on_batches(spark):
    rows = [(f"k{i % 7}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)) for i, h in enumerate((3, 90, 1, 2, 1, 20, 1, 70, 3, 3, 0))]
    seen = []
    for files in (1, 5):
        base = tb.shared_dir(spark, "o")
        spark.createDataFrame(rows, "key string, ts timestamp_ntz").repartition(files, "ts").write.parquet(base + "/in")
        stream = ingest.landing(spark, base + "/in", spark.read.parquet(base + "/in").schema, files_per_batch=1)
        ingest.distinct_stream(stream, "key", base + "/keys", base + "/cp1").awaitTermination()
        ingest.count_stream(stream, "ts", [], base + "/counts", base + "/cp2").awaitTermination()
        keys = sorted(r["key"] for r in spark.read.parquet(base + "/keys").collect())
        seen.append((keys, sorted(tuple(r) for r in ingest.window_counts(spark, base + "/counts").collect())))
    assert seen[0] == seen[1] and len(seen[0][0]) == 7 and sum(n for _, n in seen[0][1]) == len(rows)


def land_in_turn(spark, path, parts, schema):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)


def test_distinct_by_date(spark):
    base, hour = tb.shared_dir(spark, "d"), dt.timedelta(hours=1)
    start, schema = dt.datetime(2024, 1, 1), "k string, ts timestamp_ntz, n int"
    parts = [[("a", start, 1), ("a", start + hour, 2), ("b", start, 3)], [("a", start + 30 * hour, 4), ("b", start + 8 * hour, 5)],
             [("c", start + 90 * hour, 6), ("a", start + 31 * hour, 7), (None, start + 89 * hour, 8)], [("a", start + 92 * hour, 9), ("c", start + 91 * hour, 9)]]

    def run():
        stream = ingest.landing(spark, base + "/in", spark.createDataFrame([], schema).schema, files_per_batch=1)
        ingest.distinct_by_date(stream, ["k"], "ts", base + "/out", base + "/cp").awaitTermination()
        return sorted((str(r["k"]), r["day"].day) for r in spark.read.parquet(base + "/out").collect())

    land_in_turn(spark, base + "/in", parts[:2], schema)
    assert run() == [("a", 1), ("a", 2), ("b", 1)]
    land_in_turn(spark, base + "/in", parts[2:], schema)
    assert run() == [("None", 4), ("a", 1), ("a", 2), ("a", 4), ("b", 1), ("c", 4)]


def test_late_rows_are_kept_apart_and_counted(spark):
    base, hour = tb.shared_dir(spark, "l"), dt.timedelta(hours=1)
    start, schema = dt.datetime(2024, 1, 1), "k int, ts timestamp_ntz"
    parts = [[(1, start), (2, start + 30 * hour)], [(3, start + 7 * hour), (4, start + 5 * hour), (5, None)], [(6, start + 60 * hour), (7, start + 36 * hour)]]
    land_in_turn(spark, base + "/in", parts, schema)
    stream = ingest.landing(spark, base + "/in", spark.createDataFrame([], schema).schema, files_per_batch=1)
    ingest.fresh_stream(stream, "ts", base + "/kept", base + "/late", base + "/status", base + "/cp").awaitTermination()
    kept, late = ({r["k"] for r in spark.read.parquet(base + part).collect()} for part in ("/kept", "/late"))
    assert (kept, late) == ({2, 3, 6, 7}, {1, 4, 5})
    status = ingest.run_status(spark, base + "/status").orderBy("batch_id").collect()
    assert [(r["landed"], r["kept"], r["late"]) for r in status] == [(2, 1, 1), (3, 1, 2), (2, 2, 0)]
    assert status[1]["newest"] == start + 30 * hour


def test_feed_limits_and_unknown_feeds(spark):
    items = "".join(f"<item><title>t{i}</title><link>u{i}</link><description>{'d' * 500}</description></item>" for i in range(40))
    feeds = spark.createDataFrame([("known", f"<rss>{items}</rss>"), ("other", "<rss><item><title>x</title><link>y</link></item></rss>")], "feed string, xml string")
    catalog = spark.createDataFrame([("known", "K", "fr", "c")], "feed string, name string, language string, category string")
    assert fd.feed_items(feeds, "today").count() == 26 and fd.feed_items(feeds, "today", limit=None).count() == 41
    rows = fd.land_items(fd.feed_items(feeds, "today", limit=None), catalog, summary_limit=None).collect()
    assert len(rows) == 41 and {len(r["summary"]) for r in rows if r["source"]} == {500}
    assert [(r["url"], r["source"], r["language"]) for r in rows if not r["source"]] == [("y", None, None)]
    assert max(len(r["summary"]) for r in fd.land_items(fd.feed_items(feeds, "today"), catalog).collect()) == 400


def test_items_are_parsed_and_broken_ones_read_by_patterns(spark):
    items = [("<item><title><![CDATA[A & <b>bold</b>]]></title><media:title>not this</media:title><link>u1</link><dc:date>x</dc:date><description>one &lt;i&gt;two&lt;/i&gt; &#233;</description></item>", "A & bold", "u1", "one two é", False),
             ("<item><title>Fish & chips &eacute;</title><link>u2</link><description>a < b</description></item>", "Fish & chips é", "u2", None, True),
             ("<item xmlns:z='q' a='1'><z:x/><title lang='fr'>Attributed</title><link type='t'> u3 </link><description/></item>", "Attributed", "u3", "Attributed", False),
             ("<item><title>Nested <em>mark</em>up</title><link>u4</link><description><p>para <b>x</b></p></description></item>", "Nested markup", "u4", "para x", False)]
    feeds = spark.createDataFrame([("f", "<rss xmlns:media='m'>" + "".join(i[0] for i in items) + "</rss>")], "feed string, xml string")
    rows = fd.feed_items(feeds, "T", broken="bad").orderBy("position").collect()
    assert [(r["title"], r["url"], r["bad"]) for r in rows] == [(t, u, bad) for _, t, u, _, bad in items]
    assert all(want is None or r["summary"] == want for r, (_, _, _, want, _) in zip(rows, items))


def test_images_of_repeated_keys_and_by_tables(spark):
    rows = [(1, "", "Ana", "Real X", "", "p"), (2, "", "", "", "Real Y", "http://p/1"), (3, "", "Zed", "", "", "http://p/1"), (4, "", None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, image_url string, entity string, org_to string, org_from string, url string")
    cache = spark.createDataFrame([("player:ana", "http://c/2"), ("player:ana", "http://c/1"), ("player:ana", ""), (None, "http://n")], "key string, value string")
    shown = spark.createDataFrame([("http://p/1", "http://p/b.jpg"), ("http://p/1", "http://p/a.jpg"), ("http://p/1", None)], "url string, image_url string")
    badges = spark.createDataFrame([("real", "http://b/r", 1), ("al y", "http://b/y", 0)], "key string, value string, ord int")
    want = {1: "http://c/1", 2: "http://b/y", 3: "http://p/a.jpg", 4: ""}
    assert {r["id"]: r["best_image"] for r in resolve_images(df, "id", cache, badges, shown).collect()} == want
    want[2] = "http://b/r"
    assert {r["id"]: r["best_image"] for r in resolve_images(df, "id", cache, {"real": "http://b/r"}, shown).collect()} == want


@pytest.mark.parametrize("limit", [1])
def test_fresh(spark, limit):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 11),), (dt.datetime(2023, 12, 30),)], "ts timestamp_ntz")
    assert ingest.fresh(df, "ts", F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")).count() == limit


def test_rows_are_worked_out_once_for_all_image_lookups(spark):
    rows = spark.createDataFrame([(1, "laer", "sdeR"), (2, "enon", "")], "id int, e string, o string").select(
        "id", F.reverse("e").alias("entity"), F.reverse("o").alias("org_to"), F.lit("").alias("org_from"), F.lit("").alias("image_url"), F.lit("").alias("url"))
    cache = spark.createDataFrame([("player:real", "http://c/real")], "key string, value string")
    got = resolve_images(rows, "id", cache, {"red": "http://b/r"})
    assert {r["id"]: r["best_image"] for r in got.collect()} == {1: "http://c/real", 2: ""}
    assert "reverse(" not in got._jdf.queryExecution().optimizedPlan().toString()
