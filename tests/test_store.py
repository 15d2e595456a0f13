import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressweave.operators import query as qy
from pressweave.operators import store as st
from pressweave.sources import dictionaries as dc
from pressweave.sources import tables as tb
import pytest


def batch(spark, rows):
    return spark.createDataFrame(rows, "external_key string, title string, published_at timestamp_ntz, created_at int, updated_at int")


D1, D2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


def counters(df):
    return tuple(df.select("inserted", "updated", "skipped", "total").first())


def test_upsert_table(spark):
    path = tb.shared_dir(spark, "t")
    first = batch(spark, [("a", "A", D1, 1, 1), ("b", "B", D2, 1, 1), ("c", "C", None, 1, 1), ("b", "B2", D2, 1, 2), (None, "x", D1, 1, 1), ("", "y", D1, 1, 1)])
    assert counters(st.upsert_articles(spark, path, first)) == (3, 0, 2, 3)
    second = batch(spark, [("b", "new", D2, 2, 2), ("d", "D", D2, 2, 2), (None, "x", D1, 1, 1)])
    before = files(spark, path, "2024-01-01")
    assert counters(st.upsert_articles(spark, path, second, 7)) == (1, 1, 1, 4)
    read = {r["external_key"]: (r["title"], r["created_at"]) for r in st.read_articles(spark, path).collect()}
    assert read == {"a": ("A", 1), "b": ("new", 1), "c": ("C", 1), "d": ("D", 2)}
    assert files(spark, path, "2024-01-01") == before  # a date without new rows is not rewritten
    # a repeated batch gives the same table and the same counters
    now = files(spark, path, "2024-01-02")
    assert counters(st.upsert_articles(spark, path, second, 7)) == (1, 1, 1, 4) and files(spark, path, "2024-01-02") == now
    undated = batch(spark, [("c", "C2", None, 5, 5)])
    assert counters(st.upsert_articles(spark, path, undated)) == (0, 1, 0, 4)
    assert st.read_articles(spark, path).count() == 4
    assert [r["title"] for r in st.find_article(spark, path, "b", "2024-01-02").collect()] == ["new"]
    plan = st.find_article(spark, path, "b", "2024-01-02")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(published_date" in plan


def files(spark, path, day):
    rows = spark.read.parquet(path).filter(F.col("published_date") == day).select("_metadata.file_path").distinct()
    return {r[0] for r in rows.collect()}


@pytest.mark.parametrize("step", ["merged", "counters", "table", "done"])
def test_a_batch_that_stopped_anywhere_is_repeated(spark, monkeypatch, step):
    path = tb.shared_dir(spark, "t")
    st.upsert_articles(spark, path, batch(spark, [("a", "A", D1, 1, 1), ("b", "B", D2, 1, 1)]), 0)
    rows = batch(spark, [("b", "new", D2, 2, 2), ("d", "D", D2, 2, 2)])

    class Stop(Exception):
        pass

    def stop(*args, **kwargs):
        raise Stop

    with monkeypatch.context() as patch:
        if step == "merged":
            patch.setattr(st, "upsert", stop)
        elif step == "counters":
            patch.setattr(spark, "createDataFrame", stop)
        elif step == "table":
            patch.setattr(st, "by_date", stop)
        else:
            patch.setattr(spark, "range", stop)
        with pytest.raises(Stop):
            st.upsert_articles(spark, path, rows, 1)
    for _ in range(2):
        assert counters(st.upsert_articles(spark, path, rows, 1)) == (1, 1, 0, 3)
        assert {r["external_key"]: r["title"] for r in st.read_articles(spark, path).collect()} == {"a": "A", "b": "new", "d": "D"}


def test_counters_come_from_the_pass_that_writes(spark):
    """The rows are computed once: an accumulator in them sees each once."""
    path, seen = tb.shared_dir(spark, "c"), spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: seen.add(1) or x, "long")
    got = st.write_counted(spark.range(50).select(count("id").alias("id")), path, n=F.count(F.lit(1)), odd=F.count_if(F.col("id") % 2 == 1))
    assert got == {"n": 50, "odd": 25} and seen.value == 50 and spark.read.parquet(path).count() == 50


def test_upsert_does_not_depend_on_batches(spark):
    rows = [("a", "new", D1, 1, 3), ("a", "old", D1, 1, 1), ("b", "x", D1, 1, 2), ("b", "y", D1, 1, 2)]
    seen = set()
    for order in ([rows], [rows[:1], rows[1:]], [rows[1:], rows[:1]]):
        path = tb.shared_dir(spark, "t")
        for part in order:
            st.upsert_articles(spark, path, batch(spark, part))
        seen.add(tuple(sorted((r["external_key"], r["title"]) for r in st.read_articles(spark, path).collect())))
    assert len(seen) == 1 and ("a", "new") in seen.pop()


def test_narrow_batch_keeps_stored_columns(spark):
    path = tb.shared_dir(spark, "t")
    st.upsert_articles(spark, path, batch(spark, [("a", "A", D1, 1, 1), ("b", "B", D1, 1, 1)]).selectExpr("*", "title || '!' AS extra"))
    st.upsert_articles(spark, path, batch(spark, [("a", "A2", D1, 1, 2)]))
    st.upsert_articles(spark, path, batch(spark, [("z", "Z", D2, 1, 2)]).selectExpr("*", "5 AS more"))
    got = {r["external_key"]: (r["title"], r["extra"], r["more"]) for r in st.read_articles(spark, path).collect()}
    assert got == {"a": ("A2", "A!", None), "b": ("B", "B!", None), "z": ("Z", None, 5)}


def test_bootstrap_and_reload(spark):
    path = tb.shared_dir(spark, "t")
    rows = batch(spark, [("a", "A", D1, 1, 1), (None, "x", D1, 1, 1), ("", "y", D1, 1, 1)])
    assert st.import_if_empty(spark, path, rows) and not st.import_if_empty(spark, path, rows)
    assert st.read_articles(spark, path).count() == 1
    st.write_articles(batch(spark, [("z", "Z", D1, 1, 1)]), path)
    assert [r["external_key"] for r in st.read_articles(spark, path).collect()] == ["z"]


def test_source_upsert(spark):
    old = spark.createDataFrame([("s1", "", 2.0, True), ("s2", "fr", 5.0, True)], "name string, language string, credibility double, active boolean")
    items = spark.createDataFrame([(1, "s1", "", 1.0), (2, "s1", "en", 3.0), (3, "s2", "de", 4.0), (4, "s3", None, None)], "ord int, source string, language string, credibility double")
    got = {r["name"]: (r["language"], r["credibility"], r["active"]) for r in st.upsert_sources(old, st.roll_up_sources(items, "ord")).collect()}
    assert got == {"s1": ("en", 3.0, True), "s2": ("fr", 5.0, True), "s3": (None, 0.0, None)}


def test_csv_round_trip_with_mark_and_line_breaks(spark, tmp_path):
    (tmp_path / "organized_articles.csv").write_text('﻿title,resume,x\n"a ""q""\nb",r,1\n', encoding="utf-8")
    df = tb.read_preferred(spark, str(tmp_path))
    assert df.columns == ["title", "resume", "x"] and df.first()["title"] == 'a "q"\nb'
    tb.write_csv(df.select("x", "resume", "title"), str(tmp_path / "verified_articles.csv"))
    back = tb.read_preferred(spark, str(tmp_path))
    assert back.columns == ["title", "x"] and back.first()["title"] == 'a "q"\nb'
    assert tb.read_preferred(spark, str(tmp_path / "none")) is None


def test_csv_files_with_other_columns(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    (folder / "a.csv").write_text("title,source,lang\nt1,s1,fr\n")
    (folder / "b.csv").write_text("source,title,lang\ns2,t2,en\n")
    (folder / "c.csv").write_text("lang,more\nes,m\n")
    rows = {(r["title"], r["source"], r["lang"], r["more"]) for r in tb.read_csv(spark, str(folder)).collect()}
    assert rows == {("t1", "s1", "fr", None), ("t2", "s2", "en", None), (None, None, "es", "m")}


def test_schema_change_union_and_cache(spark, tmp_path):
    df = spark.createDataFrame([("k", "x")], "external_key string, extra string")
    wide = tb.add_columns(df, tb.ARTICLE, {"fee_numeric": 0.0, "status": "s"})
    assert wide.columns == [*tb.ARTICLE.names, "extra"] and wide.first()["fee_numeric"] == 0.0
    assert isinstance(wide.schema["published_at"].dataType, T.TimestampNTZType)
    assert tb.append_missing(df, spark.createDataFrame([("s",)], "seed string")).count() == 2
    (tmp_path / "cache.json").write_text('{"player:a": "u",\n "badge:b": "v"}')
    cache = tb.read_cache(spark, str(tmp_path / "cache.json"))
    grown = tb.append_cache(cache, spark.createDataFrame([("player:a", "new"), ("player:c", "w")], "key string, value string"))
    assert {tuple(r) for r in grown.collect()} == {("player:a", "u"), ("badge:b", "v"), ("player:c", "w")}


def test_old_and_new_files_are_one_table(spark):
    path = tb.shared_dir(spark, "m")
    spark.createDataFrame([("a",)], "external_key string").write.parquet(path)
    spark.createDataFrame([("b", "s", None), ("c", None, 2.0)], "external_key string, status string, fee_numeric double").write.mode("append").parquet(path)
    rows = tb.read_merged(spark, path, tb.ARTICLE, {"status": "new", "fee_numeric": 0.0, "language": "fr"})
    assert rows.columns == tb.ARTICLE.names
    assert {(r.external_key, r.status, r.fee_numeric, r.language) for r in rows.collect()} == {("a", "new", 0.0, "fr"), ("b", "s", 0.0, "fr"), ("c", "new", 2.0, "fr")}


def test_search_under_a_collation(spark):
    df = spark.createDataFrame([(1, "Élément"), (2, "ELEMENT!"), (3, "l-ment"), (4, None)], "id int, title string").select(
        "*", *[F.lit("").alias(c) for c in ("summary", "entity", "org_from", "org_to")])
    assert {r["id"] for r in df.filter(qy.article_filter(search=" éleMENT", collation="UNICODE_CI_AI")).collect()} == {1, 2}
    assert {r["id"] for r in df.filter(qy.article_filter(search="element")).collect()} == {2}
    assert df.filter(qy.article_filter(org="%", collation="UNICODE_CI_AI")).count() == 0


def test_dictionary_rows(spark):
    orgs = spark.createDataFrame([(2, "bb", "B"), (1, "aa", "A"), (3, "long", "L"), (4, " ", "x")], "ord int, alias string, canonical string")
    assert [r["term"] for r in dc.org_term_rows(orgs).orderBy("rank").collect()] == ["long", "aa", "bb"]
    people = spark.createDataFrame([(1, "Élan Vital", ["elan", "ela"]), (2, "Bo", None)], "ord int, name string, aliases array<string>")
    assert [(r["term"], r["canonical"]) for r in dc.entity_term_rows(people).orderBy("rank", "term").collect()] == [
        ("elan", "Élan Vital"), ("elan vital", "Élan Vital"), ("bo", "Bo")]


def listing(spark):
    rows = [(i, f"t{i}%" if i % 2 else f"t_{i}", "sum", "e", "A", "", "cat", "l", "s", "src", D1 if i % 3 else None, D1) for i in range(1, 10)]
    return spark.createDataFrame(rows, "id int, title string, summary string, entity string, org_from string, org_to string, category string, league string, "
                                       "status string, source string, published_at timestamp_ntz, created_at timestamp_ntz")


def test_paging(spark):
    df = listing(spark)
    assert [r["id"] for r in qy.page_of(df, 1, 4, "id").collect()] == [1, 2, 4, 5]
    assert [r["id"] for r in qy.page_of(df, 3, 4, "id").collect()] == [9]
    assert qy.page_of(df, 9, 4, "id").count() == 0
    with pytest.raises(ValueError):
        qy.page_of(df, 1, 5001, "id")
    assert "TakeOrderedAndProject" in qy.page_of(df, 2, 4, "id")._jdf.queryExecution().executedPlan().toString()


def test_filters(spark):
    df = listing(spark)
    assert df.filter(qy.article_filter(search=" T_ ")).count() == 9  # _ matches any character
    assert df.filter(qy.article_filter(category="l", status="s", source="src", org="a")).count() == 9
    assert df.filter(qy.article_filter(league="cat")).count() == 9 and df.filter(qy.article_filter(status="x")).count() == 0
    assert df.filter(qy.article_filter()).count() == 9


def test_stats_of_empty_and_odd_labels(spark):
    df = spark.createDataFrame([(None, "s", 1.0), ("", "s", 2.35), ("Autre", "t", None)], "category string, source string, credibility double")
    got = {(r["metric"], r["label"]): r["value"] for r in qy.stats(df).collect()}
    assert got[("category", "Autre")] == 3.0 and got[("source", "s")] == 2.0 and got[("total_categories", "")] == 1.0 and got[("total_sources", "")] == 2.0
    assert got[("average_credibility", "")] == 1.68
    empty = {r["metric"]: r["value"] for r in qy.stats(df.filter("1 = 0")).collect()}
    assert (empty["total_articles"] or 0) == 0 and empty["average_credibility"] == 0.0
