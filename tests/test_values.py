import datetime as dt
import hashlib

from pyspark.sql import functions as F

from pressweave.functions import urls as ux
from pressweave.functions import values as vx
from pressweave.operators import catalog
from pressweave.sources.aliases import canonical_columns, first_by_alias, first_by_column


def test_dates(values):
    data = ["2026-04-26", "6/4/2026", "2026/4/6", "2026-04-26T10:00:00Z", "Tue, 02 Jan 2024 10:00:00 GMT", "2026-13-01", "", None, "x"]
    day = [dt.datetime(2026, 4, 26), dt.datetime(2026, 4, 6), dt.datetime(2026, 4, 6), dt.datetime(2026, 4, 26)]
    assert values(vx.parse_date, data) == day + [None] * 5
    assert values(lambda c: vx.parse_date(c, rfc822=True), data)[4] == dt.datetime(2024, 1, 2)


def test_numbers_and_fees(values):
    assert values(vx.parse_float, ["1.5", " 2 ", "x", "", None, "1e2", "1.0f"]) == [1.5, 2.0, 0.0, 0.0, 0.0, 100.0, 0.0]
    assert values(vx.numeric_fee, ["12,5 M€", "Free transfer 10", "prêt", "80.5", None, "abc"]) == [12.5, 0.0, 0.0, 80.5, 0.0, 0.0]
    assert values(vx.fee_text, ["pour 12,5 M€ !", "en prêt ici", "rien", "clause de 50 M€"]) == ["12,5 M€", "prêt", None, "50 M€"]


def test_keys(values):
    key = hashlib.sha1("s|t||d".encode()).hexdigest()
    assert values(lambda c: vx.external_key(F.lit("s"), c, F.lit(None), F.lit("d")), ["t"]) == [key]
    assert values(vx.title_key, ["L'Été ²: 3_x!", "كرة القدم"]) == ["lété²3_x", "كرةالقدم"]
    got = values(lambda c: vx.story_key(c, F.lit(""), F.lit("FC É")), ["Kylian M.", None])
    assert got == ["kylian_m__unknown__fc_e", "unknown__unknown__fc_e"]


def test_urls(values):
    assert values(ux.is_article_like_url, ["https://a.b/x/y/z", "https://a.b/a-b-c-d-e", "https://a.b/p/ABC123X", "https://a.b/", "https://a.b/x?y=/1/2/3", ""]) == \
        [True, True, True, False, False, False]
    assert values(ux.normalize_image_url, ["data\\images\\a.png", "images/b", "/images/c", "http://x/y", " "]) == \
        ["/images/a.png", "/images/b", "/images/c", "http://x/y", ""]
    assert values(ux.clean_image_url, ["https://upload.wikimedia.org/a/120px-b.png", "https://x/Pixel.png", "ftp://x", None]) == \
        ["https://upload.wikimedia.org/a/600px-b.png", "", "", ""]
    assert values(ux.is_wiki_image, ["https://en.wikipedia.org/x", "https://upload.wikimedia.org/y", "https://x.org/wikipedia.org"]) == [True, True, False]
    assert values(lambda c: ux.resolve_url(F.lit("https://a.b/"), c), ["/x", "y", "http://z"]) == ["https://a.b/x", "https://a.b/y", "http://z"]
    assert values(catalog.quote, ["a b/c~*é"]) == ["a%20b/c~%2A%C3%A9"]


def test_alias_resolver(spark):
    df = spark.createDataFrame([("nan", "b", "r", "")], ["TITLE", "Title.1", "resume", "summary"])
    row = df.select(first_by_alias(df.columns, ["title"]).alias("t"), first_by_alias(df.columns, ["summary", "resume"]).alias("s"),
                    first_by_column(df.columns, ["summary", "resume"]).alias("c"), first_by_alias(df.columns, ["missing"]).alias("m")).first()
    assert tuple(row) == ("b", "r", "r", "")
    both = spark.createDataFrame([("R", "S")], ["resume", "summary"])
    assert both.select(first_by_alias(both.columns, ["summary", "resume"])).first()[0] == "S"
    assert both.select(first_by_column(both.columns, ["summary", "resume"])).first()[0] == "R"
    assert canonical_columns(spark.createDataFrame([("T", "R", "nan")], ["Title ", "RESUME", "Summary"])).first()["summary"] == "R"
