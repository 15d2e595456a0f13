import random
import re

from pyspark.sql import functions as F
import pytest

from pressweave.functions.text import norm_text, norm_words
from pressweave.operators import annotate as an
from pressweave.operators import match as m
from pressweave.operators.joins import title_matches, token_overlap_join
from pressweave.operators.topic import TopicRules, flag_topic

ENTITIES = {"Jean Petit": {"org": "Reds", "nationality": "FR", "aliases": ["petit", "jp"]},
            "Ana Maria Lopez": {"org": "", "nationality": "ES", "aliases": ["lopez"]}}
ORGS = {"red": "Reds", "red team": "Reds", "blue": "Blues", "green": "Greens", "al-x": "Never"}


def test_phrases_equal_word_boundary_patterns(spark):
    rng = random.Random(3)
    words = ["red", "team", "blue", "a", "jean", "petit", "x"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, norm string")
    terms = m.org_terms(ORGS)
    got = {r["id"]: {h["term"] for h in r["h"]} for r in df.select("id", m.phrase_hits(F.col("norm"), terms).alias("h")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == {x.term for x in terms if re.search(r"\b" + re.escape(x.term) + r"\b", t)}
    joined = m.phrase_hits_join(df, "id", "norm", m.terms_table(spark, terms)).collect()
    for i, t in enumerate(texts):
        mine = {(r["term"], len(" ".join(t.split()[:r["word_position"]])) + (r["word_position"] > 0)) for r in joined if r["id"] == i}
        assert mine == {(x.term, re.search(r"\b" + re.escape(x.term) + r"\b", t).start()) for x in terms if x.term in got[i]}


def test_entity_prefers_the_longest_name_and_long_aliases(values):
    terms = m.entity_terms(ENTITIES)
    got = values(lambda c: m.best_entity(m.phrase_hits(norm_text(c), terms)), ["Petit et López", "jp seul", "JEAN PETIT", ""])
    assert got == ["Ana Maria Lopez", None, "Jean Petit", None]


def test_orgs_are_placed_at_their_longest_alias(values):
    def names(c):
        n = norm_text(c)
        return m.orgs_in_order(m.phrase_hits(n, m.org_terms(ORGS)), n)["canonical"]
    # "red" comes first in the text, but the longer alias "red team" counts, after "blue"
    assert values(names, ["red x blue x red team", "al-x", "green"]) == [["Blues", "Reds"], [], ["Greens"]]


def test_large_dictionaries_match_inline_and_as_tables(spark):
    terms = [m.Term(f"w{i}", f"c{i}", i) for i in range(6000)]
    df = spark.createDataFrame([(1, "x w5999 w17 y"), (2, "none"), (3, "")], "id int, norm string")
    for given in (terms, m.terms_table(spark, terms)):
        rows = m.with_hits(df, "norm", "hits", given, "id").collect()
        assert {r["id"]: sorted(h["canonical"] for h in r["hits"]) for r in rows} == {1: ["c17", "c5999"], 2: [], 3: []}
    with pytest.raises(ValueError):
        m.with_hits(df, "norm", "hits", m.terms_table(spark, terms))


@pytest.mark.parametrize("title,current,want", [
    ("Petit prolonge", "Reds", ("Reds", "Reds")),
    ("green prolonge", None, ("Greens", "Greens")),
    ("prolonge", None, ("", "")),
    ("blue va pagar ao greens green", None, ("Greens", "Blues")),
    ("green x blue offre a greens", None, ("Greens", "Blues")),
    ("blue green proposta do blues", None, ("Greens", "Blues")),
    ("blue green proposta do greens", None, ("Blues", "Greens")),
    ("blue green vers greens", None, ("Blues", "Greens")),
    ("blue green vers blues", None, ("Greens", "Blues")),
    ("blue green", "Blues", ("Blues", "Greens")),
    ("blue green", "Greens", ("Greens", "Blues")),
    ("blue green", None, ("Blues", "Greens")),
    ("blue", "Blues", ("Blues", "")),
    ("blue", "Reds", ("Reds", "Blues")),
    ("rejoint blue", None, ("", "Blues")),
    ("quitte blue", None, ("Blues", "")),
    ("blue", None, ("", "Blues")),
    ("rien", "Reds", ("Reds", "")),
    ("rien", None, ("", "")),
])
def test_direction(spark, title, current, want):
    df = spark.createDataFrame([(title, current)], "t string, cur string").select("*", norm_text(F.col("t")).alias("n"))
    orgs = m.orgs_in_order(m.phrase_hits(F.col("n"), m.org_terms(ORGS)), F.col("n"))
    df = df.withColumn("o", orgs)
    got = df.select(an.direction(F.col("n"), F.col("n"), F.try_element_at("o", F.lit(1)), F.try_element_at("o", F.lit(2)), F.col("cur")).alias("d")).first()["d"]
    assert tuple(got) == want


def test_annotation(spark):
    df = spark.createDataFrame([(1, "Officiel : Jean Petit signe", "red team vers blues blue pour 30 M€"), (2, "Rumeur Marc Dupont ici", "x")], "id int, title string, summary string")
    one, two = an.annotate(df, ENTITIES, ORGS).orderBy("id").collect()
    assert (one["entity"], one["org_from"], one["org_to"], one["nationality"]) == ("Jean Petit", "Reds", "Blues", "FR")
    assert (one["status"], one["sentiment"], one["fee_text"], one["fee_numeric"]) == ("OFFICIEL ✅", "Positif", "30 M€", 30.0)
    assert one["story_key"] == "jean_petit__reds__blues"
    assert two["entity"] == "Rumeur Marc" and two["status"] == "RUMEUR 📰" and two["fee_text"] == "Non communiqué"


def test_topic_filter(spark):
    rules = TopicRules(entities=m.entity_terms(ENTITIES), orgs=m.org_terms(ORGS))
    rows = [("Transfer news", "", "Bloomberg Sport", False), ("yahoo transfer", "", "", False), ("yahoo transfer", "", "X", True),
            ("صفقة اليوم news", "", "X", True), ("transfer recipe", "", "X", False), ("Petit recipe", "", "X", True), ("blue", "kitchen", "X", True),
            ("", "", "X", False), ("nothing here", "", "X", False)]
    got = flag_topic(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, title string, summary string, source string, want boolean"), rules)
    assert [(r["i"], r["on_topic"]) for r in got.orderBy("i").collect()] == [(i, r[3]) for i, r in enumerate(rows)]


def test_token_overlap_join_equals_all_pairs(spark):
    rng = random.Random(5)
    vocab = ["hot"] * 12 + [f"w{i:02d}" for i in range(25)]
    titles = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 9)))) for i in range(80)]
    cands = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    t, c = spark.createDataFrame(titles, "t int, title string"), spark.createDataFrame(cands, "c int, cand string")
    got = {(r["t"], r["c"]) for r in token_overlap_join(t, "t", "title", c, "c", "cand").collect()}

    def match(a, b):
        a, b = ({w for w in norm_words(x).split() if len(w) >= 3} for x in (a, b))
        n, shared = len(a), len(a & b)
        return bool(a and b) and (shared == n if n <= 2 else shared >= 2 if n <= 4 else shared >= max(2, n // 3))
    want = {(i, j) for i, a in titles for j, b in cands if match(a, b)}
    assert got == want and want
    pairs = spark.createDataFrame([(a, b, match(a, b)) for _, a in titles for _, b in cands[:5]], "a string, b string, m boolean")
    assert pairs.filter(title_matches(F.col("a"), F.col("b")) != F.col("m")).count() == 0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ngrams_are_filtered_before_the_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(1, "a b c d")], "id int, norm string")
        plan = plan_of(m.phrase_hits_join(df, "id", "norm", m.terms_table(spark, [m.Term("b c", "X", 0)])))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = plan[plan.index("SortMergeJoin"):]
    exchange = below.index("Exchange hashpartitioning(_gram")
    assert below.index("Filter", exchange) < below.index("Generate", exchange) and "getbit" in below[exchange:]


def test_a_saturated_filter_only_lets_more_pass(spark, monkeypatch):
    from pressweave.operators import keyfilter
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    df = spark.createDataFrame([(i, " ".join(rng.choices(words, k=12))) for i in range(100)], "id int, norm string")
    terms = [m.Term(" ".join(rng.choices(words, k=n)), f"c{i}", i) for i, n in enumerate([1] * 5 + [2] * 60 + [3] * 60 + [7, 13])]

    def hits():
        return sorted(tuple(r) for r in m.phrase_hits_join(df, "id", "norm", m.terms_table(spark, terms)).collect())
    whole = hits()
    for fn in (m.key_filter, m.may_hold):
        monkeypatch.setattr(m, fn.__name__, lambda *a, fn=fn: fn(*a, bits=7))
    assert hits() == whole and len(whole) > 50
    assert m.phrase_hits_join(df, "id", "norm", m.terms_table(spark, terms).limit(0)).count() == 0
    assert keyfilter.FILTER_BITS == 22


def pairs_of(titles, candidates):
    from pressweave import fixed_values as fv
    cut = {k: {w for w in re.findall(r"[a-z0-9]{3,}", t.lower())} - set(fv.STOP_WORDS) for k, t in (*titles, *candidates)}
    out = []
    for i, _ in titles:
        n = len(cut[i])
        need = n if n <= 2 else 2 if n <= 4 else max(2, n // 3)
        out += [(i, j, len(cut[i] & cut[j])) for j, _ in candidates if n and len(cut[i] & cut[j]) >= need]
    return sorted(out)


@pytest.mark.parametrize("salt", [10_000, 3])
def test_overlap_join_equals_all_pairs_with_frequent_tokens(spark, salt):
    rng = random.Random(8)
    words = [f"tok{i}" for i in range(30)]
    titles = [(i, " ".join(rng.sample(words, rng.randint(0, 9)))) for i in range(60)]
    candidates = [(1000 + i, " ".join([*(["tok0"] if i % 2 else []), *rng.sample(words, rng.randint(0, 14))])) for i in range(120)]
    t, c = (spark.createDataFrame(rows, "k long, text string") for rows in (titles, candidates))
    got = token_overlap_join(t.withColumnRenamed("k", "a"), "a", "text", c.withColumnRenamed("k", "b"), "b", "text", salt_rows=salt)
    assert sorted(tuple(r) for r in got.collect()) == pairs_of(titles, candidates)


def test_a_frequent_token_is_dealt_to_several_keys(spark, monkeypatch):
    from pressweave.operators import joins
    seen = {}
    monkeypatch.setattr(joins, "settle", lambda df, name, real=joins.settle: seen.setdefault(name, real(df, name)))
    c = spark.range(2000).selectExpr("id b", "concat('hottoken rare', id) text")
    t = spark.createDataFrame([(1, "hottoken"), (2, "hottoken rare7")], "a long, text string")
    got = token_overlap_join(t, "a", "text", c, "b", "text", salt_rows=100)
    assert got.count() == 2001
    assert {r["_salts"] for r in seen["title-tokens"].filter("_token = 'hottoken'").collect()} == {20}


def test_ngrams_are_never_the_broadcast_side_and_leave_a_text_once(spark):
    df = spark.createDataFrame([(1, "b a b a b"), (2, "")], "id int, norm string")
    for words, want in ((["a", "b"], [(1, "a", 1), (1, "b", 0)]), (["a", "b a", "a b a"], [(1, "a", 1), (1, "a b a", 1), (1, "b a", 0)])):
        terms = m.terms_table(spark, [m.Term(w, w, i) for i, w in enumerate(words)])
        hits = m.phrase_hits_join(df, "id", "norm", terms.unionByName(terms))
        assert sorted((r["id"], r["term"], r["word_position"]) for r in hits.collect()) == want
        assert "BroadcastHashJoin [_gram" not in plan_of(hits)


def test_texts_are_normalised_once_for_dictionaries_that_are_tables(spark):
    df = spark.createDataFrame([(1, "eulb sniof titeP", "")], "id int, t string, summary string").select("id", F.reverse("t").alias("title"), "summary")
    people = spark.createDataFrame([(0, "Jean Petit", "Reds", "FR", ["petit"])], "ord int, name string, org string, nationality string, aliases array<string>")
    orgs = spark.createDataFrame([(0, "blue", "Blues")], "ord int, alias string, canonical string")
    got = an.annotate(df, people, orgs, key="id")
    assert [r["entity"] for r in got.collect()] == ["Jean Petit"]
    assert "reverse(" not in got._jdf.queryExecution().optimizedPlan().toString()
