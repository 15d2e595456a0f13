import random

import pytest
from pyspark.sql import functions as F

from pressweave import fixed_values as fv
from pressweave.operators.dedup import dense_positions, first_per_group
from pressweave.operators.merge import merge_stories, order_at, place_of
from pressweave.operators.score import (article_credibility, contained_value, engagement_score, first_contained, quality_score, ranking_score,
                                        recency_score, source_score)

COLUMNS = "ord int, story_key string, entity string, org_from string, org_to string, fee_text string, nationality string, league string, " \
          "fee_numeric double, credibility double, status string, image_url string, summary string"


def random_rows(n=400):
    rng = random.Random(11)
    pick = rng.choice
    keys = [f"p{i}__a__b" for i in range(30)] + ["", "nan", None, "unknown__unknown__unknown", " P1__A__B "]
    return [(i, pick(keys), pick(["Ana", " Bob ", "Joueur Mercato", "", "nan"]), pick(["A", "Club Vendeur", "", None]), pick(["B ", "Club Cible", ""]),
             pick(["5 M€", "Non communiqué", "", "None"]), pick(["FR", "", "nan"]), pick(["L1", "", None]), pick([0.0, 1.5, None, float("nan"), 9.0]),
             pick([3.0, 4.0, None]), pick([*fv.STATUS_PRIORITY, "odd", None]), pick(["http://a/b", "/images/x", "", "nan", None]), "s" * pick([0, 50, 399, 900])) for i in range(n)]


def comparable(rows):
    return sorted(tuple("NaN" if isinstance(v, float) and v != v else repr(v) for v in r.values()) for r in rows)


# (ord, story_key, entity, org_from, org_to, fee_text, nationality, league, fee_numeric, credibility, status, image_url, summary)
GROUP = [
    (1, "p__a__b", "Joueur Mercato", "", "B", "", "", "", 0.0, 1.0, "odd", "", "short"),
    (2, "P_A_B ", "Ana", "A", "", "Non communiqué", "", "L1", 0.0, 2.0, "odd", "", "s" * 400),
    (3, "p__a__b", "Other", "Z", "C", "5 M€", "FR", "L2", 5.0, 0.5, fv.STATUS_OFFICIAL, "", ""),
    (4, "p__a__b", "", "nan", "", "", "", "", 9.0, 4.0, "odd", "http://a/b", ""),
    (5, "other__key__x", "Solo", "", "", "", "", "", None, None, None, None, "x"),
]


def test_merge_of_a_worked_group(spark):
    """Row 3 is the best (3 + 2 + 2 + 2 + 1 + 0.5 + 2 points); it has everything but an image, which row 4 has, with the higher fee and credibility."""
    rows = {r["story_key"].strip(): r for r in merge_stories(spark.createDataFrame(GROUP, COLUMNS), "ord", strict=False).collect()}
    best = rows["p__a__b"]
    assert [best[c] for c in ("ord", "entity", "org_from", "org_to", "fee_text", "nationality", "league")] == [3, "Other", "Z", "C", "5 M€", "FR", "L2"]
    assert (best["fee_numeric"], best["credibility"], best["status"], best["image_url"]) == (9.0, 4.0, fv.STATUS_OFFICIAL, "http://a/b")
    assert rows["other__key__x"]["entity"] == "Solo" and len(rows) == 2


def test_gaps_are_filled_by_the_next_best_row(spark):
    """Without row 3, row 2 leads (3 + 2 + 2 + 2 points); its missing buyer comes from row 1, the image from row 4."""
    df = spark.createDataFrame([r for r in GROUP if r[0] != 3], COLUMNS)
    best = next(r for r in merge_stories(df, "ord", strict=False).collect() if r["ord"] == 2)
    assert (best["entity"], best["org_from"], best["org_to"], best["league"]) == ("Ana", "A", "B", "L1")
    assert (best["fee_numeric"], best["credibility"], best["image_url"]) == (9.0, 4.0, "http://a/b")


def test_merge_keeps_every_group_once(spark):
    """One row per usable key, all rows without one, the columns as they were; merging again changes nothing."""
    df = spark.createDataFrame(random_rows(), COLUMNS).repartition(5)
    merged = merge_stories(df, "ord", strict=False)
    rows = [r.asDict() for r in merged.collect()]
    source = df.collect()
    valid = [r for r in source if (r["story_key"] or "").strip() not in ("", *fv.INVALID_STORY_KEYS)]
    keys = {r["story_key"].strip().lower().replace("__", "_") for r in valid}
    assert len(rows) == len(source) - len(valid) + len(keys) and merged.columns == df.columns
    assert comparable([r.asDict() for r in merge_stories(merged, "ord", strict=False).collect()]) == comparable(rows)
    top = {}
    for r in valid:
        k = r["story_key"].strip().lower().replace("__", "_")
        top[k] = max(top.get(k, 0.0), r["credibility"] or 0.0)
    got = {r["story_key"].strip().lower().replace("__", "_"): r["credibility"] or 0.0 for r in rows
           if (r["story_key"] or "").strip() not in ("", *fv.INVALID_STORY_KEYS)}
    assert got == top


def test_merge_does_not_depend_on_row_order(spark):
    rows = random_rows(150)
    a = merge_stories(spark.createDataFrame(rows, COLUMNS), "ord").collect()
    b = merge_stories(spark.createDataFrame(rows[::-1], COLUMNS).repartition(7), "ord").collect()
    assert comparable([r.asDict() for r in a]) == comparable([r.asDict() for r in b])


def test_merge_is_hashed(spark, monkeypatch):
    """Neither the aggregate nor the fetching of values sorts rows to aggregate them."""
    from pressweave.operators import merge
    plans = []
    monkeypatch.setattr(merge, "settle", lambda df, name, real=merge.settle: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df, name))
    plans.append(merge_stories(spark.createDataFrame(random_rows(50), COLUMNS), "ord")._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 3 and not any("SortAggregate" in plan for plan in plans) and "HashAggregate" in plans[1]


def test_places_are_exact_for_large_and_negative_orders(spark):
    rows = [(-5, 3.5), (7, 3.5), (2 ** 62, 3.5), (-2 ** 62, 9.25), (1, -4.0), (3, 1e9), (4, float(2 ** -20))]
    df = spark.createDataFrame(rows, "o long, q double").select("o", "q", place_of(F.col("q"), F.col("o")).alias("p"))
    got = df.select("o", "q", "p", order_at(F.col("p")).alias("back")).orderBy("p").collect()
    assert [r.o for r in got] == [o for o, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert all(r.back == r.o for r in got)


def test_a_name_of_any_length_is_looked_through(spark):
    """Only substrings as long as a key are made, piece by piece."""
    long = "é" * 99_000 + "Real Sociedad" + "x" * 1_000
    rows = [(1, long), (2, "real"), (3, "soc"), (4, ""), (5, None), (6, "zzz"), (7, "REAL SOCIEDAD"), (8, long)]
    df = spark.createDataFrame(rows, "id int, name string")
    keys = spark.createDataFrame([("Real Sociedad", "a", 2), ("Real", "b", 1), ("x" * 400, "c", 0), ("", "d", -1)], "key string, value string, ord int")
    got = {r.id: r.v for r in contained_value(df, "name", keys, "v").collect()}
    assert got == {1: "c", 2: "b", 3: None, 4: None, 5: None, 6: None, 7: "b", 8: "c"}
    both = {r.id: r.v for r in contained_value(df, "name", keys, "v", both_ways=True).collect()}
    assert both == got | {3: "a"}


@pytest.mark.parametrize("seed", [1, 2])
def test_containment_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    names = ["".join(rng.choices("abC ", k=rng.randint(0, 700))) for _ in range(40)]
    keys = ["".join(rng.choices("abc ", k=rng.randint(1, 9))) for _ in range(60)] + [names[0][:300]]
    table = spark.createDataFrame([(k, str(i), i) for i, k in enumerate(keys)], "key string, value string, ord int")
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    for both in (False, True):
        got = {r.id: r.v for r in contained_value(df, "name", table, "v", both_ways=both).collect()}
        for i, n in enumerate(names):
            low = n.lower()
            want = next((str(j) for j, k in enumerate(keys) if k and low and (k.lower() in low or both and low in k.lower())), None)
            assert got[i] == want


def test_strict_merge_keeps_unknown_entities_apart(spark):
    row = ("joueur_star__unknown__unknown", "Joueur Star", "", "", "", "", "", 0.0, 1.0, "odd", "", "")
    df = spark.createDataFrame([(1, *row), (2, *row)], COLUMNS)
    assert merge_stories(df, "ord").count() == 2 and merge_stories(df, "ord", strict=False).count() == 1


def test_quality_score(spark):
    """Points per field as worked out by hand for the rows of the group."""
    df = spark.createDataFrame(GROUP, COLUMNS)
    got = {r["ord"]: r["q"] for r in df.withColumn("q", quality_score(df)).collect()}
    official = 2.0 if "OFFICIEL" in fv.STATUS_OFFICIAL else 0.0
    want = {1: 2 + 1 + 5 / 200, 2: 3 + 2 + 2 + 2, 3: 3 + 2 + 2 + 2 + 1 + 0.5 + official, 4: 1 + 1.5 + 4, 5: 3 + 1 / 200}
    assert {k: round(v, 6) for k, v in got.items()} == {k: round(v, 6) for k, v in want.items()}


def test_source_score_and_badges(values):
    table = {"Alpha News": 5, "News": 4, "Beta": 2}
    assert values(lambda c: source_score(c, table), ["alpha news online", "NEWS", "alp", "", None, "zeta", "Bet"]) == [5, 5, 5, 3, 3, 3, 2]
    assert values(lambda c: first_contained(c, {"Real": "r", "Real Sociedad": "s"}), ["real sociedad", "x", None]) == ["r", "", ""]


def test_ranking(spark):
    df = spark.sql("""select * from values (timestamp_ntz'2024-01-10 11:30:00', 1.0), (timestamp_ntz'2024-01-10 11:00:00', 1-1/24*.5),
      (timestamp_ntz'2024-01-09 12:00:00', 0.5), (timestamp_ntz'2024-01-03 12:00:00', 0.1), (cast(null as timestamp_ntz), 0.5), (timestamp_ntz'2024-01-06 12:00:00', 0.5-72/144*.4) t(p, want)""")
    as_of = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    assert all(abs(r["got"] - float(r["want"])) < 1e-9 for r in df.select(recency_score(F.col("p"), as_of).alias("got"), "want").collect())
    e = spark.sql("select * from values (0, 5.0, 0.0), (10, 5.0, 1.0), (5, 0.0, 0.5), (20, 2.5, 0.75) t(n, r, want)")
    assert all(abs(r["got"] - float(r["want"])) < 1e-9 for r in e.select(engagement_score(F.col("n"), F.col("r")).alias("got"), "want").collect())
    one = F.lit(1.0)
    best = spark.range(1).select(ranking_score(one, one, one, F.lit(3.0), F.array(*[F.lit("k")] * 9)), article_credibility(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    assert tuple(round(x, 9) for x in best.first()) == (1.0, 0.15)


def test_keep_first_limits_before_the_shuffle(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("k"), F.lit("x").alias("v"))
    out = first_per_group(df, ["k"], ["id"], 2)
    assert sorted(r["id"] for r in out.collect()) == [0, 1, 2, 3, 4, 5]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # partial below the exchange, final above it


def test_dense_positions(spark):
    df = spark.range(0, 500, 3).select("id", (F.col("id") % 2).alias("g"))
    rows = dense_positions(df, "g", "id", "pos", block=50).collect()
    for g in (0, 1):
        mine = sorted((r["id"], r["pos"]) for r in rows if r["g"] == g)
        assert [p for _, p in mine] == list(range(len(mine)))
