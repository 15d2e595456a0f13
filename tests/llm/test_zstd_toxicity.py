"""Toxicity: held-out accuracy, the parts of the method, and hard rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pressweave.llm import langid
from pressweave.llm import queries as q
from pressweave.llm import zstd_toxicity as z

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scored(spark):
    return q.op12_zstd_toxicity(spark, SF).persist()


def test_held_out_accuracy(spark, scored):
    labels = spark.read.parquet(f"{SF}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = scored.filter("held_out").join(labels, "doc_id").collect()
    clean, toxic = [r for r in rows if not r.toxic], [r for r in rows if r.toxic]
    assert np.mean([r.predicted for r in clean]) <= 0.01
    assert np.mean([r.predicted for r in toxic]) >= 0.65
    order = np.argsort(np.argsort([r.score for r in clean + toxic]))
    assert (order[len(clean):].sum() - len(toxic) * (len(toxic) - 1) / 2) / (len(clean) * len(toxic)) >= 0.85  # area under the curve


def test_every_document_has_a_score(spark, scored):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = scored.collect()
    assert len(rows) == docs.count() and scored.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = {r.doc_id for r in docs.filter(langid.held_out()).collect()}
    assert all(r.held_out == (r.doc_id in held) for r in rows)


def corpus(n: int, rng, insult: str | None):
    words = [f"{a}{b}{c}" for a in ("ta", "ri", "mo", "ke") for b in ("lin", "dor", "sab") for c in ("", "us", "ent", "ora")]
    out = []
    for _ in range(n):
        text = list(rng.choice(words, int(rng.integers(20, 120))))
        if insult:
            for at in rng.integers(0, len(text), 3):
                text[at] = insult + str(rng.choice(["", "head", "s"]))
        out.append(" ".join(text))
    return out


@pytest.fixture(scope="module")
def learnt(spark):
    rng = np.random.default_rng(2)
    texts = [(t, 1) for t in corpus(150, rng, "zwaxxop")] + [(t, 0) for t in corpus(400, rng, None)]
    rows = [(i, t, toxic) for i, (t, toxic) in enumerate(texts)] + [(9000, None, 1), (9001, "x", None), (None, "zwaxxop it is", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return z.train(df.select("doc_id", "text", F.lit(1).alias("toxic")), df.select("doc_id", "toxic", F.lit("").alias("text")))


def test_the_toxic_dictionary_holds_what_sets_toxic_text_apart(learnt):
    assert b"zwaxxop" in learnt.toxic and b"zwaxxop" not in learnt.ordinary
    assert learnt.slope > 0
    plain, both = learnt.compressors()
    ordinary, toxic = b" talinus modorent kesabora ridor talin mosabus ", b" talinus modorent zwaxxophead ridor talin mosabus "
    assert len(both.compress(toxic)) < len(plain.compress(toxic))
    assert abs(len(both.compress(ordinary)) - len(plain.compress(ordinary))) <= 1
    text = " ".join(corpus(1, np.random.default_rng(8), None))
    assert learnt.probability(learnt.saving(text + " zwaxxops you zwaxxop and zwaxxophead")) > 0.7 > learnt.probability(learnt.saving(text))


def test_a_late_window_counts(learnt):
    long = " ".join(corpus(40, np.random.default_rng(9), None))
    assert learnt.saving(long + " zwaxxophead and zwaxxops here") > learnt.saving(long)


def test_windows_hold_the_whole_text():
    text = "Ä b\tC " + "y" * 200 + "\nd e f g h   i"
    words = z.words_of(text)
    assert b"".join(words).decode() == "".join(text.lower().split()) and max(map(len, words)) <= z.PIECE_BYTES
    assert b"".join(z.windows_of(text)).split() == words
    assert z.windows_of(None) == z.windows_of("") == z.windows_of(" \n") == []


def test_hard_rows(spark, nasty, no_docs, learnt):
    out = z.score(nasty, learnt)
    assert sorted(out.columns) == sorted(nasty.columns) and out.count() == nasty.count()
    got = {(r.doc_id, r.text): r.score for r in out.collect()}
    assert got == {(r.doc_id, r.text): pytest.approx(learnt.probability(learnt.saving(r.text))) for r in nasty.collect()}
    assert got[3, None] == got[4, ""] == got[5, " \n\t "]
    assert z.score(no_docs, learnt).count() == 0


def test_nothing_to_learn(spark, nasty, no_docs):
    for labels in (no_docs.withColumn("toxic", F.lit(1)), nasty.withColumn("toxic", F.lit(0)), nasty.withColumn("toxic", F.lit(None).cast("int"))):
        model = z.train(nasty, labels)
        assert {r.score for r in z.score(nasty, model).collect()} == {0.0}
    few = spark.createDataFrame([(1, "a b c", 1), (2, "d e f", 0)], "doc_id long, text string, toxic int")
    assert all(0 <= r.score <= 1 for r in z.score(nasty, z.train(few, few)).collect())


def test_samples_are_bounded(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "concat_ws(' ', 'w', id, 'same words') text", "cast(id % 2 as int) toxic")
    seen = []
    original = z.recurring
    z.recurring = lambda fit: seen.append(fit.groupBy("toxic").count().collect()) or original(fit)
    try:
        z.train(docs, docs, toxic_rows=80, ordinary_rows=40)
    finally:
        z.recurring = original
    assert {r.toxic: r["count"] for r in seen[0]} == {True: 60, False: 30}
