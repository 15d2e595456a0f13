"""Queries of the subpackage against their SQL, and the pipeline stage by stage."""
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from check import compare, duck
from pressweave.llm import queries as q
from tests.llm.test_parity_join import grams
from tests.llm.test_tokens import BYTE, check_pieces, plain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [n for n, (_, sql) in q.QUERIES.items() if sql])
def test_query_matches_sql(spark, con, name):
    fn, sql = q.QUERIES[name]
    line, ok = compare(spark, con, name, fn, sql, SF)
    assert ok, line


def test_registry_names():
    assert {n.split("_")[0] for n in q.registry()} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "mixing", "packing"]


def firsts(rows):
    """(id, text) of the row that stays of each group: the smallest id, none last; texts without words stand alone, repeated rows count once."""
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = label[i], label[j]
                label = [min(old, new) if x in (old, new) else x for x in label]
    return [row for i, row in enumerate(rows) if label[i] == i]


@pytest.mark.parametrize("extra", [("score", 0.5), ("ambiguous", True), ("lang_pred", "mine"), ("runner_up", "mine"), ("label", 7), ("row", 7), ("set_id", 7)])
def test_stages_keep_the_values_of_clashing_columns(spark, extra):
    name, value = extra
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn(name, F.lit(value))
    for k in (0, 1):
        kept = stage(spark, docs, k)
        assert kept.columns == docs.columns and {r[name] for r in kept.select(name).distinct().collect()} == {value}


def stage(spark, docs, k):
    return corpus_pipeline.STAGES[k][1](spark, docs, SF)


@pytest.mark.parametrize("source", ["table", "nasty", "none"])
def test_stages(spark, request, source):
    docs = (spark.read.parquet(f"{SF}/documents.parquet") if source == "table"
            else request.getfixturevalue("nasty" if source == "nasty" else "no_docs"))
    kept = stage(spark, docs, 0)
    assert kept.columns == docs.columns
    with_letters = [r for r in docs.collect() if any(c.isalpha() for c in r.text or "")]
    if source != "none":
        assert len(with_letters) * 0.98 <= kept.count() <= len(with_letters)
    assert all(r.lang for r in kept.collect())

    single = stage(spark, docs, 1)
    assert single.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter((r.doc_id, r.text) for r in single.collect()) == Counter(firsts(rows))

    mixed = stage(spark, docs, 2)
    assert mixed.columns == docs.columns
    originals = defaultdict(list)
    for r in docs.collect():
        originals[r.doc_id].append(r.text or "")
    copies = mixed.collect()
    assert all(r.n_chars == len(r.text) and any(t.startswith(r.text) for t in originals[r.doc_id]) for r in copies)
    words = sum(len((t or "").split()) for _, t in rows)
    assert abs(sum(len(r.text.split()) for r in copies) - 1.5 * words) <= 0.02 * words

    ids_of = defaultdict(list)
    for r in docs.collect():
        ids_of[r.doc_id].append(np.frombuffer(plain(BYTE, r.text) + b"\0\0\0\0", "<u4"))
    packed = stage(spark, docs, 3).collect()
    assert check_pieces(packed, ids_of) == 0
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in packed)


def test_pipeline_runs(spark):
    assert q.QUERIES["pipeline"][0](spark, SF).count() > 0
