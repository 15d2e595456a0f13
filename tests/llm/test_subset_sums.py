"""Hard negatives against plain loops."""
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressweave.llm import subset_sums as ss

ROW = "vec_id long, embedding array<long>, label int, row int, size string, rank int, block int, id int"


def brute(rows, anchors, positives=5, negatives=3, low=50, high=95):
    good = sorted({(i, tuple(v), lab) for i, v, lab in rows if i is not None and lab is not None and v and None not in v})
    out = []
    for i, v, lab in good:
        if not anchors(i):
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in good if j != i and len(w) == len(v)]
        for p, positive, _ in sorted(x for x in scored if x[2] == lab)[:positives]:
            hard = sorted(x for x in scored if x[2] != lab and -low * p <= -100 * x[0] <= -high * p)[:negatives]
            out += [(i, positive, r + 1, j, -p, -s) for r, (s, j, _) in enumerate(hard)]
    return sorted(out)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.integers(0, 62), st.integers(0, 2 ** 32 - 1))
def test_products_are_exact(dims, bits, seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(-2 ** bits, 2 ** bits, (70, dims))
    anchors = rng.integers(-2 ** min(bits, 20), 2 ** min(bits, 20), (67, dims))
    out = np.zeros((70, 67), np.int64)
    for a, c, scores in ss.each_product(values, anchors):
        out[c:c + scores.shape[0], a:a + scores.shape[1]] = scores
    assert (out == values @ anchors.T).all()  # both wrap alike where a product does not fit 64 bits


@pytest.fixture(scope="module")
def hard(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [int(x) for x in rng.integers(-3, 9, 11)], int(rng.integers(0, 4))) for i in range(260)]
    rows += [(260 + i, rows[50][1], i % 2) for i in range(80)] + rows[40:60]  # copies, ties, repeated rows
    rows += [(100, [1] * 11, 3), (100, [2] * 11, 0), (400, None, 1), (450, [], 1), (500, [None] * 11, 1), (550, [5] * 11, None), (None, [5] * 11, 1),
             (600, [0] * 11, 2), (650, [4, 5], 1), (651, [4, 4], 1), (652, [3, 4], 2), (700, [9] * 11, 77)]
    return rows, spark.createDataFrame([(*r, 1, "s", 2, 3, 4) for r in rows], ROW)


@pytest.mark.parametrize("block, anchor", [(8192, 2048), (30, 3)])
def test_hard_rows(hard, block, anchor, monkeypatch):
    rows, df = hard
    monkeypatch.setattr(ss, "CHUNK_ROWS", 16)
    monkeypatch.setattr(ss, "TABLE_ANCHORS", 2)
    got = ss.hard_negatives(df, F.col("vec_id") % 50 == 0, block_rows=block, anchor_rows=anchor)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rows, lambda i: i % 50 == 0)
    assert want and sorted(tuple(r) for r in got.collect() if r.anchor_id != 100) == [w for w in want if w[0] != 100]


def test_empty_and_alone(spark, hard):
    _, df = hard
    assert ss.hard_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert ss.hard_negatives(df, F.lit(False)).count() == 0
    assert ss.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0
    assert ss.hard_negatives(df.filter("label = 1"), F.col("vec_id") % 50 == 0).count() == 0


def test_hot_label(spark):
    """A label of a third of the rows is cut into blocks of its own."""
    df = spark.range(3000).selectExpr("id vec_id", "array(id % 7, id % 11, 3) embedding", "if(id % 3 = 0, 0, cast(id % 500 as int)) label")
    got = ss.hard_negatives(df, F.col("vec_id") % 50 == 0, block_rows=200, anchor_rows=20)
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, lambda i: i % 50 == 0)
