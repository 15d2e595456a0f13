"""Vector searches against brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from pressweave.llm import collision, covertree, vectors
from pressweave.llm import queries as q


def brute(rows, k, nonzero=False):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all()
            and (not nonzero or any(v))]
    out = []
    for i, v in good:
        if i % 20 == 0:
            best = sorted(((-float((v * w).sum()), j) for j, w in good if j != i and len(w) == len(v)))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.fixture(scope="module")
def hard(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in range(300)]
    rows += [(300 + i, rows[20][1]) for i in range(100)]  # copies and ties
    rows += [(400, None), (401, []), (402, [None] * 6), (403, [float("nan")] * 6), (404, [float("inf")] * 6), (420, [0.0] * 6),
             (440, [1.0, 2.0]), (441, [2.0, 1.0]), (None, [1.0] * 6)]
    return rows, spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, floor int, score int")


@pytest.mark.parametrize("block", [16_384, 64])
def test_cover_tree_is_exact(spark, hard, block, monkeypatch):
    rows, df = hard
    monkeypatch.setattr(covertree, "search_in_blocks", lambda *a, **b: vectors.search_in_blocks(*a, block_rows=block, sample_rows=30, **b))
    got = sorted(tuple(r) for r in covertree.top_inner_products(df, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == brute(rows, 20)
    assert covertree.top_inner_products(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_cover_tree_prunes_and_keeps_large_whole_numbers(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((8, 16)) * 100  # far apart, so most pairs of nodes cannot matter
    data = np.concatenate([c + rng.standard_normal((700, 16)) for c in centers])
    ids, asked = np.arange(len(data)), data[::20]
    search = covertree.Search(ids, data, ids[::20], asked, np.full(len(asked), -np.inf), 5)
    compared = []
    inner = search.compare
    search.compare = lambda a, b: compared.append((a, b)) or inner(a, b)
    at, rows, scores = search.run()
    leaves = [sum(m is not None for m in t.items) for t in (search.data, search.queries)]
    assert len(compared) < leaves[0] * leaves[1]
    for i in range(0, len(asked), 9):
        want = np.sort(np.delete(asked[i] @ data.T, ids[::20][i]))[-5:]
        assert np.allclose(np.sort(scores[rows == i]), want)
    big = np.floor(rng.standard_normal((50, 4)) * 2 ** 30)
    at, rows, scores = covertree.dual_tree(np.arange(50), big, np.arange(2), big[:2], np.full(2, -np.inf), 3)
    assert set(scores[rows == 0]) == set(sorted((float(int(big[0].astype(int) @ x.astype(int))) for x in big[1:]), reverse=True)[:3])


def test_collision_counting_on_hard_rows(hard):
    rows, df = hard
    got = sorted(tuple(r) for r in collision.nearest(df, F.col("vec_id") % 20 == 0, 20).collect())
    want = brute(rows, 20, nonzero=True)
    assert {r[0] for r in got} == {r[0] for r in want} and len(got) == len(want)
    scores = {(r[0], r[2]): r[3] for r in brute(rows, 10_000, nonzero=True)}
    assert all(abs(scores[g[0], g[2]] - g[3]) < 1e-9 for g in got)
    assert [r[1] for r in got if r[0] == 0] == list(range(1, 21))
    assert collision.nearest(df.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    got = {(r.query_id, r.vec_id) for r in q.op6_collision_counting(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = {(r[0], r[2]) for r in brute([(r.vec_id, r.embedding) for r in rows], 20)}
    assert len(got & want) >= 0.95 * len(want)


def test_collision_counting_fills_every_query(spark, monkeypatch):
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    ids = [r.vec_id for r in rows.filter(vectors.finite(F.col("embedding")) & (F.col("vec_id") % 20 == 0)).collect()]
    found = q.op6_collision_counting(spark, sf).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in found} == {i: 20 for i in ids}
    copies = [(0, [1.0, 0.0, 0.0], i == 0) for i in range(400)] + [(i, [1.0, i / 100, -1.0], False) for i in range(1, 60)]
    copies = spark.createDataFrame(copies, "vec_id long, embedding array<double>, asked boolean")
    got = collision.nearest(copies, F.col("asked"), 20).collect()  # the windows see the query's own copies first
    assert len({r.vec_id for r in got}) == 20 and 0 not in {r.vec_id for r in got}
    monkeypatch.setattr(collision, "BLOCK_ROWS", 15)
    few = rows.limit(90).filter(vectors.finite(F.col("embedding")))
    n, asked = few.count(), few.filter("vec_id % 20 = 0").count()
    assert collision.nearest(few, F.col("vec_id") % 20 == 0, 20).count() == asked * min(20, n - 1)


@pytest.mark.parametrize("kind", ["normal", "unit", "clustered"])
def test_recall_of_full_blocks(kind):
    """16,384 vectors in blocks of the size that a search uses."""
    rng, k, rows = np.random.default_rng(0), 20, 16_384
    data = rng.standard_normal((rows, 64))
    if kind == "unit":
        data /= np.linalg.norm(data, axis=1)[:, None]
    if kind == "clustered":
        data += 2 * rng.standard_normal((50, 64))[rng.integers(0, 50, rows)]
    ids, asked = np.arange(rows), np.arange(0, rows, 200)
    found = [set() for _ in asked]
    for start in range(0, rows, collision.BLOCK_ROWS):
        block = slice(start, start + collision.BLOCK_ROWS)
        at, places, _ = collision.collide(ids[block], data[block], asked, data[asked], None, k)
        for a, place in zip(at, places):
            found[place].add(start + a)
    scores = data[asked] @ data.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1)[:, :k]
    assert np.mean([len(f & set(b.tolist())) for f, b in zip(found, best)]) >= 0.9 * k
