"""The parity sketch join against brute force on word n-grams."""
import random
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pressweave.llm import parity_join as p
from pressweave.llm.components import connected_components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def grams(text):
    words = WORD.findall((text or "").encode().lower())
    n = min(5, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if n else set()


def brute(rows):
    sets = [(i, grams(t)) for i, t in rows]
    label = list(range(len(rows)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                label[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted((d, len(s), low[root(i)] if d is not None else None) for i, (d, s) in enumerate(sets) if d is not None)


def result(df):
    return sorted(tuple(r) for r in p.near_duplicates(df).collect() if r.doc_id is not None)


def test_near_copies_chains_and_shared_passages(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(4000)]
    passage = " ".join(rng.choices(words, k=60))
    rows, n = [], 0
    for size in (3, 4, 5, 6, 7, 8, 12, 25, 60, 150, 400):
        for _ in range(6):
            base = rng.choices(words, k=size)
            for copy in range(5):
                text = list(base)
                for _ in range(copy * max(1, size // 120)):
                    text[rng.randrange(size)] = rng.choice(words)
                rows.append((n * 7 % 1009, " ".join(text)))
                base = text if copy == 2 else base
                n += 1
    rows += [(2000 + i, passage + " " + " ".join(rng.choices(words, k=20 + i))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(rows)


def test_hard_rows(nasty, no_docs):
    rows = [(r.doc_id, r.text) for r in nasty.collect()]
    assert result(nasty) == brute(rows)
    assert p.near_duplicates(nasty).count() == len(rows)
    assert p.near_duplicates(no_docs).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aAbBéÉ \n\t\x0b\x1c\xa0")))
def test_shingles_count_as_words_do(text):
    assert len(p.shingles(text)) == len(grams(text))


def test_sketches_bound_the_difference_and_links_share_a_block():
    rng = np.random.default_rng(0)
    bands = p.Bands()
    for n in [*range(4, 60), 100, 333, 1000, 5000]:
        a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        for _ in range(3):
            most = int(0.2 * len(a))
            new = rng.integers(0, 2 ** 63, rng.integers(0, most // 2 + 1)).astype(np.uint64)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[: len(a) - rng.integers(0, most // 2 + 1)]], new]))
            shared = len(np.intersect1d(a, b))
            union = len(a) + len(b) - shared
            sa, sb = p.bit_sketch(a), p.bit_sketch(b)
            low = min(len(sa), len(sb))
            far = int(np.bitwise_count((p.folded(sa, low) ^ p.folded(sb, low)).view(np.uint64)).sum())
            assert far <= union - shared
            if 100 * shared >= 80 * union and union > shared:
                assert len(np.intersect1d(bands.keys(a), bands.keys(b)))


def test_components_of_chains_hubs_and_loops(spark):
    chain = [(i, i + 1) for i in range(0, 60)]
    hub = [(100, 100 + i) for i in range(1, 80)] + [(150, 90)]
    links = spark.createDataFrame([*chain, *hub, (500, 500), (None, 7), (7, 6)], "a long, b long")
    got = {r.node: r.label for r in connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 90 for i in range(80)}, 90: 90}
    assert connected_components(links.limit(0)).count() == 0


def test_copies_that_only_their_original_links(spark):
    """Copies differ from each other by too much; only the original, whose id is not the smallest, is near to all of them."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(9000)]
    base, rows = rng.choices(words, k=200), []
    for copy in range(60):
        text = list(base)
        for at in rng.sample(range(200), 3):
            text[at] = f"new{copy}x{at}"
        rows.append((copy, " ".join(text)))
    rows.append((77, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(rows)
    alone = df.filter("doc_id <> 77")
    assert result(alone) == brute(rows[:-1])


def near_copies(n, rng, changes=3, words=200):
    base, rows = [f"w{i}" for i in range(words)], []
    for copy in range(n):
        text = list(base)
        for at in rng.sample(range(words), changes):
            text[at] = f"new{copy}x{at}"
        rows.append((copy, " ".join(text)))
    return rows + [(n + 17, " ".join(base))]


@pytest.mark.parametrize("changes", [3, 4, 5])
def test_small_tiles_and_cut_buckets_give_the_same_components(spark, monkeypatch, changes):
    monkeypatch.setattr(p, "TILE_ROWS", 7)
    monkeypatch.setattr(p, "TILE_GRAMS", 7 * 196)
    monkeypatch.setattr(p, "BUCKET_PAIRS", 40)
    monkeypatch.setattr(p, "CELLS", 16)
    rows = near_copies(30, random.Random(9), changes)
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_groups_of_a_large_center_are_bounded_and_hold_every_pair_of_labels(spark):
    rows = [(1, i, 1 if i < 200 else i) for i in range(260)] + [(1000, 1000, 1000), (1000, 1001, 1001)]
    members = spark.createDataFrame(rows, "center long, set_id long, label long")
    groups = {}
    for r in p.dealt(members, F.lit(1), 20).collect():
        groups.setdefault((r.group, r.first, r.second), []).append(r)
    assert max(map(len, groups.values())) < 80
    met = set()
    for g in groups.values():
        frame = pd.DataFrame([r.asDict() for r in g])
        for mine, others in p.sides(frame):
            met |= {tuple(sorted((frame.set_id[i], frame.set_id[j]))) for i in mine for j in others if frame.label[i] != frame.label[j]}
    want = {(a, b) for a in range(260) for b in range(200, 260) if a < b and (a < 200 or a >= 200)} | {(1000, 1001)}
    assert met == want
    assert sum(len(g) for g in groups.values()) < 3 * 260 * 4  # linked members are copied for the tiles of the others alone


def frame_of(sets, labels=None):
    return pd.DataFrame({"center": 1, "set_id": range(len(sets)), "label": labels or list(range(len(sets))), "side": 2, "n": [len(s) for s in sets],
                         "sketch": [p.bit_sketch(s) for s in sets], "grams": [s.tobytes() for s in sets]})


def test_a_group_sends_a_forest_and_never_its_pairs():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2 ** 63, 200).astype(np.uint64)
    close = [np.unique(np.concatenate([base[rng.permutation(200)[:196]], rng.integers(0, 2 ** 63, 2).astype(np.uint64)])) for _ in range(120)]
    apart = [np.unique(np.concatenate([base[rng.permutation(200)[:174]], rng.integers(0, 2 ** 63, 26).astype(np.uint64)])) for _ in range(60)]
    rows = frame_of(close + apart)
    assert len(p.with_partner(rows, 80)) <= len(rows)
    links = p.spanning_links(rows, 80)
    sets = [set(s.tolist()) for s in close + apart]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    joined = p.Forest(len(sets))
    for a, b in links.itertuples(index=False):
        assert 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
        assert joined.join(a, b)  # no link closes a circle
    assert len(links) == len(sets) - len({find(i) for i in range(len(sets))})
    assert len({find(i) for i in range(len(sets))}) > 1
    assert len(p.spanning_links(frame_of(close + apart, [7] * len(sets)), 80)) == 0


def test_one_id_on_many_texts_and_links_through_rows_without_id(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(9000)]
    rows = [(5, " ".join(rng.choices(words, k=12))) for _ in range(1000)]
    base = [f"c{i}" for i in range(100)]
    near, far = list(base), list(base)
    near[0], near[1], far[-1], far[-2] = "x", "y", "z", "u"
    near2, far2 = near[2:], far[:-2]
    near2[:0], far2[len(far2):] = ["k", "l", "m", "n"], ["o", "p", "q", "r"]
    rows += [(2001, " ".join(near2)), (2002, " ".join(far2)), (None, " ".join(base)), (None, " ".join(near)), (None, " ".join(far)),
             (7, rows[0][1]), (3, "one two"), (3, "three four"), (8, "three FOUR")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, want = result(df), brute(rows)
    assert got == want
    assert {c for d, _, c in got if d in (2001, 2002)} == {2001}  # joined by rows whose id is null
    assert {c for d, _, c in got if d == 8} == {3}
    found = p.components(df).collect()
    assert len(found) == len(rows) and len({r.row for r in found}) == len(rows)
