"""Ranked search against a plain scorer."""
import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pressweave.llm import best_position as bp

RULE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k):
    words = [(i, RULE.findall((t or "").translate(LOWER))) for i, t in docs]
    words = [(i, w) for i, w in words if w]
    n, length = len(words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in set(items):
        scored = []
        for doc, w in words:
            tf, m = Counter(w), 100 - 50 + 50 * len(w) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10 ** 9 * tf[t] // (1000 * tf[t] + 20 * m))
                        for t in set(RULE.findall((text or "").translate(LOWER))) if tf[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scored)[:k])]
    return out


def shown(rows):
    return sorted(map(repr, (tuple(r) for r in rows)))


ITEMS = "item_id long, text string, rank int, score string"
ASKED = [(1, "the CAT 42", 0, ""), (1, "the CAT 42", 0, ""), (2, "chien, é \U0001f600 word3", 0, ""), (2, "dog", 0, ""), (3, None, 0, ""),
         (4, " \n", 0, ""), (None, "mat looked", 0, ""), (5, "absent", 0, ""), (6, "one two table le la word1 other1", 0, "")]


@pytest.mark.parametrize("k", [1, 3, 50])
@pytest.mark.parametrize("block", [10, 1_000_000])
@pytest.mark.parametrize("item_bytes", [1 << 20, 20])
def test_hard_rows(spark, nasty, k, block, item_bytes):
    items = spark.createDataFrame(ASKED, ITEMS)
    got = bp.rank_documents(nasty, items, k, block_postings=block, item_bytes=item_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute([(r.doc_id, r.text) for r in nasty.collect()], [(a, b) for a, b, *_ in ASKED], k)
    assert shown(got.collect()) == shown(want)


def test_empty_tables(spark, nasty, no_docs):
    items = spark.createDataFrame(ASKED, ITEMS)
    assert bp.rank_documents(no_docs, items, 5).count() == 0
    assert bp.rank_documents(nasty, items.limit(0), 5).count() == 0


posting = st.dictionaries(st.integers(0, 40), st.integers(1, 6), max_size=30)


def lists_of(postings):
    out = []
    for one in postings:
        if one:
            order = sorted(one, key=lambda d: (-one[d], d))
            place = {d: i for i, d in enumerate(order)}
            by_doc = sorted(one)
            out.append(bp.ImpactList(np.array(order), np.array([one[d] for d in order]), np.array(by_doc), np.array([place[d] for d in by_doc])))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(posting, max_size=5), st.integers(1, 8), st.sampled_from([1, 2, 32]))
def test_search_of_a_block_is_exact(postings, k, first):
    docs, scores, _ = bp.best_positions(lists_of(postings), 41, k, first)
    total = Counter()
    for one in postings:
        total.update(one)
    assert list(zip(docs, scores)) == [(d, total[d]) for d in sorted(total, key=lambda d: (-total[d], d))[:k]]


def test_direct_access_carries_the_best_position_past_the_last_read():
    """The first documents of one list mark the top of the other; nothing below can reach them."""
    n = 10_000
    one = {d: n - d for d in range(n)}
    other = {d: n - d if d < 40 else 1 for d in range(n)}
    docs, scores, read = bp.best_positions(lists_of([one, other]), n, 10)
    assert list(docs) == list(range(10)) and read == 32
    flat = {d: 1 for d in range(n)}  # all equal: the threshold is never strictly below
    docs, _, read = bp.best_positions(lists_of([flat]), n, 10)
    assert list(docs) == list(range(10)) and read >= n
