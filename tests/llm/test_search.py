import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from gridspark.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    """Every document's score for every item, straight from the contract."""
    found = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in found if c), sum(sum(c.values()) for _, c in found)
    df = Counter(t for _, c in found for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in found:
            n, score = sum(c.values()), 0
            for t in terms(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * (25 + 75 * n * n_docs // n_terms)))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def run(spark, docs, items, k=10):
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    items = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((tuple(r) for r in search.ranked(docs, items, k).collect()), key=repr)


def random_docs(seed, n):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{int(rng.zipf(1.3)) % 300}"
    return [(i, " ".join(word() for _ in range(int(rng.integers(0, 40))))) for i in range(n)], word


@pytest.mark.parametrize("segment", [16, 1 << 14])
def test_against_brute_force(spark, monkeypatch, segment):
    monkeypatch.setattr(search, "SEGMENT", segment)
    docs, word = random_docs(1, 600)
    docs += [(700, docs[0][1]), (701, docs[0][1]), (5, docs[5][1])]
    items = [(i, " ".join(word() for _ in range(12))) for i in range(20)]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, items, 3) == brute(docs, items, 3)


def test_edge_cases(spark):
    docs = [(1, None), (2, ""), (3, "Ärger ÄRGER ärger x"), (None, "x y z"), (4, "x y z"), (4, "x y z"), (5, "_-?!"), (6, "q " * 50_000 + "x")]
    items = [(1, None), (2, ""), (3, "x"), (3, "x"), (None, "Y y"), (7, "ÄRGER"), (8, "nowhere")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, [], items) == [] and run(spark, docs, []) == []
    assert run(spark, [(1, "a")], [(1, "a")]) == brute([(1, "a")], [(1, "a")])


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7), (2, "c", 5, 6, 7)], "doc_id bigint, text string, item_id int, rank int, tag int")
    items = spark.createDataFrame([(1, "a", 3, 4)], "item_id bigint, text string, doc_id int, score int")
    got = search.ranked(docs, items)
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and [tuple(r)[:3] for r in got.collect()] == [(1, 1, 1)]


def test_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_BYTES", 200)
    docs, word = random_docs(2, 200)
    items = [(i, " ".join(word() for _ in range(10))) for i in range(30)]
    assert run(spark, docs, items) == brute(docs, items)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 200))
def test_limited_accumulators_lose_nothing(seed, n):
    """A segment's search against all scores, with few best documents so that accumulators stop early."""
    rng = np.random.default_rng(seed)
    size = 12
    there = rng.random((n, size)) < rng.random(size) ** 2
    tf = np.where(there, rng.integers(1, 6, (n, size)), 0)
    m = rng.integers(25, 300, n)
    owner, codes = np.nonzero(tf)
    segment = search.Segment(np.arange(n), np.zeros(n, bool), m, codes, tf[owner, codes], there.sum(1), size)
    order = np.argsort(there.sum(0))
    weights = rng.integers(0, 9000, size)
    best = search.Best(3)
    segment.search(order, weights[order], best)
    impact = (10**9 * tf) // np.maximum(1000 * tf + 8 * m[:, None], 1)
    scores = (impact * weights).sum(1)
    want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if s > 0)[:3]
    assert list(zip((-best.score).tolist(), best.doc.tolist(), strict=True)) == want


def test_accumulators_stop(spark):
    """A frequent last term makes no accumulators once the rare ones have decided."""
    n = 1000
    tf = np.zeros((n, 2), np.int64)
    tf[:20, 0], tf[:, 1] = 3, 1
    owner, codes = np.nonzero(tf)
    segment = search.Segment(np.arange(n), np.zeros(n, bool), np.full(n, 50), codes, tf[owner, codes], (tf > 0).sum(1), 2)
    asked, whole = [], segment.list
    segment.list = lambda c: asked.append(c) or whole(c)
    best = search.Best(10)
    segment.search(np.array([0, 1]), np.array([8000, 3]), best)
    assert asked == [0, 1] and len(best.score) == 10 and best.doc.max() < 20
