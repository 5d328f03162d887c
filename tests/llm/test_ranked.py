"""Dual-tree ranking against the score of every pair."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipelytics.llm import ranked


def terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", lowered)


def expected(docs, items, k=10):
    bags = [(doc, terms(text)) for doc, text in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    counted = [(doc, Counter(b), len(b)) for doc, b in bags]
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in set(items):
        scores = []
        query = terms(text)
        for doc, tf, n in counted:
            if not n:
                continue
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = 0
            for t in query:
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, r, doc, -s) for r, (s, _, doc) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(2)
    return ["".join(rng.choice("abcdeé漢0") for _ in range(rng.randint(2, 5))) for _ in range(300)]


def texts(rng, words, number, least, most):
    """Few words are frequent, most are rare."""
    pick = lambda: words[min(int(rng.paretovariate(0.7)) - 1, len(words) - 1)]
    return [rng.choice([" ", ", ", "\n"]).join(pick().title() for _ in range(rng.randint(least, most))) for _ in range(number)]


@pytest.mark.parametrize("options", [{}, {"block_bytes": 700, "seed_documents": 40}, {"seed_documents": 100, "k": 3}])
def test_against_all_pairs(spark, words, options):
    rng = random.Random(5)
    bodies = texts(rng, words, 500, 0, 60)
    docs = list(enumerate(bodies))
    docs += [(900 + i, bodies[3]) for i in range(12)] + [(3, bodies[3])] * 2 + [(None, bodies[4]), (901, None), (902, ""), (903, "-- !!")]
    items = list(enumerate(texts(rng, words, 40, 1, 12)))
    items += [(100, None), (101, ""), (102, "?"), (103, "nowhere"), (None, bodies[5]), items[0], (104, bodies[3])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).repartition(4)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("y"))
    got = sorted((tuple(r) for r in ranked.rank(frame, asked, **options).collect()), key=repr)
    assert got == expected(docs, items, options.get("k", 10))


def test_long_texts(spark, monkeypatch):
    monkeypatch.setattr(ranked, "_LONG", 1000)
    docs = [(i, "rare " * (i % 7) + "usual " * (300 * i + 1)) for i in range(60)]
    items = [(1, "rare " * 20_000 + "usual"), (2, "usual usual")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted(map(tuple, ranked.rank(frame, spark.createDataFrame(items, "item_id long, text string")).collect()), key=repr)
    assert got == expected(docs, items)


def test_sums_beyond_doubles():
    """An item that repeats a term very often is worth more than a double holds exactly."""
    [items] = ranked.item_blocks({0: {0: 9_007_199_254_741, 1: 3}, 1: {1: 5}})
    assert not items.exact
    documents = np.array([[999_999.0, 7.0], [1000.0, 1.0]])
    want = [[999_999 * 9_007_199_254_741 + 21, 35], [9_007_199_254_741_003, 5]]
    got = items.scores(documents, np.arange(2), np.arange(2))
    assert [[row[items.numbers.index(k)] for k in (0, 1)] for row in got.tolist()] == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0))):
        got = ranked.rank(d, i)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_maxima_and_edges():
    x = np.random.default_rng(0).random((11, 4))
    levels = ranked.maxima(x, 3)
    for level, nodes in enumerate(levels):
        edges = ranked.node_edges(11, level)
        for node, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
            want = x[low:high].max(axis=0) if high > low else np.zeros(4)
            assert (nodes[node] == want).all()


def test_whole_batches_are_pruned():
    """Documents on other subjects than the items' are not scored pair by pair."""
    rng = np.random.default_rng(1)
    vectors = {i: {int(t): 1000 for t in rng.choice(50, 8, replace=False) + 50 * (i % 4)} for i in range(64)}
    [items] = ranked.item_blocks(vectors)
    rows = np.repeat(np.arange(2000), 10)
    subject = np.repeat(rng.integers(0, 4, 2000), 10)
    terms_ = np.concatenate([rng.choice(50, 10, replace=False) for _ in range(2000)]) + 50 * subject
    values = rng.integers(1, 100, len(rows)) * 5000
    best = ranked.Best(5, {})
    scored = sum(
        ranked.search_block(items, best, (rows[m] - low, terms_[m], values[m]), np.arange(low, low + 500), np.zeros(500, dtype=bool))
        for low in range(0, 2000, 500)
        for m in [(rows >= low) & (rows < low + 500)]
    )
    assert scored < 0.6 * 64 * 2000
    matrix = np.zeros((2000, 200), dtype=np.int64)
    matrix[rows, terms_] = values
    for number, vector in vectors.items():
        scores = sum(matrix[:, t] * w for t, w in vector.items())
        want = sorted(zip((-scores).tolist(), range(2000)))[:5]
        assert [(s, d) for s, _, d in best.rows[number]] == want
