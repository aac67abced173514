"""Ball-tree search against plain scoring in Python."""

import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from caseflow.llm import ball_tree as B

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=20):
    held = [(d, Counter(t), len(t)) for d, text in docs if (t := _terms(text))]
    n, total = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c, size in held:
            m = 75 + 25 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t in _terms(text) if t in c)
            if score > 0:
                found.append((-score, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def got(spark, docs, items, k=20):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in B.rank(d, i, k).collect()), key=repr)


def _text(rng, n):
    words = ["Àbc", "x1", "THE", "the", "of", "日本", "a-b", "don't", "é", "z"] + [f"w{int(rng.paretovariate(0.7))}" for _ in range(30)]
    return " ".join(rng.choice(words) for _ in range(n))


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    docs = [(i, _text(rng, rng.choice([0, 3, 20, 90]))) for i in range(250)]
    docs += [(None, docs[5][1]), (7, docs[7][1]), (300, None), (301, ""), (302, "...!")]
    docs += [(400 + i, docs[9][1]) for i in range(30)]                    # ties beyond k
    items = [(i, _text(rng, rng.choice([1, 5, 25]))) for i in range(30)] + [(3, None), (4, ""), (5, docs[9][1]), (None, "the w1")]
    want = brute(docs, items)
    assert got(spark, docs, items) == want
    monkeypatch.setattr(B, "ITEM_TERMS", 60)                              # several blocks of items
    assert got(spark, docs, items) == want


def test_blocks_and_empty_tables(spark):
    assert got(spark, [], [(1, "a")]) == [] and got(spark, [(1, "a b")], []) == [] and got(spark, [(1, None)], [(1, "a")]) == []
    docs = spark.createDataFrame([(1, "a b", 5), (2, "a c " * 40_000, 6), (3, "d", 7)], "doc_id long, text string, score long")
    docs = docs.select("*", *(F.lit(1).alias(c) for c in ("rank", "item_id", "item", "n", "cols", "salt")))
    items = spark.createDataFrame([(1, "b c", 5)], "item_id long, text string, score long")
    assert sorted(tuple(r) for r in B.rank(docs, items).collect()) == brute([(1, "a b"), (2, "a c " * 40_000), (3, "d")], [(1, "b c")])


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(40, 6, replace=False) + 40 * (i % 4)) for i in range(400)]
    starts = np.arange(0, 6 * 401, 6)
    vals = rng.integers(1, 10**10, 2400)
    tree = B.BallTree(starts, np.concatenate(rows), vals, 160, leaf=8)
    q = np.zeros(160, dtype=np.int64)
    q[rng.choice(40, 9, replace=False)] = 2
    bounds = tree.bounds(q[None].astype(float))[0]
    for node in range(len(tree.kids)):
        assert tree.scores(q, node).max() <= bounds[node]
    best = B.Best(5)
    best.ids = list(range(400))
    leaves = tree.search(q, bounds, best)
    exact = sorted(((int((vals[6 * i:6 * i + 6] * q[r]).sum()), -i) for i, r in enumerate(rows)), reverse=True)[:5]
    assert sorted(((s, d) for s, d, _ in best.heap), reverse=True) == exact
    assert leaves < sum(k is None for k in tree.kids) / 2
