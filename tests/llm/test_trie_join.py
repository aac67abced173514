"""Prefix-tree join against testing every pair that shares a shingle."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import trie_join as T
from caseflow.llm.queries import QUERIES
from tests.conftest import SF_ORACLE, SF_SMALL
from tests.llm.test_superminhash import brute


def _expected(rows, percent=85, k=4):
    return sorted(brute(rows, percent, k), key=repr)


def _got(df):
    return sorted({tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()}, key=repr)


@pytest.mark.parametrize("sf", [SF_SMALL, SF_ORACLE])
def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert _got(QUERIES["op11_trie_join"](spark, sf)) == _expected(rows)


def _variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(50)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [1 << 19, 300])
def test_clusters_in_whole_groups_and_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(T, "BLOCK", block)
    monkeypatch.setattr(T, "SHARED", 3)
    rng = random.Random(8)
    texts = []
    for c in range(6):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([5, 30, 90]))]
        texts += _variants(rng, base, 45, 4)
        texts += [" ".join(base) + f" tail{i} of {c} it" for i in range(10)]
    texts += ["", None, " \n", "one", "one", "ONE", "two words", "A b c d", "a b c d e"]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(3, "a b c d"), (3, texts[9]), (None, texts[11]), (None, "nowhere else at all"), (5, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = df.select("*", *(F.lit(1).alias(c) for c in ("n", "f1", "row", "cls", "part", "g")))
    for percent in (60, 85, 100):
        assert _got(T.components(df, percent=percent)) == _expected(rows, percent)


def test_one_id_on_different_texts_links_both(spark):
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z")]
    assert _got(T.components(spark.createDataFrame(rows, "doc_id long, text string"))) == [(1, 57, 1), (2, 58, 1), (3, 58, 1)]


def test_empty_table_and_very_long_text(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.components(df).count() == 0
    long = " ".join(f"w{i}" for i in range(200_000))
    rows = [(4, long), (9, long + " more"), (5, "short one")]
    got = _got(T.components(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == [(4, 199_997, 4), (5, 1, 5), (9, 199_998, 4)]


def test_trie_probe_equals_pairwise():
    rng = np.random.default_rng(2)
    sets = [np.sort(rng.choice(24, rng.integers(4, 14), replace=False)) for _ in range(120)]
    for percent in (40, 70):
        sizes = np.array([len(s) + int(rng.integers(0, 2)) for s in sets])
        trie = T.Trie(sets, sizes)
        part, mark = np.arange(len(sets)) + 1, np.zeros(24, dtype=bool)
        for q, s in enumerate(sets):
            mark[:] = False
            mark[s] = True
            found = {trie.order[i] for i in trie.probe(s, int(sizes[q]), mark, part, 0, percent)}
            both = [len(np.intersect1d(s, t)) for t in sets]
            want = {i for i, b in enumerate(both) if 100 * b >= percent * (sizes[q] + sizes[i] - b)}
            assert found == want
