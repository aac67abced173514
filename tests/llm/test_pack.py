import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from caseflow.llm import packing as P
from tests.conftest import SF_ORACLE, SF_SMALL


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizers_file_on_all_documents(reference):
    texts = pq.read_table(f"{SF_ORACLE}/documents.parquet", columns=["text"])["text"].to_pylist()
    for t, e in zip(texts, reference.encode_batch(texts, add_special_tokens=False), strict=True):
        assert P.token_ids(t).tolist() == e.ids


def test_ids_of_odd_texts(reference, monkeypatch):
    every = "".join(f"a{chr(c)}b 1{chr(c)} {chr(c)}{chr(c)}  " for c in range(0x3100) if not 0xD800 <= c < 0xE000)
    texts = ["", "﻿x", "a<|endoftext|>b <|endoftext|>", "it's  we'll\n\n\tx 　 y", every, "x" * 3000, " " * 500 + "a"]
    for cut in (1 << 16, 3, 50):
        monkeypatch.setattr(P, "_CUT", cut)
        for t in texts:
            assert P.token_ids(t).tolist() == reference.encode(t, add_special_tokens=False).ids


def test_piece_bounds():
    assert P.piece_bounds(1) == [(0, 1)]
    assert P.piece_bounds(1024) == [(0, 1024)]
    assert P.piece_bounds(1025) == [(0, 1), (1, 1024)]
    assert P.piece_bounds(2048) == [(0, 1024), (1024, 1024)]


def plain_best_fit(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fit = [b for b in bins if b[0] >= x]
        if fit:
            min(fit, key=lambda b: b[0])[0] -= x
        else:
            bins.append([capacity - x])
    return len(bins)


def places(counts, capacity):
    held = defaultdict(list)
    seen = defaultdict(int)
    for length, a, b, each, first, at in P.best_fit(counts, capacity):
        assert a == seen[length]
        seen[length] = b
        for r in range(a, b):
            held[first + (r - a) // each].append((at + (r - a) % each * length, length))
    assert dict(seen) == counts
    return held


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.sampled_from([40, 41, 64]))
def test_as_few_sequences_as_best_fit_decreasing(lengths, capacity):
    counts = {x: lengths.count(x) for x in set(lengths)}
    held = places(counts, capacity)
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(held) <= plain_best_fit(lengths, capacity)


def check(df, docs, capacity=1024):
    rows = df.collect()
    by_seq, got = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        got[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    want = defaultdict(list)
    for d, text in docs:
        ids = np.append(P.token_ids(text or ""), 2).astype("<u4")
        want[d] += [(k, s, n, zlib.crc32(ids[s:s + n].tobytes())) for k, (s, n) in
                    enumerate(P.piece_bounds(len(ids), capacity))]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert len(by_seq) <= plain_best_fit([n for v in want.values() for _, _, n, _ in v], capacity)
    return by_seq


def test_documents(spark):
    t = pq.read_table(f"{SF_SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    by_seq = check(P.pack(spark.read.parquet(f"{SF_SMALL}/documents.parquet")), list(zip(t["doc_id"], t["text"], strict=True)))
    total = sum(n for v in by_seq.values() for _, n in v)
    assert len(by_seq) <= 1.05 * total / 1024 + 1


def test_nulls_repeated_rows_extra_columns_and_empty_table(spark):
    rows = [(None, "some words here", 1), (1, None, 1), (2, "", 1), (2, "", 1), (3, "word " * 3000, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int")
    check(P.pack(df), [r[:2] for r in rows])
    assert P.pack(df.limit(0)).count() == 0
