import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from caseflow.llm import shingles as S
from caseflow.llm import superminhash as M
from tests.conftest import SF_ORACLE

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text, k=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, percent, k=5):
    """Components by testing every pair that shares a shingle."""
    sets = [plain_set(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    held = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            held[x].append(i)
    pairs = {(a, b) for v in held.values() for a in v for b in v if a < b}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            up[find(a)] = find(b)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min([x for x in (least.get(r), d) if x is not None], default=None)
    return {(d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))}


def test_shingle_sets_equal_plain_python():
    texts = ["", None, "one", "A b  C\td\nE f", "a b c d e f", "ä b Ü d e a b c d e a b c d e", " x ", "é" * 3000 + " a"]
    col = pa.array(texts)
    got = []
    for _, _, data, offsets in S.chunks(col, 64):
        h, c = S.shingle_sets(data, offsets)
        got += np.split(h, np.cumsum(c)[:-1])
    want = [plain_set(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    # equal shingles, equal hashes
    assert set(got[3].tolist()) == set(got[4].tolist())


def plain_superminhash(hashes, m):
    """One element after the other with early stopping, as published."""
    out = [float("inf")] * m
    with np.errstate(over="ignore"):
        for h in hashes:
            state = S.mix(np.array([h]) ^ M._SEED)
            perm = list(range(m))
            for j in range(m):
                if j >= max(out):
                    break
                state = S.mix(state + M._STEP)
                unit = float(state[0] >> np.uint64(12)) * 2.0 ** -52
                k = j + int(S.mix(state ^ M._SEED)[0] >> np.uint64(40)) % (m - j)
                perm[j], perm[k] = perm[k], perm[j]
                out[perm[j]] = min(out[perm[j]], unit + j)
    return out


def test_superminhash_equals_the_element_wise_algorithm():
    rng = np.random.default_rng(3)
    sets = [rng.integers(1, 2**63, n, dtype=np.uint64) for n in (0, 1, 2, 7, 40, 400)]
    got = M.superminhash(np.concatenate(sets), np.array([len(s) for s in sets]), 32)
    for g, s in zip(got, sets, strict=True):
        assert g.tolist() == plain_superminhash(s, 32)


def test_signature_estimates_similarity():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(40):
        x = rng.integers(1, 2**63, 150, dtype=np.uint64)
        a, b = x[:130], x[20:]
        sig = M.superminhash(np.concatenate([a, b]), np.array([130, 130]), 128)
        errors.append((sig[0] == sig[1]).mean() - 110 / 150)
    assert abs(np.mean(errors)) < 0.02


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def result(df):
    return {(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()}


BASE = "the quick brown fox jumps over a lazy dog near our river bank while seven small birds sing their old song"


@pytest.mark.parametrize("percent", [85, 60])
def test_components_on_hand_made_rows(spark, percent):
    w = BASE.split()
    rows = [(9, BASE), (4, BASE.upper()), (7, " ".join(w[:-1])), (8, " ".join(w[1:])), (1, None), (2, ""), (3, "a b"),
            (5, "A  B"), (6, " ".join(w[:10] + ["x"] + w[10:])), (11, "a b"), (12, "\n\t ")]
    assert result(M.near_duplicates(frame(spark, rows), percent=percent)) == brute(rows, percent)


def test_variants_of_one_text_need_the_rest_round(spark):
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(120):
        t = list(base)
        for _ in range(int(rng.integers(0, 4))):
            t[int(rng.integers(0, 60))] = f"e{int(rng.integers(0, 40))}"
        rows.append((d, " ".join(t)))
    for percent in (85, 70):
        df = M.near_duplicates(frame(spark, rows), percent=percent)
        assert result(df) == brute(rows, percent)


def test_null_and_repeated_ids_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([(None, BASE, 1, "x"), (3, BASE, 2, "y"), (3, BASE, 2, "y"), (None, "q r", 1, "z"),
                                (5, None, 1, "z")], "doc_id long, text string, n_shingles int, bucket string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(df).collect()), key=str)
    n = len(BASE.split()) - 4
    assert got == sorted([(None, n, 3, False), (3, n, 3, True), (3, n, 3, True), (None, 1, None, True),
                          (5, 0, 5, True)], key=str)
    assert M.near_duplicates(frame(spark, [])).count() == 0


def test_one_id_on_different_texts_and_a_long_text(spark, monkeypatch):
    a, b, long = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 60), ("b", 60), ("l", 90_000)))
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (None, b + " y"), (8, long), (9, long + " end")]
    assert result(M.near_duplicates(frame(spark, rows))) == brute(rows, 80)
    rng = np.random.default_rng(4)
    hashes, counts = rng.integers(0, 1 << 63, 3000).astype(np.uint64), np.array([10, 0, 2900, 90])
    whole = M.superminhash(hashes, counts)
    monkeypatch.setattr(M, "ELEMENTS", 64)
    assert (M.superminhash(hashes, counts) == whole).all()


def test_documents_match_brute_force(spark):
    import pyarrow.parquet as pq
    t = pq.read_table(f"{SF_ORACLE}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    rows = list(zip(t["doc_id"], t["text"], strict=True))
    assert result(M.near_duplicates(frame(spark, rows), percent=85)) == brute(rows, 85)
