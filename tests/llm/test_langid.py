import numpy as np

from caseflow.llm import langid as L
from caseflow.llm.queries import QUERIES
from tests.conftest import SF_ORACLE


def plain_counts(text):
    low = text.lower()
    s = " "
    for c in low + " ":
        c = c if c.isalpha() else " "
        if c != " " or s[-1] != " ":
            s += c
    grams = {}
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            grams[s[i:i + n]] = grams.get(s[i:i + n], 0) + 1
    return grams


def test_counts_equal_plain_python_in_stretches(monkeypatch):
    text = "Ünder den  Linden, 12 tree-s!  " * 7 + "a"
    want = plain_counts(text)
    at, n = L.counts(text)
    assert n.sum() == sum(want.values()) and len(at) <= len(want)
    for stretch in (1, 2, 7, 50):
        monkeypatch.setattr(L, "_STRETCH", stretch)
        a, m = L.counts(text)
        assert a.tolist() == at.tolist() and m.tolist() == n.tolist()


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        y = i % 2
        at = np.array(sorted({10 + y, 20 + int(rng.integers(0, 50))}))
        rows.append((at, np.ones(len(at)), y))
    w = L.ftrl(rows, 2, l1=2.0)
    assert all(int((w[at].sum(axis=0) + w[-1]).argmax()) == y for at, _, y in rows)
    assert (w == 0).mean() > 0.99


def test_temperature_recovers_the_scale():
    rng = np.random.default_rng(2)
    z = rng.normal(size=(4000, 3))
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert abs(L.temperature(3 * z, y) - 3) < 0.3


def test_held_out_accuracy_and_whole_table(spark):
    p = QUERIES["op8_ftrl_langid"](spark, SF_ORACLE)
    d = spark.read.parquet(f"{SF_ORACLE}/documents.parquet").select("doc_id", "lang")
    rows = p.join(d, "doc_id").collect()
    assert len(rows) == d.count()
    held = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert np.mean(held) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_nulls_no_letters_empty_tables_and_extra_columns(spark):
    rows = [(1, "the cat and the dog", "en", 1), (2, "der hund und die katze", "de", 1), (3, None, "en", 1),
            (4, "123 !?", "de", 1), (5, "the dog", None, 1), (None, "und der hund", "de", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    m = L.fit(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.predict(df, m).collect()}
    assert got[3] == got[4] == ("und", 0.0)
    assert got[1][0] == "en" and got[2][0] == "de" and got[5][0] == "en"
    assert L.predict(df.limit(0), m).count() == 0
    empty = L.fit(df.limit(0))
    assert {r.lang_pred for r in L.predict(df, empty).collect()} == {"und"}


def test_languages_above_the_bound_are_an_error(spark, monkeypatch):
    import pytest
    rows = [(1, "the cat", "en"), (2, "der hund", "de"), (3, "le chat", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(L, "MAX_LANGS", 3)
    assert L.fit(df).langs == ["de", "en", "fr"]
    monkeypatch.setattr(L, "MAX_LANGS", 2)
    with pytest.raises(ValueError, match="more than 2"):
        L.fit(df)
