import re

import pytest
from pyspark.sql import functions as F

from caseflow.llm import decontaminate as D
from caseflow.llm import host_quality as H
from caseflow.llm import line_dedup as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- line deduplication ------------------------------------------------------

def plain_lines(docs, percent, least):
    """Kept text per document by testing every pair of lines."""
    lines = [(d, i, x, frozenset(WORD.findall(x.lower()))) for d, t in docs for i, x in enumerate((t or "").split("\n"))]
    out = {}
    for d, t in docs:
        keep = []
        for i, x in enumerate((t or "").split("\n")):
            s = frozenset(WORD.findall(x.lower()))
            gone = len(s) >= least and any(
                (e, j) < (d, i) and len(u) >= least and 100 * len(s & u) >= percent * len(s | u) for e, j, _, u in lines)
            if not gone:
                keep.append(x)
        out[d] = "\n".join(keep)
    return out


@pytest.mark.parametrize(("percent", "least"), [(80, 1), (80, 5), (60, 1), (100, 3)])
def test_lines_equal_brute_force(spark, percent, least):
    import numpy as np
    rng = np.random.default_rng(percent)
    base = [[f"w{int(x)}" for x in rng.integers(0, 60, int(rng.integers(1, 25)))] for _ in range(25)]
    docs = []
    for d in range(30):
        lines = []
        for _ in range(4):
            words = list(base[int(rng.integers(0, 25))])
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(0, len(words)))] = f"w{int(rng.integers(0, 90))}"
            lines.append(" ".join(words).title() if rng.integers(0, 2) else "  ".join(words))
        docs.append((d, "\n".join(lines)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = plain_lines(docs, percent, least)
    assert {r.doc_id: r.text for r in L.dedup_lines(df, percent, least).collect()} == want
    short = L.dedup_lines(df, percent, least, count_links=False)
    assert {r.doc_id: r.text for r in short.collect()} == want


def test_line_cases(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(2, f"{a}\n{b}\nshort line", "x", 20), (1, None, "x", 0), (3, "", "y", 0), (4, f"{a.upper()}\n{b}", "y", 9),
            (None, f"{b}\n\nshort line", "z", 5), (2, f"{a}\n{b}\nshort line", "x", 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cls string, n_chars int")
    got = {(r.doc_id, r.text, r.n_removed) for r in L.dedup_lines(df).collect()}
    assert got == {(2, a, 2), (1, None, 0), (3, "", 0), (4, "", 2), (None, f"{b}\n\nshort line", 0)}
    out = L.rewrite(df)
    assert out.columns == df.columns
    assert {(r.doc_id, r.n_chars) for r in out.collect()} == {(2, len(a)), (1, 0), (3, 0), (None, 5)}
    assert L.rewrite(df.limit(0)).count() == 0


def test_chain_of_variants_without_counted_links(spark):
    """Each line matches its neighbours only, so the earliest class under a
    shared word settles some lines and the join the others."""
    words = [f"w{i}" for i in range(60)]
    docs = [(d, " ".join(words[i:i + 20])) for d, i in enumerate([8, 2, 0, 1, 9, 30, 31, 16, 12, 14, 3, 33])]
    want = plain_lines(docs, 80, 1)
    assert 0 < sum(not t for t in want.values()) < len(docs)
    got = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), count_links=False)
    assert {r.doc_id: r.text for r in got.collect()} == want


def test_variants_of_one_line_are_not_paired_all_with_all(spark, monkeypatch):
    """300 lines with up to three of 30 words replaced, in two clusters: their
    links are counted, the pairs made are far fewer."""
    import numpy as np
    rng = np.random.default_rng(11)
    docs = []
    for d in range(300):
        words = [f"{'ab'[d % 2]}{i}" for i in range(30)]
        for i in rng.integers(0, 30, int(rng.integers(0, 4))):
            words[int(i)] = f"v{int(rng.integers(0, 500))}"
        docs.append((d, " ".join(words)))
    sets = {d: frozenset(t.split()) for d, t in docs}
    classes = set(sets.values())
    want = {d: sum(s != u and 100 * len(s & u) >= 80 * len(s | u) for u in classes) for d, s in sets.items()}
    made, plain = {}, L.written

    def counted(df, name, *args):
        out = plain(df, name, *args)
        made[name] = made.get(name, 0) + out.count()
        return out
    monkeypatch.setattr(L, "written", counted)
    got = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_links for r in got} == want
    assert {r.doc_id: r.text for r in got} == plain_lines(docs, 80, 1)
    links = sum(want[next(d for d in sets if sets[d] == s)] for s in classes) // 2
    assert links > 4_000
    assert max(n for name, n in made.items()) < links / 4, made


def test_short_lines_and_lines_without_blanks(spark):
    text = "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u53bb\u516c\u56ed\nHome Contact About\n\nown"
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, text, 1, 1), (2, text.replace("own", "other"), 2, 2), (3, long, 3, 3), (4, long + " x", 4, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, n_links int")
    out = L.dedup_lines(df)
    assert sorted(out.columns) == ["doc_id", "n_lines", "n_links", "n_removed", "text"]
    assert {(r.doc_id, r.text) for r in out.collect()} == {(1, text), (2, "\nother"), (3, long), (4, "")}
    assert L.rewrite(df).columns == df.columns


def test_the_table_of_rarities_is_in_a_plan_twice_at_most(spark):
    """It is 196,608 bytes, and every plan's text, kept by the driver, spells it out."""
    lines = spark.createDataFrame([("a b",)], "line string")
    plan = lines.select(L._tokens(F.col("line"), bytes(3 * L._BUCKETS)).alias("t"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("00" * 3 * L._BUCKETS) == 2


def test_plans_do_not_hold_the_table_of_rarities(spark):
    """A subquery brings it, once, and not as a column of the rows."""
    docs = spark.createDataFrame([(1, "a b a\nb c"), (2, "b")], "doc_id long, text string")
    rarity = L._rarity(docs)
    ranks = rarity.first().ranks
    assert len(ranks) == L._SUB * L._BUCKETS and sum(r > 0 for r in ranks) == 3 and max(ranks) == 8
    df = L._ranked(L._lines(docs), rarity).select("pos", L._tokens(F.col("line"), F.col("ranks")).alias("t"))
    plan = df._jdf.queryExecution().toString()
    assert len(plan) < 20_000
    projects = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "scalar-subquery" in x]
    assert len(projects) == 1 and "transform" in projects[0]
    rare = {(r.pos, len(r.t)): [t >> 56 for t in r.t] for r in df.collect()}
    assert rare == {(0, 2): [6, 8], (1, 2): [4, 8], (0, 1): [8]}


def test_long_lines_that_share_a_rare_word_are_not_paired(spark, monkeypatch):
    """60 unlike lines of 160 to 420 words with one rare word in common: a
    parity of 64 bits cannot tell them apart, and they were paired all with all."""
    import numpy as np
    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(6000)]
    docs = [(d, " ".join(["rare", *rng.choice(common, int(rng.integers(160, 420)), replace=False)])) for d in range(60)]
    docs += [(100 + d, docs[d][1] + " added") for d in range(3)]
    docs += [(200 + d, " ".join(common)) for d in range(80)]
    made, plain = {}, L.written

    def counted(df, name, *args):
        out = plain(df, name, *args)
        made[name] = made.get(name, 0) + out.count()
        return out
    monkeypatch.setattr(L, "written", counted)
    got = L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.n_removed} == {100, 101, 102, *range(201, 280)}
    assert {r.doc_id: r.n_links for r in got if r.n_links} == {d: 1 for d in (0, 1, 2, 100, 101, 102)}
    assert made["stars"] <= 6 and made["pairs"] <= 6, made


# --- containment ------------------------------------------------------------

def plain_pairs(docs, items, t=0.8):
    def grams(text, n):
        w = WORD.findall((text or "").lower())
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}
    out = set()
    for item, text in items:
        n = min(5, len(WORD.findall((text or "").lower())))
        want = grams(text, n) if n else set()
        for d, t2 in docs:
            both = len(want & grams(t2, n))
            if want and both >= t * len(want) - 1e-9:
                out.add((d, item, len(want), both))
    return out


def test_containment_equals_brute_force(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    items = [(i, " ".join(f"v{int(x)}" for x in rng.integers(0, 400, int(rng.integers(1, 70))))) for i in range(30)]
    items += [(90, None), (91, ""), (92, "two words"), (93, items[0][1]), (None, "a b c d e f g")]
    docs = []
    for d in range(60):
        words = [f"v{int(x)}" for x in rng.integers(0, 400, int(rng.integers(0, 300)))]
        for _ in range(2):
            part = (items[int(rng.integers(0, 33))][1] or "").split()
            for _ in range(int(rng.integers(0, 3))):
                if part:
                    part[int(rng.integers(0, len(part)))] = "edit"
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = part
        docs.append((d, " ".join(words).upper() if d % 2 else "\n".join(words)))
    docs += [(100, None), (101, ""), (None, "x a b c d e f g y"), (102, "TWO words")]
    df = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id, r.n_item, r.n_common) for r in D.contaminated(df, bench).collect()}
    want = plain_pairs(docs, items)
    assert got == want and len(want) > 30
    bad = {d for d, *_ in want}
    left = D.remove_contaminated(df, bench)
    assert left.columns == df.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((d for d, _ in docs if d not in bad), key=str)
    assert D.contaminated(df.limit(0), bench).count() == D.contaminated(df, bench.limit(0)).count() == 0
    assert D.remove_contaminated(df, bench.limit(0)).count() == len(docs)
    clash = df.select("*", *(F.lit(1).alias(c) for c in ("x", "d", "key", "c0", "_d", "g")))
    left = D.remove_contaminated(clash, bench)
    assert left.columns == clash.columns and left.count() == D.remove_contaminated(df, bench).count()


# --- quality rules ---------------------------------------------------------------

def plain_features(text):
    w = WORD.findall(text or "")
    runs = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    hit = {p for i, r in enumerate(runs) if runs.count(r) > 1 for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))


def test_features_and_verdicts(spark):
    good = " ".join(f"w{i}" for i in range(40))
    texts = [None, "", " \n\t", good, "a b c d e f g h " * 4, good + "\n" + good, "é# <x>\n\n é# <x>\né# <x>", "z " * 30,
             "a b c d e f g h a b c d e f g h i"]
    rows = [(i, t, "h1", 1) for i, t in enumerate(texts)] + [(50 + i, "too short", "bad", 1) for i in range(30)]
    rows += [(99, good, "bad", 1), (100, good, None, 1), (101, good, "bad", 1), (None, good, "h2", 1), (None, good, "h2", 1)]
    rows += [(200 + i, good, "h1", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int")
    got = H.judge(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        r = by[i]
        f = plain_features(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == f
        assert r.base_failed == (f[0] < 20 or 100 * f[4] > 30 * f[0])
    assert not by[99].base_failed and not by[99].kept           # its host fails too often
    assert by[3].kept and by[100].kept and by[None].kept
    left = H.keep_good(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((r.doc_id for r in got if r.kept), key=str)
    assert H.judge(df.limit(0)).count() == H.keep_good(df.limit(0)).count() == 0
