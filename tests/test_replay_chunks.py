"""Keys of one chunk are folded where they lie; known actions are left out."""

from pyspark.sql import functions as F

from caseflow.operators.replay import long_keys, replay


def _step(s, a):
    return (s + a["add"]) % 5, F.when(a["add"] == 0, 1).otherwise(0)


def _run(spark, rows, start, **more):
    a = spark.createDataFrame(rows, "k string, no long, add int").join(
        spark.createDataFrame(start, "k string, s0 int"), "k", "left")
    return replay(a, "k", "no", ["add"], None, 5, _step, chunk_size=8, fan=4, **more)


def _expected(rows, start, known=()):
    state, out = dict(start), []
    for k, no, add in sorted(set(rows)):
        if (k, no) not in known:
            before = state.get(k, 0)
            state[k] = (before + add) % 5
            out.append((k, no, before, state[k], int(add == 0)))
    return sorted(out)


def _rows(df):
    return sorted((r.k, r.no, r.s_before, r.s_after, r.err) for r in df.collect())


ROWS = [(f"k{i}", n * 1000 + i, (n + i) % 3) for i in range(30) for n in range(4)]
START = [("k1", 3), ("k2", 4)]


def test_far_apart_numbers_need_no_levels(spark):
    long = long_keys(spark.createDataFrame(ROWS, "k string, no long, add int"), "k", 8)
    got = _run(spark, ROWS, START, long=long)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert _rows(got) == _expected(ROWS, START)


def test_a_long_key_beside_short_ones(spark):
    rows = ROWS + [("hot", n * 3, n % 4) for n in range(200)] + [("k1", 2001, 0)] * 2
    long = long_keys(spark.createDataFrame(rows, "k string, no long, add int"), "k", 8)
    assert [r.k for r in long.collect()] == ["hot"]
    assert _rows(_run(spark, rows, START, long=long)) == _expected(rows, START)


def test_known_actions_are_left_out(spark):
    known = [("k1", 1001), ("k2", 2), ("none", 5)]
    got = _run(spark, ROWS, START, known=spark.createDataFrame(known, "k string, no long"))
    assert _rows(got) == _expected(ROWS, START, known)
