"""Request limits in windows that open with a client's first request, against
a plain loop over each client's requests."""

import datetime as dt
import random

from caseflow.operators.rate_limit import limit_windows

EPOCH = dt.datetime(2024, 3, 30, 23, 58)


def plain(rows, limit, window_ms):
    out, start, count = [], {}, {}
    for c, t in sorted((c, t) for c, t in rows if c is not None and t is not None):
        if c not in start or t >= start[c] + window_ms:
            start[c] = t
        count[c, start[c]] = count.get((c, start[c]), 0) + 1
    for (c, s), n in count.items():
        if n > limit:
            out.append((c, s, n, n - limit))
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(c, None if t is None else EPOCH + dt.timedelta(milliseconds=t)) for c, t in rows],
                               "agent_id string, timestamp timestamp_ntz")
    return sorted((r.agent_id, round((r.window_start - EPOCH).total_seconds() * 1000), r.events, r.refused)
                  for r in limit_windows(df, **kw).collect())


def test_equals_a_loop(spark):
    rnd = random.Random(5)
    rows = []
    for c, mean in (("busy", 30), ("even", 400), ("slow", 900), ("rare", 5000)):
        t = rnd.randint(0, 3000)
        for _ in range(300):
            rows += [(c, t)] * rnd.choice([1, 1, 1, 3])
            t += int(rnd.expovariate(1 / mean)) if rnd.random() > 0.05 else rnd.choice([999, 1000, 1001, 1999, 2000, 2001, 3000])
    rows += [(None, 5), ("busy", None)]
    for limit, window in ((0, 1000), (3, 1000), (0, 370)):
        want = plain(rows, limit, window)
        assert want and run(spark, rows, limit=limit, window_ms=window) == want


def test_defaults_and_edges(spark):
    # 101 requests in the minute from the first one, cut by the full minute
    rows = [("a", 45_000 + 400 * i) for i in range(101)] + [("b", 45_000 + 400 * i) for i in range(100)]
    rows += [("c", 1), ("c", 60_000), ("c", 60_001)]
    assert run(spark, rows) == [("a", 45_000, 101, 1)]
    assert run(spark, rows[-3:], limit=0) == [("c", 1, 2, 2), ("c", 60_001, 1, 1)]
    assert run(spark, [], limit=0) == []


def test_one_client_that_never_pauses(spark):
    """Its windows form one chain: each opener is known from the one before."""
    rows = [("hot", 700 * i) for i in range(1000)]
    want = plain(rows, 1, 1500)
    assert len(want) > 300 and run(spark, rows, limit=1, window_ms=1500) == want
