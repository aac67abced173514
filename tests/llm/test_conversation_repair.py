"""Conversation repair against plain dynamic programming and enumeration."""

import hashlib
import random
import re
import zlib
from itertools import product

from pyspark.sql import functions as F

from caseflow.llm import conversation_repair as R
from caseflow.llm.queries import QUERIES
from tests.conftest import SF_SMALL as SF

_SPACE = " \t\n\x0b\f\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def _damaged(rows):
    out = []
    for c, t, role, text in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if d == 0:
            continue
        text = "" if d == 1 else re.sub(r"[.!?]", "", text) if d == 2 else text
        out += [(c, t, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def _faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        end = text.rstrip(_SPACE)
        out.append("blank" if not end else "duplicate" if (role, text) in seen
                   else "truncated" if end[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def _best(rows, faults):
    """Least (cost, audit) per state, forward over the rows."""
    step = {0: "u", 1: "u", 2: "a", 3: "u"}
    to = {"s": 1, "u": 2, "a": 3}

    def insert(states):
        for _ in range(2):
            for s, (cost, audit, done) in list(states.items()):
                role = step[s]
                new = (cost + 3, audit + "I", done + ["user:" if role == "u" else "assistant:"])
                if to[role] not in states or new[:2] < states[to[role]][:2]:
                    states[to[role]] = new
        return states

    states = {0: (0, "", [])}
    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after = {}

        def offer(s, new, after=after):
            if s not in after or new[:2] < after[s][:2]:
                after[s] = new
        for s, (cost, audit, done) in insert(states).items():
            offer(s, (cost + 4, audit + "D", done))
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault else 0
            if role[:1] == step[s] or (s == 0 and role[:1] == "s"):
                offer(to[role[:1]], (cost + more, audit + "K", done + [f"{role}:{text}"]))
            name = "user" if step[s] == "u" else "assistant"
            offer(to[step[s]], (cost + 3 + more, audit + "R", done + [f"{name}:{text}"]))
        states = after
    states = insert(states)
    return min((states[s] for s in (0, 3) if s in states), key=lambda x: x[:2])


def _expected(rows, damaged=True):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in (_damaged(rows) if damaged else
                            [(c, t, *(" " if x is None else x for x in y)) for c, t, *y in rows]) if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
        faults = _faults(mine)
        cost, audit, done = _best(mine, faults)
        turns = {r[1] for r in mine if r[1] is not None}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(mine, mine[1:], strict=False)]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0,
                     *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                     hashlib.sha256("\n".join(done).encode()).hexdigest())
    return out


def _got(df):
    rows = [tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                        "repaired_sha256").collect()]
    assert len(rows) == len({r[0] for r in rows})
    return {r[0]: r[1:] for r in rows}


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _got(QUERIES["op13_auction_repair"](spark, SF)) == _expected(rows)


def _random_rows(rng, n):
    texts = ["Yes.", "no", "", " \t", None, "Why?\n", "ok!", "é.", " "]
    roles = ["system", "user", "assistant", "tool", "", None, "User"]
    weights = [2, 6, 6, 1, 1, 1, 1]
    return [(rng.choice([0, 1, 2, None]), rng.choice([None, *range(9)]), rng.choices(roles, weights)[0], rng.choice(texts))
            for _ in range(n)]


def test_odd_rows_and_pieces(spark):
    rng = random.Random(5)
    rows = _random_rows(rng, 160)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = _expected(rows, damaged=False)
    for piece in (1, 3, 7, 1024):
        assert _got(R.repair(df, piece=piece)) == want
    want = _expected(rows)
    assert _got(R.repair(R.damage(df), df)) == want


def test_extra_columns_empty_table_and_long_text(spark):
    rows = [(1, 0, "user", "x" * 300_000 + "."), (1, 1, "assistant", "y."), (2, 4, "assistant", "z")]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit(1).alias(c) for c in ("h", "ord", "piece", "r", "cost", "copy")))
    assert _got(R.repair(df)) == _expected(rows, damaged=False)
    assert R.repair(df.where("false")).count() == 0
    gone = R.repair(df.where("conv_id = 1"), df).where("conv_id = 2").first()
    assert (gone.gaps, gone.cost, gone.audit, gone.repaired_sha256) == (0, 0, "", hashlib.sha256(b"").hexdigest())


def _edits(rows, faults, state=0, free=2):
    """All edit sequences with at most ``free`` inserted turns, as (cost, initials, roles)."""
    nxt = {0: (2, "u"), 1: (2, "u"), 2: (3, "a"), 3: (2, "u")}
    if free:
        s, r = nxt[state]
        for cost, letters, roles in _edits(rows, faults, s, free - 1):
            yield cost + 3, "I" + letters, r + roles
    if not rows:
        yield 0, "", ""
        return
    for cost, letters, roles in _edits(rows[1:], faults[1:], state, free):
        yield cost + 4, "D" + letters, roles
    if faults[0] in (R.BLANK, R.DUPLICATE):
        return
    more = 3 if faults[0] == R.CUT else 0
    keep = {"s": 1, "u": 2, "a": 3}.get(rows[0])
    if keep:
        for cost, letters, roles in _edits(rows[1:], faults[1:], keep, free):
            yield cost + more, "K" + letters, rows[0] + roles
    for r, s in (("u", 2), ("a", 3)):
        for cost, letters, roles in _edits(rows[1:], faults[1:], s, free):
            yield cost + 3 + more, "R" + letters, r + roles


def test_auction_against_enumeration():
    for roles in product("suax", repeat=3):
        for faults in product(range(4), repeat=3):
            ways = [(c, w) for c, w, r in _edits(roles, faults) if re.fullmatch("(s?(ua)+)?", r)]
            codes = [R.ROLE_CODE.get(r, 0) * 4 + f for r, f in zip(roles, faults, strict=True)]
            price = R.auction(3, R.row_arcs(codes), R.END)
            letters, state = R.trace(codes, price, 0)
            assert (price[0][0], letters + "I" * (R.END[state] // 3)) == min(ways)
