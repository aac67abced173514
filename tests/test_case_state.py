"""The streaming case replay takes actions in any order and survives restarts."""

import os
import random
import tempfile
import time

import pytest

from caseflow.operators import lifecycle as LC
from caseflow.schemas import CASE_ACTIONS
from caseflow.streaming import case_state as CS

SCHEMA = "case_id string, action_no long, action string, id_ok boolean, quote_amount_usd decimal(18,2)"
CASES = ("case_id string, current_stage string, status string, quote_approval string, quote_amount_usd decimal(18,2), "
         "billing_prepared boolean")


@pytest.fixture
def stream(spark):
    base = tempfile.mkdtemp(prefix="cf-cases-")
    src, sink, ck = (os.path.join(base, n) for n in ("in", "sink", "ck"))

    def run(rows, cases, hold="7 days", files=2):
        df = spark.createDataFrame(rows, SCHEMA)
        df.repartition(files).write.mode("append").parquet(src)
        states, late = CS.stream_cases(spark, src, df.schema, sink, ck, spark.createDataFrame(cases, CASES), hold, 1)
        return ({r.case_id: (r.current_stage, r.status, r.quote_approval, r.quote_amount_usd, r.billing_prepared,
                             r.accepted_actions, r.rejected_actions, r.last_action_no) for r in states.collect()},
                sorted((r.case_id, r.action_no) for r in late.collect()))
    return run


def _expected(actions, starts):
    out = {}
    for case in {a[0] for a in actions}:
        state = starts.get(case, ("intake", "open", "not_requested", None, False))
        state = (*state, 0, 0)
        by_no = {}
        for a in actions:
            if a[0] == case:
                by_no.setdefault(a[1], set()).add(a)
        for no in sorted(by_no):
            if len(by_no[no]) == 1:
                (_, _, action, ok, amount), = by_no[no]
                stage, status, approval, old, bill, acc, rej = state
                stage, bill, err = LC.py_case_step(stage, bill, action, ok, amount is not None)
                if err:
                    state = (stage, status, approval, old, bill, acc, rej + 1)
                    continue
                status = {"prepare_quote": "waiting_approval", "approve_quote": "active", "complete_service": "billing_review",
                          "prepare_billing": "billing_review", "close_case": "completed"}.get(action, "open")
                approval = {"prepare_quote": "pending", "approve_quote": "approved", "reject_quote": "rejected"}.get(action, approval)
                state = (stage, status, approval, amount if action == "prepare_quote" else old, bill, acc + 1, rej)
        out[case] = (*state, max(by_no))
    return out


def test_any_order_with_restarts_equals_the_sequential_fold(stream):
    from decimal import Decimal
    rng = random.Random(4)
    path = ["complete_intake", "validate_identity", "complete_discovery", "prepare_quote", "approve_quote",
            "complete_service", "prepare_billing", "close_case"]
    actions = []
    for c in range(12):
        names = path if c % 3 else [rng.choice(CASE_ACTIONS) for _ in range(12)]
        actions += [(f"c{c}", i + 1, a, rng.random() < 0.9, Decimal("12.50") if rng.random() < 0.8 else None)
                    for i, a in enumerate(names)]
    actions += [("c1", 3, "reject_quote", True, None), ("stored", 1, "approve_quote", True, None), ("stored", 2, "reject_quote", True, None)]
    starts = {"stored": ("approval", "waiting_approval", "pending", Decimal("99.00"), False), "idle": ("quote", "open", "not_requested", None, False)}
    cases = [(k, *v) for k, v in starts.items()]
    rng.shuffle(actions)
    third = len(actions) // 3
    got = None
    for i, part in enumerate((actions[:third], actions[third:2 * third] + actions[:5], actions[2 * third:])):
        got, late = stream(part, cases if i == 0 else [])
    assert got == _expected(actions, starts) and late == []


def test_quiet_cases_are_sealed_and_later_actions_reported(stream):
    first = [("a", 1, "complete_intake", True, None), ("a", 3, "complete_discovery", True, None), ("b", 1, "complete_intake", True, None)]
    stream(first, [("a", "intake", "open", "not_requested", None, False)], "0 seconds")
    for n in (5, 6):                              # other arrivals move the watermark past the quiet time
        time.sleep(1)
        stream([("z", n, "complete_intake", True, None)], [], "0 seconds", 1)
    got, late = stream([("a", 2, "validate_identity", True, None), ("a", 4, "validate_identity", True, None)], [], "0 seconds", 1)
    assert late == [("a", 2)]
    assert got["a"][0] == "discovery" and got["a"][5:] == (2, 1, 4)


def test_unknown_actions_are_rejected_as_in_the_batch_replay(stream, spark):
    """The fold is the batch replay, one native job for all cases of a delivery, not a call per case."""
    n = 400
    rows = [(f"c{i}", k + 1, a, True, None) for i in range(n)
            for k, a in enumerate(("complete_intake", "no_such_action", "validate_identity"))]
    got, late = stream(rows, [(f"c{i}", "intake", "open", "not_requested", None, False) for i in range(0, n, 2)], files=1)
    assert late == [] and len(got) == n
    assert set(got.values()) == {("discovery", "open", "not_requested", None, False, 2, 1, 3)}
