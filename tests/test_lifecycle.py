from pyspark.sql import functions as F

from caseflow.operators import lifecycle as LC


def _cases(spark, ids):
    return spark.createDataFrame(
        [(c, "tenant-1", "intake", False, "0100000009") for c in ids],
        "id string, tenant_id string, current_stage string, billing_prepared boolean, customer_identifier string"
    ).withColumn("status", F.lit("open")).withColumn("quote_approval", F.lit("not_requested")) \
        .withColumn("quote_amount_usd", F.lit(None).cast("decimal(18,2)"))


def _ident(spark):
    return spark.createDataFrame([("0100000009", True, "cedula")],
                                 "identifier string, locally_valid boolean, identifier_type string")


def _actions(spark, rows):
    return spark.createDataFrame(rows, "case_id string, action_no int, action string, quote_amount_usd double") \
        .withColumn("quote_amount_usd", F.col("quote_amount_usd").cast("decimal(18,2)"))


JOURNEY = ["complete_intake", "validate_identity", "complete_discovery", "prepare_quote", "approve_quote",
           "complete_service", "prepare_billing", "prepare_billing", "close_case"]


def test_full_journey(spark):
    rows = [("c1", i + 1, a, 250.0 if a == "prepare_quote" else None) for i, a in enumerate(JOURNEY)]
    out = LC.replay_cases(_cases(spark, ["c1"]), _actions(spark, rows), _ident(spark)).first()
    assert out["current_stage"] == "completed" and out["status"] == "completed"
    assert out["quote_approval"] == "approved" and float(out["quote_amount_usd"]) == 250.0
    assert out["billing_prepared"] and out["rejected_actions"] == 0


def test_guards_and_reject_path(spark):
    rows = [("c2", 1, "close_case", None), ("c2", 2, "complete_intake", None), ("c2", 3, "validate_identity", None),
            ("c2", 4, "complete_discovery", None), ("c2", 5, "prepare_quote", None),
            ("c2", 6, "prepare_quote", 100.0), ("c2", 7, "reject_quote", None), ("c2", 8, "approve_quote", None)]
    log = {r["action_no"]: r for r in
           LC.transition_log(_cases(spark, ["c2"]), _actions(spark, rows), _ident(spark)).collect()}
    assert log[1]["error"] == "invalid_case_transition"
    assert log[5]["error"] == "quote_amount_required"
    assert log[7]["accepted"] and log[7]["stage_after"] == "quote"
    assert log[8]["error"] == "invalid_case_transition"
    final = LC.replay_cases(_cases(spark, ["c2"]), _actions(spark, rows), _ident(spark)).first()
    assert final["quote_approval"] == "rejected" and float(final["quote_amount_usd"]) == 100.0
    assert final["status"] == "open"


def test_close_needs_billing(spark):
    rows = [("c3", i + 1, a, 5.0 if a == "prepare_quote" else None) for i, a in enumerate(JOURNEY[:6])]
    rows.append(("c3", 7, "close_case", None))
    log = LC.transition_log(_cases(spark, ["c3"]), _actions(spark, rows), _ident(spark)) \
        .where("action_no = 7").first()
    assert log["error"] == "billing_preparation_required"


def test_chunked_replay_equals_single_chunk(spark):
    """Chunking a long history (composition of per-chunk tables) gives the
    same log as one chunk."""
    import random
    rnd = random.Random(3)
    acts = ["complete_intake", "validate_identity", "complete_discovery", "prepare_quote", "approve_quote",
            "reject_quote", "complete_service", "prepare_billing", "close_case"]
    rows = []
    for c in range(20):
        for i in range(rnd.randint(1, 60)):
            a = rnd.choice(acts)
            rows.append((f"k{c}", i, a, 1.0 if a == "prepare_quote" and rnd.random() < 0.8 else None))
    cases, actions, ident = _cases(spark, [f"k{c}" for c in range(20)]), _actions(spark, rows), _ident(spark)
    one = LC.transition_log(cases, actions, ident, chunk_size=1_000_000).collect()
    many = LC.transition_log(cases, actions, ident, chunk_size=3).collect()
    key = lambda r: (r["case_id"], r["action_no"])
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, many), key=str)
    assert len(one) == len(rows)
    # and the plain Python fold agrees
    from caseflow.operators.lifecycle import py_case_step as case_step
    state = {}
    errs = {}
    for cid, no, a, amt in sorted(rows):
        st, bill = state.get(cid, ("intake", False))
        st, bill, e = case_step(st, bill, a, True, amt is not None)
        state[cid] = (st, bill)
        errs[(cid, no)] = e
    for r in one:
        assert (errs[key(r)] == 0) == r["accepted"]


def test_sparse_numbers_over_several_levels_and_duplicates(spark):
    """One hot key whose numbers spread over the whole 64-bit range needs every
    composition level; the result equals the plain Python fold."""
    import random

    from caseflow.operators.replay import _part, duplicate_actions, replay
    rnd = random.Random(8)
    acts = list(LC.ACTION_NO)
    numbers = sorted({rnd.randrange(1 << 63) >> rnd.randrange(0, 63) for _ in range(250)} | {0, 1, 2, 3, (1 << 63) - 1})
    rows = [("hot", n, rnd.choice(acts), rnd.random() < 0.7) for n in numbers] + [("two", 5, acts[0], True)]
    twice = [("two", 9, acts[1], True), ("two", 9, acts[2], True)]
    df = spark.createDataFrame(rows + twice, "k string, n bigint, action string, has_amount boolean").withColumns(
        {"code": LC._index(F.col("action"), list(LC.ACTION_NO)), "id_ok": F.lit(True)})
    start = spark.createDataFrame([("hot", 0), ("two", 0)], "k string, s0 int")
    got = {(r.k, r.n): (r.s_before, r.s_after, r.err) for r in
           replay(df, "k", "n", ["code", "id_ok", "has_amount"], start, 16, LC.case_step, chunk_size=4, fan=4096).collect()}
    state, want = {}, {}
    for k, n, action, amount in sorted(rows):
        st, bill = state.get(k, ("intake", False))
        before = LC.STAGE_NO[st] * 2 + bill
        st, bill, e = LC.py_case_step(st, bill, action, True, amount)
        state[k] = (st, bill)
        want[(k, n)] = (before, LC.STAGE_NO[st] * 2 + bill, e)
    assert got == want
    assert duplicate_actions(df, "k", "n").count() == 2
    parts = spark.range(1).select(_part(F.lit((1 << 63) - 1), 7).alias("a"), _part(F.lit(-1), 7).alias("b")).first()
    assert (parts.a, parts.b) == (((1 << 63) - 1) // 7, -1)


def test_workflow_replay(spark):
    state = spark.createDataFrame(
        [("ct1", "tenant-1", "iapro", "new", "not_requested", "none", ""),
         ("ct2", "tenant-1", "iapro", "new", "not_requested", "none", "")],
        "contact_id string, tenant_id string, playbook string, status string, approval_status string, "
        "billing_status string, draft_reply string").withColumn("analysis", F.lit(None).cast("struct<x:int>"))
    acts = spark.createDataFrame(
        [("ct1", 1, "analyze", None), ("ct1", 2, "draft", "Nuevo borrador"), ("ct1", 3, "approve", None),
         ("ct1", 4, "billing_review", None), ("ct2", 1, "billing_review", None), ("ct2", 2, "approve", None),
         ("ct2", 3, "analyze", None), ("ct2", 4, "draft", " ok ")],
        "contact_id string, action_no int, action string, draft_reply string")
    log, final = LC.replay_workflows(state, acts)
    f = {r["contact_id"]: r for r in final.collect()}
    assert f["ct1"]["status"] == "billing_review" and f["ct1"]["billing_status"] == "ready_for_review"
    assert f["ct1"]["draft_reply"] == "Nuevo borrador"
    errs = {(r["contact_id"], r["action_no"]): r["error"] for r in log.collect()}
    assert errs[("ct2", 1)] == "approval_required"
    assert errs[("ct2", 2)] == "analysis_required"
    assert errs[("ct2", 4)] == "invalid_draft"
    assert f["ct2"]["status"] == "awaiting_approval"


def test_redelivered_action_counts_once_and_conflicts_are_quarantined(spark):
    from caseflow.operators.replay import duplicate_actions, replay
    acts = list(LC.ACTION_NO)
    rows = [("a", 1, acts[0], None), ("a", 1, acts[0], None), ("b", 1, acts[0], None), ("b", 1, acts[0], "u")]
    df = spark.createDataFrame(rows, "k string, n bigint, action string, actor string").withColumns(
        {"code": LC._index(F.col("action"), list(LC.ACTION_NO)), "id_ok": F.lit(True), "has_amount": F.lit(True)})
    start = spark.createDataFrame([("a", 0), ("b", 0)], "k string, s0 int")
    got = replay(df, "k", "n", ["code", "id_ok", "has_amount"], start, 16, LC.case_step).collect()
    assert [(r.k, r.n) for r in got] == [("a", 1)]
    assert sorted((r.k, r.occurrences) for r in duplicate_actions(df, "k", "n").collect()) == [("b", 2), ("b", 2)]
