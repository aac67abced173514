"""Guarded lifecycles: case replay (T1, T2, T4), permission gate (T3),
workflow replay (T5), safety checks (T6), the constant analysis (X7), next
action (X8), default workflows (X10, J1), stage progress (J9), case opening
(J10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow import schemas as K
from caseflow.functions import literals as L
from caseflow.operators.replay import long_keys, replay, row_hash
from caseflow.operators.portfolio import has_permission

STAGE_NO = {s: i for i, s in enumerate(K.CASE_STAGES)}
ACTION_NO = {a: i for i, a in enumerate(K.CASE_ACTIONS)}
# error codes of the case fold (0 = accepted)
CASE_ERRORS = ["invalid_case_transition", "identity_validation_required", "quote_amount_required",
               "billing_preparation_required", "invalid_ec_identifier"]


def _lit_array(values: list) -> Column:
    if values and isinstance(values[0], int):
        return L.int_array(values)
    return L.str_array(values)


def _index(col: Column, values: list[str]) -> Column:
    return L.index_of(col, values)


def _name(idx: Column, values: list[str]) -> Column:
    return L.pick(values, idx)


def py_case_step(stage: str, billing: bool, action: str, id_ok: bool, has_amount: bool) -> tuple[str, bool, int]:
    """The guard rule on one case in plain Python: (stage, billing, error no.).
    It generates the lookup table of the Spark fold and drives the
    streaming fold, so both paths share one definition."""
    if action == "validate_identity" and not id_ok:
        return stage, billing, 5
    frm, to = K.STAGE_GUARD[action]
    if stage != frm:
        return stage, billing, 1
    if action == "prepare_quote" and not has_amount:
        return stage, billing, 3
    if action == "close_case" and not billing:
        return stage, billing, 4
    return to, billing or action == "prepare_billing", 0


def _case_table() -> list[int]:
    """Packed (next state * 8 + error) for every (state, action, id_ok,
    has_amount); state = stage * 2 + billing_prepared."""
    out = []
    for s in range(2 * len(K.CASE_STAGES)):
        stage, bill = K.CASE_STAGES[s >> 1], bool(s & 1)
        for action in K.CASE_ACTIONS:
            for id_ok in (False, True):
                for amount in (False, True):
                    st, b, e = py_case_step(stage, bill, action, id_ok, amount)
                    out.append((STAGE_NO[st] * 2 + int(b)) * 8 + e)
    return out


CASE_TABLE = _case_table()


def case_step(s: Column, a: Column) -> tuple[Column, Column]:
    """One lookup in the packed guard table (cheap inside the fold lambda)."""
    n_act = len(K.CASE_ACTIONS)
    idx = ((s * n_act + a["code"]) * 2 + a["id_ok"].cast("int")) * 2 + a["has_amount"].cast("int")
    packed = F.coalesce(F.element_at(_lit_array(CASE_TABLE), idx + 1), s * 8 + 1)
    return F.shiftright(packed, 3), packed.bitwiseAND(F.lit(7))


def _case_inputs(cases: DataFrame, actions: DataFrame, identity: DataFrame, carry: tuple[str, ...] = (),
                 how: str = "left"):
    """Attach action codes and the case's identifier validity to each action."""
    c = cases.select(F.col("id").alias("case_id"), "customer_identifier", "current_stage", "billing_prepared")
    ok = identity.select(F.col("identifier").alias("customer_identifier"), "locally_valid",
                         "identifier_type").dropDuplicates(["customer_identifier"])
    c = c.join(ok, "customer_identifier", "left")
    s0 = _index(F.col("current_stage"), K.CASE_STAGES) * 2 + F.col("billing_prepared").cast("int")
    actions = actions.withColumn("_given", row_hash(actions))
    a = actions.join(c.select("case_id", "locally_valid", s0.alias("s0")), "case_id", how).select(
        "case_id", "action_no", "action", "quote_amount_usd", *carry,
        _index(F.col("action"), K.CASE_ACTIONS).alias("code"),
        F.coalesce(F.col("locally_valid"), F.lit(False)).alias("id_ok"),
        F.col("quote_amount_usd").isNotNull().alias("has_amount"),
        "s0", "_given",
    )
    return a, None, c


def transition_log(cases: DataFrame, actions: DataFrame, identity: DataFrame, chunk_size: int = 512,
                   carry: tuple[str, ...] = (), known: DataFrame | None = None, stored_only: bool = False) -> DataFrame:
    """One row per action: accepted or the error it met (T2).  ``carry`` names
    further columns of ``actions`` that go through the fold, ``known`` actions
    (case_id, action_no) to leave out; with ``stored_only`` actions of a case
    that is not stored are left out too."""
    a, start, _ = _case_inputs(cases, actions, identity, carry, "inner" if stored_only else "left")
    r = replay(a, "case_id", "action_no", ["action", "quote_amount_usd", "code", "id_ok", "has_amount", *carry],
               start, n_states=16, step=case_step, chunk_size=chunk_size, known=known)
    return r.select(
        "case_id", "action_no", "action", "quote_amount_usd", *carry,
        (F.col("err") == 0).alias("accepted"),
        F.when(F.col("err") > 0, _name(F.col("err") - 1, CASE_ERRORS)).alias("error"),
        _name(F.shiftright("s_before", 1), K.CASE_STAGES).alias("stage_before"),
        _name(F.shiftright("s_after", 1), K.CASE_STAGES).alias("stage_after"),
        (F.col("s_after").bitwiseAND(F.lit(1)) == 1).alias("billing_prepared"),
    )


def _last_accepted(log: DataFrame) -> DataFrame:
    """What a case's accepted actions leave behind, one row per case."""
    acc, order = F.col("accepted"), F.col("action_no")

    def last_of(value: Column, cond: Column) -> Column:
        return F.max_by(F.when(cond, value), F.when(cond, order))

    status_of = F.coalesce(
        *[F.when(F.col("action") == a, F.lit(s)) for a, s in K.STATUS_BY_ACTION.items()], F.lit("open"))
    approval_of = (F.when(F.col("action") == "prepare_quote", "pending")
                   .when(F.col("action") == "approve_quote", "approved")
                   .when(F.col("action") == "reject_quote", "rejected"))
    return log.groupBy("case_id").agg(
        last_of(F.col("stage_after"), acc).alias("_stage"),
        last_of(status_of, acc).alias("_status"),
        last_of(approval_of, acc & approval_of.isNotNull()).alias("_approval"),
        last_of(F.col("quote_amount_usd"), acc & (F.col("action") == "prepare_quote")).alias("_amount"),
        F.max(acc & F.col("billing_prepared")).alias("_billing"),
        F.max(acc & (F.col("action") == "validate_identity")).alias("_validated"),
        F.count_if(acc).alias("accepted_actions"),
        F.count_if(~acc).alias("rejected_actions"),
    )


def fold_case(judged: DataFrame) -> DataFrame:
    """``_last_accepted`` of replayed actions (``s_before``, ``s_after``, ``err``)."""
    return _last_accepted(judged.select(
        "case_id", "action_no", "action", "quote_amount_usd", (F.col("err") == 0).alias("accepted"),
        _name(F.shiftright("s_after", 1), K.CASE_STAGES).alias("stage_after"),
        (F.col("s_after").bitwiseAND(F.lit(1)) == 1).alias("billing_prepared")))


def replay_cases(cases: DataFrame, actions: DataFrame, identity: DataFrame, chunk_size: int = 512) -> DataFrame:
    """Final case state after all actions (T1).  Every field is a
    'last accepted action of some kind' aggregate over the log: partial
    aggregation, no per-case collection."""
    agg = _last_accepted(transition_log(cases, actions, identity, chunk_size))
    carry = [c for c in ("playbook", "updated_at", "outbound_allowed", "invoice_issued") if c in cases.columns]
    c = cases.select(F.col("id").alias("case_id"), "tenant_id", *carry, "current_stage", "status",
                     "quote_approval", "quote_amount_usd", "billing_prepared", "customer_identifier")
    j = c.join(agg, "case_id", "left")
    return j.select(
        "case_id", "tenant_id", *carry,
        F.coalesce("_stage", "current_stage").alias("current_stage"),
        F.coalesce("_status", "status").alias("status"),
        F.coalesce("_approval", "quote_approval").alias("quote_approval"),
        F.coalesce("_amount", "quote_amount_usd").alias("quote_amount_usd"),
        (F.col("billing_prepared") | F.coalesce("_billing", F.lit(False))).alias("billing_prepared"),
        F.coalesce("_validated", F.lit(False)).alias("identity_validated"),
        "customer_identifier",
        F.coalesce("accepted_actions", F.lit(0)).cast("bigint").alias("accepted_actions"),
        F.coalesce("rejected_actions", F.lit(0)).cast("bigint").alias("rejected_actions"),
    )


def gate_transitions(actions: DataFrame, cases: DataFrame, memberships: DataFrame) -> DataFrame:
    """Permission gate before the fold (T3): cases.manage for every action,
    quotes.approve for approve/reject, billing.prepare for prepare_billing."""
    c = cases.select(F.col("id").alias("case_id"), "tenant_id")
    m = memberships.where(F.col("status") == "active").select(
        "tenant_id", F.col("user_id").alias("actor_user_id"), "role", "permissions")
    j = actions.join(c, "case_id", "left").join(m, ["tenant_id", "actor_user_id"], "left")
    role, perms = F.col("role"), F.col("permissions")
    err = (
        F.when(role.isNull() | ~has_permission(role, perms, "cases.manage"), "case_management_forbidden")
        .when(F.col("action").isin("approve_quote", "reject_quote") & ~has_permission(role, perms, "quotes.approve"),
              "quote_approval_forbidden")
        .when((F.col("action") == "prepare_billing") & ~has_permission(role, perms, "billing.prepare"),
              "billing_preparation_forbidden")
    )
    return j.select("case_id", "action_no", "action", "actor_user_id", err.isNull().alias("permitted"),
                    err.alias("error"))


def transition_events(log: DataFrame, cases: DataFrame) -> DataFrame:
    """One audit row per accepted action (T4)."""
    c = cases.select(F.col("id").alias("case_id"), "tenant_id", "customer_id")
    a = log.where("accepted").join(c, "case_id", "left")
    act = F.col("action")
    return a.select(
        F.sha2(F.concat_ws("|", F.col("case_id"), F.col("action_no").cast("string")), 256).substr(1, 32)
        .alias("event_id"),
        "tenant_id", "case_id", "customer_id", act.alias("action"),
        F.when(act == "validate_identity", "identity_validation_completed")
        .otherwise("workflow_transition_completed").alias("event_name"),
        F.lit("human").alias("actor_type"),
        F.concat(F.col("stage_before"), F.lit(" → "), F.col("stage_after")).alias("decision"),
        F.when(act == "approve_quote", "approved").when(act == "reject_quote", "rejected")
        .when(act == "prepare_quote", "required").otherwise("not_required").alias("human_approval"),
    )


def safety_violations(cases: DataFrame, workflows: DataFrame | None = None) -> DataFrame:
    """Rows that break a safety rule (T6): must be empty."""
    c = cases.select(
        F.lit("case").alias("kind"), F.col("id"),
        F.array_compact(F.array(
            F.when(F.col("outbound_allowed"), F.lit("outbound_allowed")),
            F.when(F.col("invoice_issued"), F.lit("invoice_issued")),
            F.when((F.col("current_stage") == "completed") & ~F.col("billing_prepared"),
                   F.lit("closed_without_billing")),
        )).alias("violations"))
    out = c
    if workflows is not None:
        w = workflows.select(
            F.lit("workflow").alias("kind"), F.col("id"),
            F.array_compact(F.array(
                F.when(F.col("outbound_allowed"), F.lit("outbound_allowed")),
                F.when(F.col("invoice_issued"), F.lit("invoice_issued")),
                F.when(~F.col("synthetic"), F.lit("not_synthetic")),
            )).alias("violations"))
        out = out.unionByName(w)
    return out.where(F.size("violations") > 0).select("kind", "id", F.array_join("violations", ",")
                                                      .alias("violations"))


# --------------------------------------------------------------------------- X7 / X8 / X10 / J1


def analyze_rule(requests: DataFrame, playbook_col: str = "playbook") -> DataFrame:
    """The deterministic analysis per playbook (X7): a broadcast join with
    the two-row constant table (its size is fixed by the contract)."""
    spark = requests.sparkSession
    rows = [(pb, a["summary"], a["intent"], a["urgency"], a["service_family"], a["missing_information"],
             a["next_best_action"], a["draft_reply"], a["requires_human_approval"], a["confidence"])
            for pb, a in K.DEMO_ANALYSIS.items()]
    table = spark.createDataFrame(rows, "playbook string, summary string, intent string, urgency string, "
                                        "service_family string, missing_information array<string>, "
                                        "next_best_action string, draft_reply string, "
                                        "requires_human_approval boolean, confidence double")
    return requests.join(F.broadcast(table), requests[playbook_col] == table["playbook"], "left") \
        .drop(table["playbook"])


def next_action(cases: DataFrame) -> Column:
    """Stage -> next action; in billing it depends on billing_prepared."""
    st = F.col("current_stage")
    return (F.when(st == "intake", "complete_intake").when(st == "identity", "validate_identity")
            .when(st == "discovery", "complete_discovery").when(st == "quote", "prepare_quote")
            .when(st == "approval", "approve_quote").when(st == "service", "complete_service")
            .when(st == "billing", F.when(F.col("billing_prepared"), "close_case").otherwise("prepare_billing")))


def default_workflow(contacts: DataFrame) -> DataFrame:
    """Workflow a contact starts with when none is stored."""
    st = F.col("status")
    wf_status = (F.when(st == "approval_required", "awaiting_approval")
                 .when(st == "billing_review", "billing_review").otherwise("new"))
    has_analysis = st.isin("approval_required", "billing_review")
    from caseflow.plans.views import analysis_struct
    analysis = F.when(has_analysis, analysis_struct(F.col("playbook")))
    return contacts.select(
        F.concat(F.lit("demo-case-"), F.col("id")).alias("id"),
        F.col("id").alias("contact_id"), "tenant_id", "playbook",
        wf_status.alias("status"),
        F.lit(True).alias("synthetic"), F.lit(False).alias("outbound_allowed"), F.lit(False).alias("invoice_issued"),
        F.when(wf_status == "awaiting_approval", "pending").when(wf_status == "billing_review", "approved")
        .otherwise("not_requested").alias("approval_status"),
        F.when(wf_status == "billing_review", "ready_for_review").otherwise("none").alias("billing_status"),
        analysis.alias("analysis"),
        F.coalesce(analysis["draft_reply"], F.lit("")).alias("draft_reply"),
        # channel 'email' is analysed as 'form'
        F.when(F.col("channel") == "email", "form").otherwise(F.col("channel")).alias("analysis_channel"),
        F.col("last_interaction_at").alias("created_at"),
        F.col("last_interaction_at").alias("updated_at"),
    )


def workflow_state(contacts: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored workflow if any, else the default (J1): one row per contact."""
    d = default_workflow(contacts).drop("analysis_channel")
    s = stored.select(*[F.col(c).alias("s_" + c) for c in d.columns])
    j = d.join(s, d.contact_id == s.s_contact_id, "left")
    has = F.col("s_id").isNotNull()
    return j.select(*[F.when(has, F.col("s_" + c)).otherwise(F.col(c)).alias(c) for c in d.columns],
                    has.alias("stored"))


# --------------------------------------------------------------------------- T5


WF_STATUSES = K.WORKFLOW_STATUSES
WF_ACTIONS = ["analyze", "draft", "approve", "reject", "billing_review"]
WF_ERRORS = ["analysis_required", "approval_required", "invalid_draft"]


def py_workflow_step(status: int, has: bool, code: int, draft_ok: bool) -> tuple[int, bool, int]:
    """Reviewer action on a demo workflow in plain Python: (status, analysed, error no.)."""
    waiting = has and status == WF_STATUSES.index("awaiting_approval")
    if code == 1 and not draft_ok:
        return status, has, 3
    if code in (1, 2, 3) and not waiting:
        return status, has, 1
    if code == 4 and status != WF_STATUSES.index("approved"):
        return status, has, 2
    new_status = {0: "awaiting_approval", 2: "approved", 3: "rejected", 4: "billing_review"}.get(code)
    return (WF_STATUSES.index(new_status) if new_status else status), has or code == 0, 0


WF_TABLE = [
    (lambda r: (r[0] * 2 + int(r[1])) * 8 + r[2])(py_workflow_step(s >> 1, bool(s & 1), code, ok))
    for s in range(2 * len(WF_STATUSES)) for code in range(len(WF_ACTIONS)) for ok in (False, True)
]


def workflow_step(s: Column, a: Column) -> tuple[Column, Column]:
    """State = status * 2 + has_analysis; one lookup in the packed table."""
    idx = (s * len(WF_ACTIONS) + a["code"]) * 2 + a["draft_ok"].cast("int")
    packed = F.coalesce(F.element_at(_lit_array(WF_TABLE), idx + 1), s * 8 + 1)
    return F.shiftright(packed, 3), packed.bitwiseAND(F.lit(7))


def replay_workflows(state: DataFrame, actions: DataFrame, chunk_size: int = 512) -> tuple[DataFrame, DataFrame]:
    """Fold reviewer actions over the current workflows (T5).

    Returns (log, final): log has one row per action, final one row per
    workflow with status, approval, billing status, analysis flag and draft.
    """
    from caseflow.functions.text import js_trim
    start = state.select("contact_id", (_index(F.col("status"), WF_STATUSES) * 2
                                        + F.col("analysis").isNotNull().cast("int")).alias("s0"))
    draft = js_trim(F.col("draft_reply"))
    a = actions.select("contact_id", "action_no", "action", draft.alias("draft"), row_hash(actions).alias("_given"),
                       _index(F.col("action"), WF_ACTIONS).alias("code"),
                       F.coalesce(F.length(draft).between(5, 600), F.lit(False)).alias("draft_ok"))
    a = a.join(start, "contact_id", "left")
    r = replay(a, "contact_id", "action_no", ["action", "draft", "code", "draft_ok"], None, n_states=10,
               step=workflow_step, chunk_size=chunk_size, long=long_keys(actions, "contact_id", chunk_size))
    log = r.select("contact_id", "action_no", "action", (F.col("err") == 0).alias("accepted"),
                   F.when(F.col("err") > 0, _name(F.col("err") - 1, WF_ERRORS)).alias("error"),
                   _name(F.shiftright("s_after", 1), WF_STATUSES).alias("status_after"), "draft")
    acc = F.col("accepted")
    order = F.col("action_no")

    def last_of(value, cond):
        return F.max_by(F.when(cond, value), F.when(cond, order))

    approval_of = (F.when(F.col("action") == "analyze", "pending").when(F.col("action") == "approve", "approved")
                   .when(F.col("action") == "reject", "rejected"))
    billing_of = F.when(F.col("action") == "analyze", "none").when(F.col("action") == "billing_review",
                                                                   "ready_for_review")
    agg = log.groupBy("contact_id").agg(
        last_of(F.col("status_after"), acc).alias("_status"),
        last_of(approval_of, acc & approval_of.isNotNull()).alias("_approval"),
        last_of(billing_of, acc & billing_of.isNotNull()).alias("_billing"),
        F.max(acc & (F.col("action") == "analyze")).alias("_analyzed"),
        last_of(F.struct(F.col("action"), F.col("draft")), acc & F.col("action").isin("analyze", "draft"))
        .alias("_draft"),
        F.count_if(acc).alias("accepted_actions"), F.count_if(~acc).alias("rejected_actions"),
    )
    st = state.select("contact_id", "tenant_id", "playbook", "status", "approval_status", "billing_status",
                      "analysis", "draft_reply")
    j = st.join(agg, "contact_id", "left")
    from caseflow.plans.views import analysis_struct
    demo_draft = analysis_struct(F.col("playbook"))["draft_reply"]
    final = j.select(
        "contact_id", "tenant_id",
        F.coalesce("_status", "status").alias("status"),
        F.coalesce("_approval", "approval_status").alias("approval_status"),
        F.coalesce("_billing", "billing_status").alias("billing_status"),
        (F.col("analysis").isNotNull() | F.coalesce("_analyzed", F.lit(False))).alias("has_analysis"),
        F.when(F.col("_draft").isNull(), F.col("draft_reply"))
        .when(F.col("_draft.action") == "analyze", demo_draft).otherwise(F.col("_draft.draft")).alias("draft_reply"),
        F.coalesce("accepted_actions", F.lit(0)).cast("bigint").alias("accepted_actions"),
        F.coalesce("rejected_actions", F.lit(0)).cast("bigint").alias("rejected_actions"),
    )
    return log, final


# --------------------------------------------------------------------------- J9 / J10


def playbook_steps(spark) -> DataFrame:
    """The 32-row static dimension: four playbooks x eight steps."""
    rows = [(pb, i, stage, PLABELS[i]) for pb, PLABELS in K.PLAYBOOK_LABELS.items()
            for i, stage in enumerate(K.CASE_STAGES)]
    return spark.createDataFrame(rows, "playbook string, step_no int, stage string, label string")


def stage_progress(cases: DataFrame) -> DataFrame:
    """Case x its playbook's eight steps: complete / active / pending.
    The dimension is fixed at 32 rows, so broadcasting it is size-safe."""
    steps = F.broadcast(playbook_steps(cases.sparkSession))
    c = cases.select(F.col("id").alias("case_id"), "playbook", "current_stage")
    j = c.join(steps, "playbook", "inner")
    cur = _index(F.col("current_stage"), K.CASE_STAGES)
    state = (F.when(F.col("current_stage") == "completed", "complete")
             .when(F.col("step_no") < cur, "complete").when(F.col("step_no") == cur, "active")
             .otherwise("pending"))
    return j.select("case_id", "step_no", "stage", "label", state.alias("state"))


def open_cases(requests: DataFrame, tenants: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New cases inherit the tenant's playbook; unknown tenants are rejected."""
    t = tenants.select(F.col("id").alias("tenant_id"), "playbook")
    ok = requests.join(t, "tenant_id", "inner").select(
        "request_id", "tenant_id", "playbook", "customer_id",
        F.regexp_replace(F.col("customer_identifier"), "[^0-9]", "").alias("customer_identifier"),
        F.lit("intake").alias("current_stage"), F.lit("open").alias("status"),
        F.lit("not_requested").alias("quote_approval"), F.lit(False).alias("billing_prepared"))
    rejected = requests.join(t, "tenant_id", "left_anti").select(
        "request_id", "tenant_id", F.lit("tenant_not_found").alias("error"))
    return ok, rejected
