"""Lifecycle queries: T1-T6, X7, X8, X10, J1, J9, J10."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators import identity as OI
from caseflow.operators import lifecycle as LC
from caseflow.operators.replay import duplicate_actions
from caseflow.plans import views as V
from caseflow.plans.q_identity import _IDENT_CTE
from caseflow.plans.registry import query

_FROM = ("CASE a.action WHEN 'complete_intake' THEN 'intake' WHEN 'validate_identity' THEN 'identity' "
         "WHEN 'complete_discovery' THEN 'discovery' WHEN 'prepare_quote' THEN 'quote' "
         "WHEN 'approve_quote' THEN 'approval' WHEN 'reject_quote' THEN 'approval' "
         "WHEN 'complete_service' THEN 'service' ELSE 'billing' END")
_TO = ("CASE a.action WHEN 'complete_intake' THEN 'identity' WHEN 'validate_identity' THEN 'discovery' "
       "WHEN 'complete_discovery' THEN 'quote' WHEN 'prepare_quote' THEN 'approval' "
       "WHEN 'approve_quote' THEN 'service' WHEN 'reject_quote' THEN 'quote' "
       "WHEN 'complete_service' THEN 'billing' WHEN 'prepare_billing' THEN 'billing' ELSE 'completed' END")

_CASE_WALK = "WITH RECURSIVE " + _IDENT_CTE.strip() + f""",
canon(pos, action) AS (VALUES (1, 'complete_intake'), (2, 'validate_identity'), (3, 'complete_discovery'),
  (4, 'prepare_quote'), (5, 'approve_quote'), (6, 'complete_service'), (7, 'prepare_billing'), (8, 'close_case')),
raw_acts AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_totalprice, c.pos * 10 AS action_no, c.action
  FROM orders o JOIN canon c ON c.pos <= least(o.o_orderkey % 10, 8)
  UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, 45, 'reject_quote' FROM orders
    WHERE o_orderkey % 11 = 0 AND o_orderkey % 10 >= 4
  UNION ALL SELECT o_orderkey, o_custkey, o_totalprice, 15, 'close_case' FROM orders WHERE o_orderkey % 13 = 0),
acts AS (
  SELECT 'case-' || CAST(r.o_orderkey AS VARCHAR) AS case_id, r.o_custkey, r.action_no, r.action,
    CASE WHEN r.action = 'prepare_quote' AND r.o_orderkey % 17 <> 0
      THEN CAST(round(r.o_totalprice, 2) AS DECIMAL(18,2)) END AS quote_amount_usd,
    coalesce(ty.identifier_type IS NOT NULL, false) AS id_ok,
    row_number() OVER (PARTITION BY r.o_orderkey ORDER BY r.action_no) AS rn
  FROM raw_acts r LEFT JOIN typed ty ON ty.c_custkey = r.o_custkey),
walk AS (
  SELECT DISTINCT case_id, 0 AS rn, 'intake' AS stage, false AS bill, NULL::INTEGER AS action_no,
    NULL::VARCHAR AS action, NULL::DECIMAL(18,2) AS quote_amount_usd, NULL::VARCHAR AS err,
    NULL::VARCHAR AS stage_before
  FROM acts
  UNION ALL
  SELECT case_id, rn,
    CASE WHEN err IS NULL THEN to_stage ELSE stage_before END,
    CASE WHEN err IS NULL THEN (bill_before OR action = 'prepare_billing') ELSE bill_before END,
    action_no, action, quote_amount_usd, err, stage_before
  FROM (
    SELECT a.case_id, a.rn, a.action_no, a.action, a.quote_amount_usd, w.stage AS stage_before,
      w.bill AS bill_before, {_TO} AS to_stage,
      CASE WHEN a.action = 'validate_identity' AND NOT a.id_ok THEN 'invalid_ec_identifier'
        WHEN w.stage <> {_FROM} THEN 'invalid_case_transition'
        WHEN a.action = 'prepare_quote' AND a.quote_amount_usd IS NULL THEN 'quote_amount_required'
        WHEN a.action = 'close_case' AND NOT w.bill THEN 'billing_preparation_required' END AS err
    FROM walk w JOIN acts a ON a.case_id = w.case_id AND a.rn = w.rn + 1)),
log AS (SELECT * FROM walk WHERE rn > 0)"""

# the same walk over permitted actions only (T3 gate before the fold)
_GATED_WALK = _CASE_WALK.replace(
    "  FROM raw_acts r LEFT JOIN typed ty ON ty.c_custkey = r.o_custkey),",
    "  FROM raw_acts r LEFT JOIN typed ty ON ty.c_custkey = r.o_custkey\n"
    "  WHERE r.o_custkey % 17 <> 0 AND r.o_custkey % 4 <> 3\n"
    "    AND NOT (r.action IN ('approve_quote', 'reject_quote') AND r.o_custkey % 4 = 2)),")


@query("transition_log", _CASE_WALK + """
SELECT case_id, action_no, action, quote_amount_usd, err IS NULL AS accepted, err AS error, stage_before,
  stage AS stage_after, bill AS billing_prepared
FROM log""")
def q_transition_log(t):
    ident = OI.validate_identifiers(V.identifiers(t))
    return LC.transition_log(V.cases(t), V.case_actions(t), ident)


@query("replay_cases", _CASE_WALK + """,
cases AS (
  SELECT 'case-' || CAST(o.o_orderkey AS VARCHAR) AS case_id, 'tenant-' || CAST(c.c_nationkey AS VARCHAR) AS tenant_id,
    regexp_replace(i.identifier_text, '[^0-9]', '', 'g') AS customer_identifier
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN ident i ON i.c_custkey = o.o_custkey),
last_ok AS (
  SELECT case_id,
    arg_max(stage, rn) FILTER (WHERE err IS NULL) AS stage,
    arg_max(CASE action WHEN 'prepare_quote' THEN 'waiting_approval' WHEN 'approve_quote' THEN 'active'
      WHEN 'complete_service' THEN 'billing_review' WHEN 'prepare_billing' THEN 'billing_review'
      WHEN 'close_case' THEN 'completed' ELSE 'open' END, rn) FILTER (WHERE err IS NULL) AS status,
    arg_max(CASE action WHEN 'prepare_quote' THEN 'pending' WHEN 'approve_quote' THEN 'approved'
      ELSE 'rejected' END, rn) FILTER (WHERE err IS NULL AND action IN ('prepare_quote', 'approve_quote',
      'reject_quote')) AS approval,
    arg_max(quote_amount_usd, rn) FILTER (WHERE err IS NULL AND action = 'prepare_quote') AS amount,
    bool_or(err IS NULL AND bill) AS bill,
    bool_or(err IS NULL AND action = 'validate_identity') AS validated,
    count(*) FILTER (WHERE err IS NULL) AS ok_n, count(*) FILTER (WHERE err IS NOT NULL) AS bad_n
  FROM log GROUP BY case_id)
SELECT c.case_id, c.tenant_id, coalesce(l.stage, 'intake') AS current_stage, coalesce(l.status, 'open') AS status,
  coalesce(l.approval, 'not_requested') AS quote_approval, l.amount AS quote_amount_usd,
  coalesce(l.bill, false) AS billing_prepared, coalesce(l.validated, false) AS identity_validated,
  c.customer_identifier, coalesce(l.ok_n, 0) AS accepted_actions, coalesce(l.bad_n, 0) AS rejected_actions
FROM cases c LEFT JOIN last_ok l ON c.case_id = l.case_id""")
def q_replay_cases(t):
    ident = OI.validate_identifiers(V.identifiers(t))
    return LC.replay_cases(V.cases(t), V.case_actions(t), ident).drop("playbook", "updated_at", "outbound_allowed",
                                                                      "invoice_issued")


@query("case_stage_mix", _CASE_WALK + """,
fin AS (SELECT case_id, arg_max(stage, rn) AS stage FROM walk GROUP BY case_id)
SELECT stage AS current_stage, count(*) AS cases FROM fin GROUP BY stage""")
def q_case_stage_mix(t):
    ident = OI.validate_identifiers(V.identifiers(t))
    log = LC.transition_log(V.cases(t), V.case_actions(t), ident)
    fin = log.groupBy("case_id").agg(F.max_by("stage_after", "action_no").alias("current_stage"))
    return fin.groupBy("current_stage").agg(F.count("*").alias("cases"))


@query("transition_events", _CASE_WALK + """,
cinfo AS (SELECT 'case-' || CAST(o_orderkey AS VARCHAR) AS case_id,
  'tenant-' || CAST(c_nationkey AS VARCHAR) AS tenant_id, 'contact-' || CAST(o_custkey AS VARCHAR) AS customer_id
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT substr(sha256(l.case_id || '|' || CAST(l.action_no AS VARCHAR)), 1, 32) AS event_id, c.tenant_id,
  l.case_id, c.customer_id, l.action,
  CASE WHEN l.action = 'validate_identity' THEN 'identity_validation_completed'
    ELSE 'workflow_transition_completed' END AS event_name,
  'human' AS actor_type, l.stage_before || ' → ' || l.stage AS decision,
  CASE l.action WHEN 'approve_quote' THEN 'approved' WHEN 'reject_quote' THEN 'rejected'
    WHEN 'prepare_quote' THEN 'required' ELSE 'not_required' END AS human_approval
FROM log l JOIN cinfo c ON c.case_id = l.case_id WHERE l.err IS NULL""")
def q_transition_events(t):
    ident = OI.validate_identifiers(V.identifiers(t))
    cases = V.cases(t)
    return LC.transition_events(LC.transition_log(cases, V.case_actions(t), ident), cases)


_PERMS = """CASE c.c_custkey % 4 WHEN 0 THEN 'platform_owner' WHEN 1 THEN 'administrator'
  WHEN 2 THEN 'collaborator' ELSE 'customer' END"""


@query("gate_transitions", """
WITH canon(pos, action) AS (VALUES (1, 'complete_intake'), (2, 'validate_identity'), (3, 'complete_discovery'),
  (4, 'prepare_quote'), (5, 'approve_quote'), (6, 'complete_service'), (7, 'prepare_billing'), (8, 'close_case')),
acts AS (
  SELECT o.o_orderkey, o.o_custkey, c.pos * 10 AS action_no, c.action
  FROM orders o JOIN canon c ON c.pos <= least(o.o_orderkey % 10, 8)
  UNION ALL SELECT o_orderkey, o_custkey, 45, 'reject_quote' FROM orders
    WHERE o_orderkey % 11 = 0 AND o_orderkey % 10 >= 4
  UNION ALL SELECT o_orderkey, o_custkey, 15, 'close_case' FROM orders WHERE o_orderkey % 13 = 0),
actor AS (
  SELECT c_custkey, c_custkey % 17 <> 0 AS active, CASE c_custkey % 4 WHEN 0 THEN 'platform_owner'
    WHEN 1 THEN 'administrator' WHEN 2 THEN 'collaborator' ELSE 'customer' END AS role FROM customer),
g AS (
  SELECT a.*, r.active, r.role,
    CASE WHEN NOT r.active OR r.role = 'customer' THEN 'case_management_forbidden'
      WHEN a.action IN ('approve_quote', 'reject_quote') AND r.role = 'collaborator' THEN 'quote_approval_forbidden'
    END AS error
  FROM acts a JOIN actor r ON r.c_custkey = a.o_custkey)
SELECT 'case-' || CAST(o_orderkey AS VARCHAR) AS case_id, action_no, action,
  'user-' || CAST(o_custkey AS VARCHAR) AS actor_user_id, error IS NULL AS permitted, error
FROM g""")
def q_gate_transitions(t):
    return LC.gate_transitions(V.case_actions(t), V.cases(t), V.memberships(t))


@query("safety_violations", """
WITH v AS (
  SELECT 'case' AS kind, 'case-' || CAST(o_orderkey AS VARCHAR) AS id, concat_ws(',',
    CASE WHEN o_orderkey % 97 = 0 THEN 'outbound_allowed' END, CASE WHEN o_orderkey % 89 = 0 THEN 'invoice_issued' END,
    CASE WHEN o_orderkey % 101 = 0 THEN 'closed_without_billing' END) AS violations
  FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL
  SELECT 'workflow', 'demo-case-contact-' || CAST(c_custkey AS VARCHAR), concat_ws(',',
    CASE WHEN c_custkey % 27 = 0 THEN 'outbound_allowed' END, CASE WHEN c_custkey % 33 = 0 THEN 'not_synthetic' END)
  FROM customer WHERE c_custkey % 3 = 0)
SELECT * FROM v WHERE violations <> ''""")
def q_safety_violations(t):
    """Stored rows with forbidden flags, and cases stored as completed without
    billing, must come out of the replay as violations; nothing else may."""
    ident = OI.validate_identifiers(V.identifiers(t))
    k = F.substring_index("id", "-", -1).cast("bigint")
    stored = V.cases(t).withColumns({
        "outbound_allowed": k % 97 == 0, "invoice_issued": k % 89 == 0,
        "current_stage": F.when(k % 101 == 0, "completed").otherwise(F.col("current_stage"))})
    final = LC.replay_cases(stored, V.case_actions(t), ident)
    cases = final.select(F.col("case_id").alias("id"), "current_stage", "billing_prepared", "outbound_allowed",
                         "invoice_issued")
    workflows = V.stored_workflows(t).withColumns({"outbound_allowed": k % 27 == 0, "synthetic": k % 33 != 0})
    return LC.safety_violations(cases, workflows)


# --------------------------------------------------------------------------- workflows

_WF_STATUS = """CASE (c_custkey // 3) % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'awaiting_approval' WHEN 2 THEN 'approved'
  WHEN 3 THEN 'rejected' ELSE 'billing_review' END"""
_C_STATUS = """CASE c_custkey % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'followup_due' WHEN 2 THEN 'discovery'
  WHEN 3 THEN 'approval_required' ELSE 'billing_review' END"""
_DRAFT_STUDIO = ("Gracias por escribirnos. Para recomendarte la sesión adecuada, ¿qué tipo de sesión buscas, "
                 "para qué fecha y qué rango de inversión tienes previsto?")
_DRAFT_IAPRO = ("Podemos comenzar con un diagnóstico del proceso. Para delimitarlo necesitamos conocer el flujo "
                "actual, su volumen, las áreas involucradas y el impacto que genera.")

_WF_STATE = f"""
wstate AS (
  SELECT 'contact-' || CAST(c_custkey AS VARCHAR) AS contact_id, 'tenant-' || CAST(c_nationkey AS VARCHAR) AS tenant_id,
    CASE WHEN c_custkey % 2 = 0 THEN 'photography_studio' ELSE 'iapro' END AS playbook,
    CASE WHEN c_custkey % 3 = 0 THEN {_WF_STATUS}
      ELSE CASE {_C_STATUS} WHEN 'approval_required' THEN 'awaiting_approval' WHEN 'billing_review' THEN 'billing_review'
        ELSE 'new' END END AS status,
    CASE WHEN c_custkey % 3 = 0 THEN {_WF_STATUS} <> 'new'
      ELSE {_C_STATUS} IN ('approval_required', 'billing_review') END AS has_analysis,
    c_custkey % 3 = 0 AS stored
  FROM customer),
wstate2 AS (
  SELECT *,
    CASE status WHEN 'awaiting_approval' THEN 'pending' WHEN 'billing_review' THEN 'approved'
      WHEN 'approved' THEN 'approved' WHEN 'rejected' THEN 'rejected' ELSE 'not_requested' END AS approval_status,
    CASE WHEN status = 'billing_review' THEN 'ready_for_review' ELSE 'none' END AS billing_status,
    CASE WHEN has_analysis THEN CASE playbook WHEN 'photography_studio' THEN '{_DRAFT_STUDIO}'
      ELSE '{_DRAFT_IAPRO}' END ELSE '' END AS draft_reply
  FROM wstate)"""


@query("workflow_state", "WITH " + _WF_STATE.strip() + """
SELECT contact_id, tenant_id, status, approval_status, billing_status, has_analysis, stored FROM wstate2""")
def q_workflow_state(t):
    s = LC.workflow_state(V.contacts(t), V.stored_workflows(t))
    return s.select("contact_id", "tenant_id", "status", "approval_status", "billing_status",
                    F.col("analysis").isNotNull().alias("has_analysis"), "stored")


_WF_WALK = "WITH RECURSIVE " + _WF_STATE.strip() + f""",
wacts AS (
  SELECT 'contact-' || CAST(o_custkey AS VARCHAR) AS contact_id, o_orderkey AS action_no,
    CASE (o_orderkey // 7) % 5 WHEN 0 THEN 'analyze' WHEN 1 THEN 'draft' WHEN 2 THEN 'approve' WHEN 3 THEN 'reject'
      ELSE 'billing_review' END AS action,
    o_orderkey % 7 = 0 AS short_draft,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
  FROM orders),
wwalk AS (
  SELECT contact_id, 0 AS rn, status, has_analysis, NULL::BIGINT AS action_no, NULL::VARCHAR AS action,
    NULL::VARCHAR AS err FROM wstate2
  UNION ALL
  SELECT contact_id, rn, CASE WHEN err IS NULL THEN new_status ELSE st END,
    CASE WHEN err IS NULL THEN new_has ELSE ha END, action_no, action, err
  FROM (
    SELECT a.contact_id, a.rn, a.action_no, a.action, w.status AS st, w.has_analysis AS ha,
      CASE a.action WHEN 'analyze' THEN 'awaiting_approval' WHEN 'approve' THEN 'approved'
        WHEN 'reject' THEN 'rejected' WHEN 'billing_review' THEN 'billing_review' ELSE w.status END AS new_status,
      w.has_analysis OR a.action = 'analyze' AS new_has,
      CASE WHEN a.action = 'draft' AND a.short_draft THEN 'invalid_draft'
        WHEN a.action IN ('draft', 'approve', 'reject') AND NOT (w.has_analysis AND w.status = 'awaiting_approval')
          THEN 'analysis_required'
        WHEN a.action = 'billing_review' AND w.status <> 'approved' THEN 'approval_required' END AS err
    FROM wwalk w JOIN wacts a ON a.contact_id = w.contact_id AND a.rn = w.rn + 1))"""


@query("action_quarantine", """
WITH canon(pos, action) AS (VALUES (1, 'complete_intake'), (2, 'validate_identity'), (3, 'complete_discovery'),
  (4, 'prepare_quote'), (5, 'approve_quote'), (6, 'complete_service'), (7, 'prepare_billing'), (8, 'close_case')),
walk AS (
  SELECT o.*, c.pos * 10 AS action_no, c.action FROM orders o JOIN canon c ON c.pos <= least(o.o_orderkey % 10, 8)
  UNION ALL SELECT *, 45, 'reject_quote' FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey % 10 >= 4
  UNION ALL SELECT *, 15, 'close_case' FROM orders WHERE o_orderkey % 13 = 0),
acts AS (
  SELECT 'case' AS log, 'case-' || CAST(o_orderkey AS VARCHAR) AS key, CAST(action_no AS BIGINT) AS action_no, action,
    o_custkey || '|' || o_totalprice || '|' || o_orderdate AS more FROM walk
  UNION ALL SELECT 'workflow', 'contact-' || CAST(o_custkey AS VARCHAR), o_orderkey,
    CASE (o_orderkey // 7) % 5 WHEN 0 THEN 'analyze' WHEN 1 THEN 'draft' WHEN 2 THEN 'approve' WHEN 3 THEN 'reject'
      ELSE 'billing_review' END, '' FROM orders),
again AS (SELECT log, key, action_no, count(*) AS occurrences FROM acts GROUP BY log, key, action_no
          HAVING count(DISTINCT (action, more)) > 1)
SELECT log, key, action_no, action, occurrences FROM acts JOIN again USING (log, key, action_no)""")
def q_action_quarantine(t):
    def rows(log, actions, key):
        return duplicate_actions(actions, key, "action_no").select(
            F.lit(log).alias("log"), F.col(key).alias("key"), F.col("action_no").cast("bigint").alias("action_no"),
            "action", "occurrences")
    return rows("case", V.case_actions(t), "case_id").unionByName(rows("workflow", V.workflow_actions(t), "contact_id"))


@query("workflow_log", _WF_WALK + """
SELECT contact_id, action_no, action, err IS NULL AS accepted, err AS error, status AS status_after
FROM wwalk WHERE rn > 0""")
def q_workflow_log(t):
    log, _ = LC.replay_workflows(LC.workflow_state(V.contacts(t), V.stored_workflows(t)), V.workflow_actions(t))
    return log.drop("draft")


@query("replay_workflows", _WF_WALK + f""",
agg AS (
  SELECT contact_id,
    arg_max(status, rn) AS status,
    arg_max(CASE action WHEN 'analyze' THEN 'pending' WHEN 'approve' THEN 'approved' ELSE 'rejected' END, rn)
      FILTER (WHERE rn > 0 AND err IS NULL AND action IN ('analyze', 'approve', 'reject')) AS approval,
    arg_max(CASE action WHEN 'analyze' THEN 'none' ELSE 'ready_for_review' END, rn)
      FILTER (WHERE rn > 0 AND err IS NULL AND action IN ('analyze', 'billing_review')) AS billing,
    arg_max(has_analysis, rn) AS has_analysis,
    arg_max(CASE WHEN action = 'analyze' THEN '#demo' ELSE 'Borrador revisado ' || CAST(action_no AS VARCHAR) END, rn)
      FILTER (WHERE rn > 0 AND err IS NULL AND action IN ('analyze', 'draft')) AS draft,
    count(*) FILTER (WHERE rn > 0 AND err IS NULL) AS ok_n, count(*) FILTER (WHERE rn > 0 AND err IS NOT NULL) AS bad_n
  FROM wwalk GROUP BY contact_id)
SELECT s.contact_id, s.tenant_id, a.status, coalesce(a.approval, s.approval_status) AS approval_status,
  coalesce(a.billing, s.billing_status) AS billing_status, a.has_analysis,
  CASE WHEN a.draft IS NULL THEN s.draft_reply WHEN a.draft = '#demo' THEN
    CASE s.playbook WHEN 'photography_studio' THEN '{_DRAFT_STUDIO}' ELSE '{_DRAFT_IAPRO}' END
    ELSE a.draft END AS draft_reply,
  a.ok_n AS accepted_actions, a.bad_n AS rejected_actions
FROM wstate2 s JOIN agg a ON a.contact_id = s.contact_id""")
def q_replay_workflows(t):
    _, final = LC.replay_workflows(LC.workflow_state(V.contacts(t), V.stored_workflows(t)), V.workflow_actions(t))
    return final


@query("next_action", _CASE_WALK + """,
fin AS (SELECT case_id, arg_max(stage, rn) AS stage, arg_max(bill, rn) AS bill FROM walk GROUP BY case_id)
SELECT case_id, stage AS current_stage, CASE stage WHEN 'intake' THEN 'complete_intake'
  WHEN 'identity' THEN 'validate_identity' WHEN 'discovery' THEN 'complete_discovery'
  WHEN 'quote' THEN 'prepare_quote' WHEN 'approval' THEN 'approve_quote' WHEN 'service' THEN 'complete_service'
  WHEN 'billing' THEN CASE WHEN bill THEN 'close_case' ELSE 'prepare_billing' END END AS next_action
FROM fin""")
def q_next_action(t):
    ident = OI.validate_identifiers(V.identifiers(t))
    log = LC.transition_log(V.cases(t), V.case_actions(t), ident)
    fin = log.groupBy("case_id").agg(F.max_by("stage_after", "action_no").alias("current_stage"),
                                     F.max_by("billing_prepared", "action_no").alias("billing_prepared"))
    return fin.select("case_id", "current_stage", LC.next_action(fin).alias("next_action"))


@query("analyze_rule", f"""
SELECT 'contact-' || CAST(c_custkey AS VARCHAR) AS request_id,
  CASE WHEN c_custkey % 2 = 0 THEN 'photography_session' ELSE 'process_engineering' END AS service_family,
  'medium' AS urgency, CASE WHEN c_custkey % 2 = 0 THEN 0.91::DOUBLE ELSE 0.88::DOUBLE END AS confidence,
  true AS requires_human_approval, CASE WHEN c_custkey % 2 = 0 THEN 3 ELSE 4 END AS missing_count,
  CASE c_custkey % 4 WHEN 0 THEN 'whatsapp' WHEN 1 THEN 'form' WHEN 2 THEN 'form' ELSE 'spreadsheet' END AS channel
FROM customer""")
def q_analyze_rule(t):
    c = V.contacts(t).select(F.col("id").alias("request_id"), "playbook",
                             F.when(F.col("channel") == "email", "form").otherwise(F.col("channel")).alias("channel"))
    a = LC.analyze_rule(c)
    return a.select("request_id", "service_family", "urgency", "confidence", "requires_human_approval",
                    F.size("missing_information").alias("missing_count"), "channel")


@query("stage_progress", _CASE_WALK + """,
fin AS (SELECT case_id, arg_max(stage, rn) AS stage FROM walk GROUP BY case_id),
allc AS (
  SELECT 'case-' || CAST(o.o_orderkey AS VARCHAR) AS case_id, c.c_nationkey % 4 AS pb FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey),
st(step_no, stage) AS (VALUES (0, 'intake'), (1, 'identity'), (2, 'discovery'), (3, 'quote'), (4, 'approval'),
  (5, 'service'), (6, 'billing'), (7, 'completed')),
cur AS (SELECT a.case_id, a.pb, coalesce(f.stage, 'intake') AS stage FROM allc a LEFT JOIN fin f ON a.case_id = f.case_id)
SELECT c.case_id, s.step_no, s.stage,
  CASE WHEN c.stage = 'completed' OR s.step_no < (SELECT step_no FROM st x WHERE x.stage = c.stage) THEN 'complete'
    WHEN s.stage = c.stage THEN 'active' ELSE 'pending' END AS state
FROM cur c CROSS JOIN st s""")
def q_stage_progress(t):
    ident = OI.validate_identifiers(V.identifiers(t))
    final = LC.replay_cases(V.cases(t), V.case_actions(t), ident)
    cases = final.select(F.col("case_id").alias("id"), "playbook", "current_stage")
    return LC.stage_progress(cases).drop("label")


@query("open_cases", """
SELECT 'req-' || CAST(c_custkey AS VARCHAR) AS request_id, 'tenant-' || CAST(c_custkey % 30 AS VARCHAR) AS tenant_id,
  CASE WHEN c_custkey % 30 >= 25 THEN NULL ELSE CASE (c_custkey % 30) % 4 WHEN 0 THEN 'pcdoctor' WHEN 1 THEN 'iapro'
    WHEN 2 THEN 'photography_studio' ELSE 'condominium_management' END END AS playbook,
  CASE WHEN c_custkey % 30 >= 25 THEN 'tenant_not_found' END AS error
FROM customer""")
def q_open_cases(t):
    c = t.customer
    req = c.select(F.concat(F.lit("req-"), c.c_custkey.cast("string")).alias("request_id"),
                   F.concat(F.lit("tenant-"), (c.c_custkey % 30).cast("string")).alias("tenant_id"),
                   F.concat(F.lit("contact-"), c.c_custkey.cast("string")).alias("customer_id"),
                   F.lit("17-1003-4065").alias("customer_identifier"))
    ok, bad = LC.open_cases(req, V.tenants(t))
    return ok.select("request_id", "tenant_id", "playbook", F.lit(None).cast("string").alias("error")) \
        .unionByName(bad.select("request_id", "tenant_id", F.lit(None).cast("string").alias("playbook"), "error"))


@query("gated_transition_events", _GATED_WALK + """,
cinfo AS (SELECT 'case-' || CAST(o_orderkey AS VARCHAR) AS case_id,
  'tenant-' || CAST(c_nationkey AS VARCHAR) AS tenant_id, 'contact-' || CAST(o_custkey AS VARCHAR) AS customer_id
  FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT substr(sha256(l.case_id || '|' || CAST(l.action_no AS VARCHAR)), 1, 32) AS event_id, c.tenant_id,
  l.case_id, l.action, l.stage_before || ' → ' || l.stage AS decision
FROM log l JOIN cinfo c ON c.case_id = l.case_id WHERE l.err IS NULL""")
def q_gated_transition_events(t):
    """The whole transition path: permission gate (T3) -> identifier check
    (X1) -> guarded fold (T1/T2) -> audit rows (T4)."""
    ident = OI.validate_identifiers(V.identifiers(t))
    cases, actions = V.cases(t), V.case_actions(t)
    gate = LC.gate_transitions(actions, cases, V.memberships(t)).where("permitted").select("case_id", "action_no")
    allowed = actions.join(gate, ["case_id", "action_no"], "left_semi")
    ev = LC.transition_events(LC.transition_log(cases, allowed, ident), cases)
    return ev.select("event_id", "tenant_id", "case_id", "action", "decision")
