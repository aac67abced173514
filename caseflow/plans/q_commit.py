"""Committed case transitions: T1 and T4 as one fold (``case_commit``,
``case_commit_events``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators import commit as CM
from caseflow.operators import identity as OI
from caseflow.plans import views as V
from caseflow.plans.q_lifecycle import _CASE_WALK
from caseflow.plans.registry import query
from caseflow.sources.io import landing_path


def _checks(t):
    """Identity checks of all customers; the registry knows the RUCs of even keys."""
    ids = OI.validate_identifiers(V.identifiers(t), keep=["c_custkey"])
    names = t.customer.select("c_custkey", "c_name")
    ruc = (F.col("identifier_type") == "ruc") & (F.col("c_custkey") % 2 == 0)
    known = F.coalesce(ruc, F.lit(False))
    return ids.join(names, "c_custkey").select(
        "identifier", "identifier_type", "locally_valid", known.alias("registry_verified"),
        F.when(known, "registry").otherwise("local_checksum").alias("source"),
        F.when(known, F.upper("c_name")).otherwise("").alias("legal_name"), F.lit("").alias("commercial_name"),
        F.lit("").alias("activity"), F.when(known, "verified").otherwise("locally_valid").alias("status"))


def _committed(t):
    """The action log in three batches; the second is sent again under its own
    number and under a new one."""
    base = CM.create_store(t.spark, landing_path(t.spark, "case-store"))
    cases, checks = V.cases(t), _checks(t)
    actions = V.case_actions(t).withColumn("note", F.when(F.col("action") == "reject_quote", F.concat(
        F.lit("Motivo "), F.col("action_no").cast("string"))))
    no = F.col("action_no")
    middle = actions.where((no > 20) & (no <= 45))
    for batch, part in ((0, actions.where(no <= 20)), (1, middle), (1, middle), (2, middle), (3, actions.where(no > 45))):
        CM.commit_batch(t.spark, base, batch, cases, part, checks)
    return base, cases


_ROWS = """,
ev AS (
  SELECT l.*, o.o_custkey, o.o_orderdate + l.action_no * INTERVAL 1 HOUR AS ts,
    CASE l.action WHEN 'prepare_quote' THEN 'waiting_approval' WHEN 'approve_quote' THEN 'active'
      WHEN 'complete_service' THEN 'billing_review' WHEN 'prepare_billing' THEN 'billing_review'
      WHEN 'close_case' THEN 'completed' ELSE 'open' END AS st,
    sha256(l.case_id || '|' || CAST(l.action_no AS VARCHAR)) AS h
  FROM log l JOIN orders o ON l.case_id = 'case-' || CAST(o.o_orderkey AS VARCHAR)
  WHERE l.err IS NULL)"""


@query("case_commit", _CASE_WALK + _ROWS + """,
fin AS (SELECT case_id, arg_max(stage, rn) AS stage, arg_max(st, rn) AS st, arg_max(ts, rn) AS ts,
    max(ts) FILTER (WHERE action = 'validate_identity') AS verified, count(*) AS n FROM ev GROUP BY case_id)
SELECT 'case-' || CAST(o.o_orderkey AS VARCHAR) AS case_id, coalesce(f.stage, 'intake') AS current_stage,
  coalesce(f.st, 'open') AS status, regexp_replace(i.identifier_text, '[^0-9]', '', 'g') AS customer_identifier,
  CASE WHEN f.verified IS NOT NULL AND ty.identifier_type = 'ruc' AND c.c_custkey % 2 = 0 THEN upper(c.c_name)
    ELSE c.c_name END AS customer_name,
  CASE WHEN f.verified IS NOT NULL THEN ty.identifier_type END AS identifier_type,
  CASE WHEN f.verified IS NOT NULL THEN CASE WHEN ty.identifier_type = 'ruc' AND c.c_custkey % 2 = 0 THEN 'verified'
    ELSE 'locally_valid' END END AS identity_status,
  f.verified AS verified_at, coalesce(f.ts, o.o_orderdate) AS updated_at, coalesce(f.n, 0) AS audit_rows
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN ident i ON i.c_custkey = o.o_custkey
LEFT JOIN typed ty ON ty.c_custkey = o.o_custkey
LEFT JOIN fin f ON f.case_id = 'case-' || CAST(o.o_orderkey AS VARCHAR)""")
def q_case_commit(t):
    """Cases after all batches, with the number of their audit rows."""
    base, cases = _committed(t)
    rows = CM.read_table(t.spark, base, "events").groupBy("case_id").agg(F.count("*").alias("audit_rows"))
    after = CM.stored_cases(t.spark, base, cases, [
        "id", "current_stage", "status", "customer_identifier", "customer_name", "identity_validation", "updated_at",
    ]).withColumnRenamed("id", "case_id")
    check = F.col("identity_validation")
    return after.join(rows, "case_id", "left").select(
        "case_id", "current_stage", "status", "customer_identifier", "customer_name",
        check["identifier_type"].alias("identifier_type"), check["status"].alias("identity_status"),
        check["verified_at"].alias("verified_at"), "updated_at", F.coalesce("audit_rows", F.lit(0)).alias("audit_rows"))


@query("case_commit_events", _CASE_WALK + _ROWS + """
SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-8' || substr(h, 18, 3) || '-'
    || substr(h, 21, 12) AS event_id, ts AS timestamp, 'tenant-' || CAST(c.c_nationkey AS VARCHAR) AS tenant_id,
  'contact-' || CAST(c.c_custkey AS VARCHAR) AS customer_id, case_id, 'user-' || CAST(c.c_custkey AS VARCHAR) AS agent_id,
  action, CASE WHEN action = 'validate_identity' THEN 'identity_validation_completed'
    ELSE 'workflow_transition_completed' END AS event_name,
  CASE WHEN action = 'reject_quote' THEN 'Motivo ' || CAST(action_no AS VARCHAR)
    ELSE 'Orden ' || substr(case_id, 6) END AS input_summary,
  stage_before || ' → ' || stage AS decision, 'Expediente actualizado a ' || st || '.' AS result,
  CASE action WHEN 'approve_quote' THEN 'approved' WHEN 'reject_quote' THEN 'rejected'
    WHEN 'prepare_quote' THEN 'required' ELSE 'not_required' END AS human_approval
FROM ev JOIN customer c ON c.c_custkey = ev.o_custkey""")
def q_case_commit_events(t):
    """The audit rows of all batches."""
    base, _ = _committed(t)
    return CM.read_table(t.spark, base, "events").select(
        "event_id", "timestamp", "tenant_id", "customer_id", "case_id", "agent_id", "action", "event_name",
        "input_summary", "decision", "result", "human_approval")
