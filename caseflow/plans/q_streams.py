"""Streaming queries (T7, T8): each runs its stream to completion over a
landing folder written from the driver tables, then returns the sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators import identity as OI
from caseflow.plans import views as V
from caseflow.plans.oracle import with_views
from caseflow.plans.q_lifecycle import _CASE_WALK
from caseflow.plans.registry import query
from caseflow.sources.io import landing_path
from caseflow.streaming import case_state as CS
from caseflow.streaming import streams as S

def _actions(t):
    """Actions with the validity of their case's identifier."""
    ident = OI.validate_identifiers(V.identifiers(t))
    cases = V.cases(t).select(F.col("id").alias("case_id"), "customer_identifier")
    ok = ident.select(F.col("identifier").alias("customer_identifier"), "locally_valid") \
        .dropDuplicates(["customer_identifier"])
    return V.case_actions(t).join(cases, "case_id", "left").join(ok, "customer_identifier", "left").select(
        "case_id", F.col("action_no").cast("long").alias("action_no"), "action",
        F.coalesce("locally_valid", F.lit(False)).alias("id_ok"), "quote_amount_usd")


@query("stream_cases", _CASE_WALK + """,
fin AS (SELECT case_id, arg_max(stage, rn) AS current_stage, arg_max(bill, rn) AS billing_prepared,
  coalesce(arg_max(CASE action WHEN 'prepare_quote' THEN 'waiting_approval' WHEN 'approve_quote' THEN 'active'
    WHEN 'complete_service' THEN 'billing_review' WHEN 'prepare_billing' THEN 'billing_review'
    WHEN 'close_case' THEN 'completed' ELSE 'open' END, rn) FILTER (WHERE rn > 0 AND err IS NULL), 'open') AS status,
  coalesce(arg_max(CASE action WHEN 'prepare_quote' THEN 'pending' WHEN 'approve_quote' THEN 'approved'
    ELSE 'rejected' END, rn) FILTER (WHERE err IS NULL AND action IN ('prepare_quote', 'approve_quote',
    'reject_quote')), 'not_requested') AS quote_approval,
  arg_max(quote_amount_usd, rn) FILTER (WHERE err IS NULL AND action = 'prepare_quote') AS quote_amount_usd,
  count(*) FILTER (WHERE rn > 0 AND err IS NULL) AS accepted_actions,
  count(*) FILTER (WHERE rn > 0 AND err IS NOT NULL) AS rejected_actions, max(action_no) AS last_action_no
  FROM walk GROUP BY case_id)
SELECT * FROM fin""")
def q_stream_cases(t):
    """Two deliveries in no order, with a restart of the stream between them:
    a hash of case and number says which actions come late, and some of the
    first delivery come again."""
    a = _actions(t)
    k = F.pmod(F.xxhash64("case_id", "action_no"), F.lit(3))
    src, sink, ck = (landing_path(t.spark, f"case-{n}") for n in ("actions", "state", "ckpt"))
    cases = V.cases(t).withColumnRenamed("id", "case_id")
    for delivery in (a.where(k > 0), a.where(k < 2)):
        delivery.repartition(8, "case_id", "action_no").write.mode("append").parquet(src)
        states, _ = CS.stream_cases(t.spark, src, a.schema, sink, ck, cases)
    return states


@query("stream_events", with_views("""
SELECT event_id, event_name, tenant_id, timestamp FROM audit_v""", "audit_v"))
def q_stream_events(t):
    """Three deliveries with a restart of the stream between them: most of the
    log, then older events that are late beyond any bound together with known
    ids under newer timestamps, then everything once more."""
    a = V.audit_events(t)
    k = F.substring_index("event_id", "-", -1).cast("bigint")
    path, sink, ck = (landing_path(t.spark, f"audit-{n}") for n in ("landing", "sink", "ckpt"))
    newer = a.where(k % 9 == 0).withColumn("timestamp", F.col("timestamp") + F.make_interval(days=F.lit(40)))
    late = a.where(k % 5 == 1)
    for delivery in (a.where(k % 5 != 1), late.unionByName(newer).unionByName(late), a):
        delivery.repartition(4).write.mode("append").parquet(path)
        out = S.stream_events(t.spark, path, a.schema, sink, ck)
    return out.select("event_id", "event_name", "tenant_id", "timestamp")
