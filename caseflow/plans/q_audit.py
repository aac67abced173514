"""Audit queries: S8, S9, L1, L2, A9, A11, A13, A14, W2-W4, J14, G1, T9, T10."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators import audit as AU
from caseflow.operators import identity as OI
from caseflow.operators import lifecycle as LC
from caseflow.operators import rate_limit as RL
from caseflow.plans import views as V
from caseflow.plans.oracle import with_views
from caseflow.plans.q_lifecycle import _CASE_WALK, _WF_WALK
from caseflow.plans.registry import query

_A = ["audit_v"]


@query("append_events", with_views("""
SELECT DISTINCT event_id, event_name FROM audit_v WHERE (eid % 3 = 0 OR eid % 9 = 0) AND eid % 2 <> 0""", *_A))
def q_append_events(t):
    a = V.audit_events(t)
    existing = a.where(F.substring_index("event_id", "-", -1).cast("bigint") % 2 == 0)
    k = F.substring_index("event_id", "-", -1).cast("bigint")
    new = a.where(k % 3 == 0).unionByName(a.where(k % 9 == 0))
    return AU.append_events(existing, new).select("event_id", "event_name")


@query("merge_events", with_views("""
SELECT event_id, event_name, tenant_id, 'agent' AS actor_type FROM audit_v
  WHERE event_name IN ('agent_decision_completed', 'agent_error', 'agent_retry')
UNION ALL SELECT event_id, event_name, tenant_id, CASE event_name WHEN 'human_approval_completed' THEN 'human'
  WHEN 'customer_created' THEN 'customer' ELSE 'system' END FROM audit_v
  WHERE event_name NOT IN ('agent_decision_completed', 'agent_error', 'agent_retry')
UNION ALL SELECT 'prop-created-' || id, 'managed_property_created', tenant_id, 'human' FROM properties_v
UNION ALL SELECT 'contact-import-' || CAST(c_custkey AS VARCHAR), 'contact_import_completed',
  'tenant-' || CAST(c_nationkey AS VARCHAR), 'system' FROM customer""", "audit_v", "properties_v"))
def q_merge_events(t):
    a = V.audit_events(t)
    p = V.properties(t).select(F.concat(F.lit("prop-created-"), F.col("id")).alias("event_id"),
                               F.lit("managed_property_created").alias("event_name"), "tenant_id",
                               F.lit("human").alias("actor_type"))
    c = V.contacts(t).select(F.concat(F.lit("contact-import-"), F.substring_index("id", "-", -1)).alias("event_id"),
                             F.lit("contact_import_completed").alias("event_name"), "tenant_id",
                             F.lit("system").alias("actor_type"))
    return AU.merge_event_sources(a, p, c).select("event_id", "event_name", "tenant_id", "actor_type")


@query("event_feed", with_views("""
SELECT event_id, timestamp, event_name FROM audit_v WHERE tenant_id = 'tenant-3'
ORDER BY timestamp DESC, event_id LIMIT 100""", *_A))
def q_event_feed(t):
    return AU.event_feed(V.audit_events(t), "tenant-3", 100).select("event_id", "timestamp", "event_name")


@query("page", """
SELECT 'case-' || CAST(o.o_orderkey AS VARCHAR) AS id FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE c.c_nationkey = 5 AND 'case-' || CAST(o.o_orderkey AS VARCHAR) > 'case-100'
ORDER BY 1 LIMIT 500""")
def q_page(t):
    c = V.cases(t).where(F.col("tenant_id") == "tenant-5").select("id")
    return AU.page(c, "id", 500, after="case-100")


@query("time_to_classified", with_views("""
, fi AS (SELECT tenant_id, case_id, min(timestamp) AS t_in FROM audit_v
  WHERE event_name IN ('case_created', 'customer_created', 'media_received') GROUP BY ALL),
per_case AS (SELECT a.tenant_id, a.case_id, min(a.timestamp) AS t_an, any_value(f.t_in) AS t_in
  FROM audit_v a JOIN fi f ON f.tenant_id = a.tenant_id AND f.case_id = a.case_id
  WHERE a.event_name IN ('agent_decision_completed', 'gemini_analysis_completed') AND a.timestamp >= f.t_in
  GROUP BY ALL)
SELECT tenant_id, count(*) AS cases,
  round(median((epoch_us(t_an) - epoch_us(t_in)) / 1e6), 3) AS median_seconds
FROM per_case GROUP BY tenant_id""", *_A).replace("\n, fi AS", ",\nfi AS"))
def q_time_to_classified(t):
    return AU.time_to_classified(V.audit_events(t))


@query("approval_rates", with_views("""
SELECT agent_id, count(*) AS decisions,
  round(count(*) FILTER (WHERE human_approval = 'approved') / count(*), 6) AS approved_share,
  round(count(*) FILTER (WHERE human_approval = 'edited') / count(*), 6) AS edited_share,
  round(count(*) FILTER (WHERE human_approval = 'rejected') / count(*), 6) AS rejected_share
FROM audit_v WHERE event_name = 'human_approval_completed' GROUP BY agent_id""", *_A))
def q_approval_rates(t):
    return AU.approval_rates(V.audit_events(t))


@query("error_retry_rates", with_views("""
SELECT agent_id, count(*) AS events, count(*) FILTER (WHERE event_name = 'agent_error') AS errors,
  count(*) FILTER (WHERE event_name = 'agent_retry') AS retries,
  round(count(*) FILTER (WHERE status = 'failed') / count(*), 6) AS failed_share
FROM audit_v GROUP BY agent_id""", *_A))
def q_error_retry_rates(t):
    return AU.error_retry_rates(V.audit_events(t))


@query("model_usage", with_views("""
SELECT tenant_id, model, CAST(timestamp AS DATE) AS day, count(*) AS calls, sum(input_tokens) AS input_tokens,
  sum(output_tokens) AS output_tokens, round(quantile_cont(duration_ms, 0.5), 6) AS p50_ms,
  round(quantile_cont(duration_ms, 0.95), 6) AS p95_ms,
  round(count(request_reference) / count(*), 6) AS evidence_share,
  CAST(sum(input_tokens) * CASE model WHEN 'model-0' THEN 0.000150 ELSE 0.000300 END
    + sum(output_tokens) * CASE model WHEN 'model-0' THEN 0.000600 ELSE 0.001200 END AS DECIMAL(18,6)) AS cost_usd
FROM audit_v WHERE model IS NOT NULL GROUP BY 1, 2, 3""", *_A))
def q_model_usage(t):
    spark = t.spark
    # per-model prices (USD per 1k tokens); a catalogue of models, bounded
    prices = spark.createDataFrame(
        [("model-0", 0.15, 0.6), ("model-1", 0.3, 1.2)],
        "model string, usd_per_1k_input double, usd_per_1k_output double").select(
        "model", F.col("usd_per_1k_input").cast("decimal(10,6)").alias("usd_per_1k_input"),
        F.col("usd_per_1k_output").cast("decimal(10,6)").alias("usd_per_1k_output"))
    return AU.model_usage(V.audit_events(t), prices)


@query("budget_alerts", with_views("""
, daily AS (
  SELECT CAST(timestamp AS DATE) AS day, sum(CAST(input_tokens AS DECIMAL(18,6)) * 0.0001
    + CAST(output_tokens AS DECIMAL(18,6)) * 0.0004) AS cost FROM audit_v WHERE model IS NOT NULL GROUP BY 1),
run AS (SELECT day, date_trunc('month', day)::DATE AS month,
  sum(cost) OVER (PARTITION BY date_trunc('month', day) ORDER BY day) AS running FROM daily)
SELECT month, th AS threshold, min(day) AS first_day
FROM run, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (1.0::DOUBLE)) x(th) WHERE running >= th * 25 GROUP BY month, th""", *_A)
       .replace("\n, daily AS", ",\ndaily AS"))
def q_budget_alerts(t):
    return AU.budget_alerts(V.model_call_costs(t))


@query("evidence_match", """
WITH m AS (SELECT 'EV-' || CAST(event_id // 2 AS VARCHAR) AS evidence_id, 'evt-' || CAST(event_id AS VARCHAR) AS event_id,
  event_id AS eid FROM events WHERE event_type IN ('click', 'error'))
SELECT evidence_id, event_id, 1 AS audit_rows,
  CASE WHEN eid % 10 <> 0 THEN 1 ELSE 0 END + CASE WHEN eid % 25 = 0 THEN 1 ELSE 0 END AS log_rows,
  (CASE WHEN eid % 10 <> 0 THEN 1 ELSE 0 END + CASE WHEN eid % 25 = 0 THEN 1 ELSE 0 END) = 1 AS complete
FROM m""")
def q_evidence_match(t):
    return AU.evidence_match(V.evidence_manifest(t).select("evidence_id", "event_id"), V.audit_events(t),
                             V.call_logs(t))


@query("evidence_gate", """
WITH m AS (SELECT event_id, event_id // 2 AS ev, user_id FROM events WHERE event_type IN ('click', 'error')),
d AS (SELECT ev, count(*) AS n FROM m GROUP BY ev)
SELECT 'EV-' || CAST(m.ev AS VARCHAR) AS evidence_id,
  concat_ws(',', CASE WHEN event_id % 11 = 0 THEN 'bad_sha256' END, CASE WHEN d.n > 1 THEN 'duplicate_id' END,
    CASE WHEN event_id % 13 = 0 THEN 'missing_visibility' END,
    CASE WHEN user_id % 5 = 0 AND event_id % 2 = 0 THEN 'synthetic_as_production' END) AS errors,
  event_id % 11 <> 0 AND d.n = 1 AND event_id % 13 <> 0 AND NOT (user_id % 5 = 0 AND event_id % 2 = 0) AS usable
FROM m JOIN d ON d.ev = m.ev""")
def q_evidence_gate(t):
    return AU.evidence_gate(V.evidence_manifest(t))


@query("request_rate", with_views("""
SELECT date_trunc('day', timestamp) AS window_start, customer_id, count(*) AS events
FROM audit_v GROUP BY ALL HAVING count(*) > 4""", *_A))
def q_request_rate(t):
    return AU.request_rate(V.audit_events(t), limit=4, window="1 day", client="customer_id")


# each agent's windows one after the other: the first request, then the first an hour or more later
@query("request_limits", with_views(""", req AS (SELECT agent_id, epoch_us(timestamp) // 1000 AS t FROM audit_v),
opens AS (SELECT agent_id, min(t) AS s FROM req GROUP BY agent_id
  UNION ALL SELECT o.agent_id, (SELECT min(r.t) FROM req r WHERE r.agent_id = o.agent_id AND r.t >= o.s + 3600000)
  FROM opens o WHERE o.s IS NOT NULL)
SELECT make_timestamp(o.s * 1000) AS window_start, o.agent_id, count(*) AS events, count(*) - 4 AS refused
FROM opens o JOIN req r ON r.agent_id = o.agent_id AND r.t >= o.s AND r.t < o.s + 3600000
GROUP BY o.agent_id, o.s HAVING count(*) > 4""", *_A).replace("WITH", "WITH RECURSIVE", 1))
def q_request_limits(t):
    return RL.limit_windows(V.audit_events(t), limit=4, window_ms=3_600_000, client="agent_id")


@query("health_windows", with_views("""
SELECT time_bucket(INTERVAL 5 MINUTE, timestamp) AS window_start, count(*) AS events,
  round(count(*) FILTER (WHERE status = 'failed') / count(*), 6) AS error_share,
  round(quantile_cont(duration_ms, 0.5), 6) AS p50_ms, max(duration_ms) AS max_ms
FROM audit_v GROUP BY 1""", *_A))
def q_health_windows(t):
    return AU.health_windows(V.audit_events(t))


@query("stage_durations", _CASE_WALK + """,
ok AS (SELECT l.case_id, l.action_no, l.stage,
  o.o_orderdate + l.action_no * INTERVAL 1 HOUR AS entered_at
  FROM log l JOIN orders o ON l.case_id = 'case-' || CAST(o.o_orderkey AS VARCHAR) WHERE l.err IS NULL),
nx AS (SELECT *, lead(entered_at) OVER (PARTITION BY case_id ORDER BY action_no) AS left_at FROM ok)
SELECT case_id, action_no, stage, entered_at, left_at,
  round((epoch_us(left_at) - epoch_us(entered_at)) / 3.6e9, 6) AS hours FROM nx""")
def q_stage_durations(t):
    ident = OI.validate_identifiers(V.identifiers(t))
    log = LC.transition_log(V.cases(t), V.case_actions(t), ident)
    req = V.case_actions(t).select("case_id", "action_no", "requested_at")
    return AU.stage_durations(log, req)


@query("approval_validity", _WF_WALK + """,
ok AS (SELECT contact_id, action_no, action FROM wwalk WHERE rn > 0 AND err IS NULL),
drafts AS (SELECT contact_id, action_no, sha256(CASE WHEN action = 'draft'
  THEN 'Borrador revisado ' || CAST(action_no AS VARCHAR) ELSE '#analysis' END) AS h
  FROM ok WHERE action IN ('analyze', 'draft')),
now_h AS (SELECT contact_id, arg_max(h, action_no) AS h_now FROM drafts GROUP BY 1)
SELECT a.contact_id, a.action_no AS approval_no,
  coalesce((SELECT arg_max(d.h, d.action_no) FROM drafts d WHERE d.contact_id = a.contact_id
    AND d.action_no <= a.action_no) = n.h_now, false) AS valid
FROM ok a LEFT JOIN now_h n ON n.contact_id = a.contact_id WHERE a.action = 'approve'""")
def q_approval_validity(t):
    log, _ = LC.replay_workflows(LC.workflow_state(V.contacts(t), V.stored_workflows(t)), V.workflow_actions(t))
    return AU.approval_validity(log)
