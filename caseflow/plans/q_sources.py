"""Source/sink queries (S1-S9 not covered elsewhere) and validation counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow import schemas as K
from caseflow.functions import validate as VA
from caseflow.plans import views as V
from caseflow.plans.oracle import with_views
from caseflow.plans.q_identity import _IDENT_CTE
from caseflow.plans.q_metrics import _w
from caseflow.plans.registry import query
from caseflow.sources import io as IO


@query("scan_entity", _w("""
SELECT id, tenant_id FROM contacts WHERE next_action <> '' AND NOT outbound_allowed"""))
def q_scan_entity(t):
    path = IO.landing_path(t.spark, "contacts-table")
    V.contacts(t).write.partitionBy("tenant_id").parquet(path)
    good, _ = IO.read_entity(t.spark, path, K.ENTITY_SCHEMAS["contact"], VA.contact_rules())
    return good.select("id", "tenant_id")


def _envelopes(t):
    c = V.contacts(t)
    env = IO.encode_envelope(c, ["id", "tenant_id"])
    k = F.substring_index("id", "-", -1).cast("bigint")
    # every 50th stored document is cut short (a broken write)
    return env.select("id", "tenant_id", F.when(k % 50 == 0, F.substring("payload", 1, 40))
                      .otherwise(F.col("payload")).alias("payload"))


@query("decode_payload", _w("""
SELECT id, tenant_id, CASE WHEN k % 50 <> 0 THEN estimated_value_usd END AS estimated_value_usd,
  CASE WHEN k % 50 <> 0 THEN status END AS status, k % 50 = 0 AS quarantined FROM contacts"""))
def q_decode_payload(t):
    env = _envelopes(t).withColumnRenamed("id", "doc_id")
    good, bad = IO.decode_payload(env.drop("tenant_id"), K.ENTITY_SCHEMAS["contact"], keep=["doc_id"])
    g = good.select("id", "tenant_id", "estimated_value_usd", "status", F.lit(False).alias("quarantined"))
    b = bad.join(env.select("doc_id", "tenant_id"), "doc_id").select(
        F.col("doc_id").alias("id"), "tenant_id", F.lit(None).cast("bigint").alias("estimated_value_usd"),
        F.lit(None).cast("string").alias("status"), F.lit(True).alias("quarantined"))
    return g.unionByName(b)


@query("encode_envelope", _w("""
SELECT id, tenant_id, id AS key_id, playbook, phone, email, opportunity, next_action, estimated_value_usd, priority,
  status, outbound_allowed, last_interaction_at, due_at FROM contacts"""))
def q_encode_envelope(t):
    """Every contact encoded and decoded again: the round trip gives all fields back."""
    env = IO.encode_envelope(V.contacts(t), ["id", "tenant_id"]).withColumnRenamed("id", "key_id").drop("tenant_id")
    good, _ = IO.decode_payload(env, K.ENTITY_SCHEMAS["contact"], keep=["key_id"])
    return good.select("id", "tenant_id", "key_id", "playbook", "phone", "email", "opportunity", "next_action",
                       "estimated_value_usd", "priority", "status", "outbound_allowed", "last_interaction_at", "due_at")


_CSV_SQL = _w("""
, f AS (SELECT id,
  [id, tenant_id, playbook, display_name, account_name, phone, email,
   CASE k % 4 WHEN 0 THEN 'whatsapp' WHEN 1 THEN 'email' WHEN 2 THEN 'form' ELSE 'spreadsheet' END,
   lower(seg), opportunity, next_action, CAST(estimated_value_usd AS VARCHAR), priority, status,
   'not_applicable_synthetic', CAST(outbound_allowed AS VARCHAR), 'synthetic', 'true',
   strftime(last_interaction_at, '%Y-%m-%dT%H:%M:%S.%gZ'), strftime(due_at, '%Y-%m-%dT%H:%M:%S.%gZ'),
   CASE status WHEN 'billing_review' THEN 'ready_for_review' WHEN 'approval_required' THEN 'pending_review'
     ELSE 'none' END] AS vals
  FROM (SELECT c.*, cu.c_mktsegment AS seg FROM contacts c JOIN customer cu ON cu.c_custkey = c.k))
SELECT 0 AS line_no, '' AS id, 'id,tenant_id,playbook,display_name,account_name,phone,email,channel,segment,'
  || 'opportunity,next_action,estimated_value_usd,priority,status,consent_status,outbound_allowed,environment,'
  || 'synthetic,last_interaction_at,due_at,billing_state' AS line
UNION ALL
SELECT 1, id, array_to_string(list_transform(vals, lambda v: CASE WHEN regexp_matches(v, '[",\\r\\n]')
  THEN '"' || replace(v, '"', '""') || '"' ELSE v END), ',') FROM f""").replace(")\n, f AS", "),\nf AS")


@query("contacts_csv", _CSV_SQL)
def q_contacts_csv(t):
    return IO.contacts_csv_lines(V.contacts(t))


@query("upsert_contacts", _w("""
SELECT id, CASE WHEN k % 10 = 0 THEN estimated_value_usd + 100 ELSE estimated_value_usd END AS estimated_value_usd,
  CASE WHEN k % 10 = 0 THEN 'updated' ELSE status END AS status FROM contacts"""))
def q_upsert_contacts(t):
    c = V.contacts(t)
    k = F.substring_index("id", "-", -1).cast("bigint")
    changed = c.where(k % 10 == 0).withColumn("estimated_value_usd", F.col("estimated_value_usd") + 100) \
        .withColumn("status", F.lit("updated"))
    once = IO.upsert(c, changed, ["id"])
    twice = IO.upsert(once, changed, ["id"])  # re-applying the batch is idempotent
    return twice.select("id", "estimated_value_usd", "status")


@query("evidence_manifest_csv", """
SELECT 'EV-' || CAST(event_id // 2 AS VARCHAR) AS evidence_id, 'api-usage' AS category,
  CASE WHEN user_id % 5 = 0 THEN 'synthetic' ELSE 'production' END AS environment,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE 'internal' END AS visibility
FROM events WHERE event_type IN ('click', 'error')""")
def q_evidence_manifest_csv(t):
    path = IO.landing_path(t.spark, "manifest-csv")
    m = V.evidence_manifest(t)
    cols = [f.name for f in K.EVIDENCE_MANIFEST.fields]
    out = m.select(*[F.col(c) if c in m.columns else F.lit(None).cast("string").alias(c) for c in cols])
    out.write.option("header", True).csv(path)
    back = IO.read_csv(t.spark, path, K.EVIDENCE_MANIFEST)
    return back.select("evidence_id", "category", "environment", "visibility")


# --------------------------------------------------------------------------- validation


@query("validate_contacts", _w("""
SELECT 'contact' AS entity, 'next_action' AS error_code, count(*) AS rows FROM contacts WHERE next_action = ''
UNION ALL SELECT 'contact', 'outbound_allowed', count(*) FROM contacts WHERE outbound_allowed"""))
def q_validate_contacts(t):
    return VA.error_counts(V.contacts(t), VA.contact_rules(), "contact")


@query("validate_audit_events", with_views("""
SELECT 'audit_event' AS entity, 'human_approval' AS error_code, count(*) AS rows FROM audit_v
WHERE human_approval NOT IN ('not_required', 'required', 'approved', 'rejected')
UNION ALL SELECT 'audit_event', 'event_id_empty', 0 WHERE false""", "audit_v"))
def q_validate_audit_events(t):
    return VA.error_counts(V.audit_events(t), VA.audit_event_rules(ids=False), "audit_event")


def _profile_updates(t):
    """Profile forms as users would submit them: tax id from the customer's
    identifier digits; companies (13 digits) sometimes without a legal name."""
    c = t.customer
    digits = V.identifiers(t).select("c_custkey", F.regexp_replace("identifier_text", "[^0-9]", "").alias("tax_id"))
    j = c.join(digits, "c_custkey")
    k = j.c_custkey
    return j.select(
        j.c_name.alias("display_name"),
        F.concat(F.lit("+5939"), F.lpad((k % 100000000).cast("string"), 8, "0")).alias("phone"),
        "tax_id",
        F.when(F.length("tax_id") == 13, "company").otherwise("natural").alias("person_type"),
        F.when(k % 11 == 0, F.lit("")).otherwise(j.c_name).alias("legal_name"))


def _playbook_definitions(t):
    """Each tenant's playbook with its steps (eight per playbook, bounded)."""
    from caseflow.operators.lifecycle import playbook_steps
    steps = F.broadcast(playbook_steps(t.spark))
    tp = V.tenants(t).select(F.col("id").alias("tenant_id"), "playbook")
    return tp.join(steps, "playbook").groupBy("tenant_id", "playbook").agg(
        F.collect_list("stage").alias("steps"))


def _entity_checks(t):
    from caseflow.operators import identity as OI
    sets = [
        ("tenant", V.tenants(t), VA.tenant_rules()),
        ("user", V.users(t), VA.user_rules()),
        ("membership", V.memberships(t), VA.membership_rules()),
        ("invitation", V.invitations(t), VA.invitation_rules()),
        ("business_case", V.cases(t), VA.business_case_rules()),
        ("transition_request", V.case_actions(t), VA.transition_request_rules(whole=False)),
        ("managed_property", V.properties(t), VA.property_rules(ids=False)),
        ("property_system", V.systems(t), VA.system_rules(ids=False)),
        ("property_issue", V.issues(t), VA.issue_rules(ids=False)),
        ("property_commitment", V.commitments(t), VA.commitment_rules(ids=False)),
        ("demo_workflow", V.stored_workflows(t), VA.demo_workflow_rules(tenants=False)),
        ("identity_result", OI.enrich_identity(
            OI.validate_identifiers(V.identity_requests(t), keep=["request_id", "lookup", "requested_at"])
            .where("locally_valid").select("request_id", "identifier", "identifier_type", "lookup", "requested_at"),
            V.registry_snapshots(t), 86_400_000), VA.identity_result_rules()),
        ("analyze_request", V.contacts(t).select(
            F.col("tenant_id"), F.col("id").alias("customer_id"),
            F.concat(F.lit("demo-case-"), F.col("id")).alias("case_id"), "playbook",
            F.when(F.col("channel") == "email", "form").otherwise(F.col("channel")).alias("channel"),
            F.concat(F.col("opportunity"), F.lit(". "), F.col("next_action")).alias("message")),
         VA.analyze_request_rules()),
        ("draft_update", V.workflow_actions(t).where(F.col("action") == "draft"), VA.draft_update_rules()),
        ("profile_update", _profile_updates(t), VA.profile_update_rules(checksum=False)),
        ("playbook", _playbook_definitions(t), VA.playbook_rules()),
    ]
    out = None
    for name, df, rules in sets:
        e = VA.validate(df, rules)
        d = e.select(F.explode(F.array_union(F.array(F.lit("_rows")), F.col("errors"))).alias("error_code")) \
            .groupBy("error_code").agg(F.count("*").alias("rows")).select(F.lit(name).alias("entity"), "*")
        out = d if out is None else out.unionByName(d)
    return out


@query("validate_entities", "WITH " + _IDENT_CTE.strip() + """,
d AS (SELECT (o_orderkey // 7) % 5 = 1 AS is_draft, o_orderkey % 7 = 0 AS short FROM orders)
SELECT 'tenant' AS entity, '_rows' AS error_code, count(*) AS rows FROM nation
UNION ALL SELECT 'user', '_rows', count(*) FROM customer
UNION ALL SELECT 'membership', '_rows', count(*) FROM customer
UNION ALL SELECT 'invitation', '_rows', count(*) FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT 'business_case', '_rows', count(*) FROM orders
UNION ALL SELECT 'transition_request', '_rows', sum(least(o_orderkey % 10, 8))
  + count(*) FILTER (WHERE o_orderkey % 11 = 0 AND o_orderkey % 10 >= 4) + count(*) FILTER (WHERE o_orderkey % 13 = 0)
  FROM orders
UNION ALL SELECT 'managed_property', '_rows', count(*) FROM supplier
UNION ALL SELECT 'property_system', '_rows', count(*) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)
UNION ALL SELECT 'property_issue', '_rows', count(*) FROM lineitem
UNION ALL SELECT 'property_commitment', '_rows', count(*) FROM lineitem
UNION ALL SELECT 'demo_workflow', '_rows', count(*) FROM customer WHERE c_custkey % 3 = 0
UNION ALL SELECT 'identity_result', '_rows', count(*) FROM orders o JOIN typed ty ON ty.c_custkey = o.o_custkey
  WHERE ty.identifier_type IS NOT NULL
UNION ALL SELECT 'analyze_request', '_rows', count(*) FROM customer
UNION ALL SELECT 'draft_update', '_rows', count(*) FROM d WHERE is_draft
UNION ALL SELECT 'draft_update', 'draft_reply', count(*) FROM d WHERE is_draft AND short
UNION ALL SELECT 'profile_update', '_rows', count(*) FROM customer
UNION ALL SELECT 'profile_update', 'legal_name_required', count(*) FROM customer
  WHERE c_custkey % 3 = 0 AND c_custkey % 11 = 0
UNION ALL SELECT 'playbook', '_rows', count(*) FROM nation""")
def q_validate_entities(t):
    return _entity_checks(t)
