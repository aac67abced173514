"""Entity views derived from the driver's tables.

The driver ships TPC-H-like tables, not the service's entities, so each entity
is derived here with arithmetic, CASE and equi-joins only (the same rules are
restated independently in DuckDB SQL in ``plans/oracle.py``).  The operators in
``caseflow.operators`` never see driver tables; they take these entity frames.

All views are lazy: they add projections on top of parquet scans so Catalyst
prunes columns and pushes predicates down into the reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow import schemas as K
from caseflow.functions import literals as L
from caseflow.sources.tables import Tables

AS_OF = "1998-06-01 00:00:00"     # fixed "now" for the 1995-2001 views
EVENTS_AS_OF = "2024-01-15 00:00:00"


def _lits(values) -> str:
    return ", ".join("'" + str(v).replace("'", "\\'") + "'" for v in values)


def pk(values: list, idx_sql: str) -> str:
    """SQL text for values[idx] (zero-based, null when out of range)."""
    return f"try_element_at(array({_lits(values)}), CAST({idx_sql} AS INT) + 1)"


AS_OF_SQL = f"TIMESTAMP_NTZ '{AS_OF}'"


def ts(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def pick(values: list, index: Column) -> Column:
    """values[index] with a zero-based integer column."""
    return L.pick(values, index)


def _s(c: Column) -> Column:
    return c.cast("string")


def row_hash(*cols: Column) -> Column:
    """Deterministic 32-hex id from key columns (sha-256 prefix)."""
    return F.substring(F.sha2(F.concat_ws("|", *[_s(c) for c in cols]), 256), 1, 32)


def role_defaults(role: Column) -> Column:
    """The default permission list of a role (empty for an unknown role)."""
    joined = {r: L.SEP.join(p) for r, p in K.ROLE_DEFAULTS.items()}
    text = L.lookup(role, {r: v.replace(L.SEP, "\u0002") for r, v in joined.items()})
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")) \
        .otherwise(F.split(text, "\u0002"))


# --------------------------------------------------------------------------- identity


def tenants(t: Tables) -> DataFrame:
    return t.nation.selectExpr(
        "concat('tenant-', CAST(n_nationkey AS STRING)) AS id",
        "concat('tenant-', CAST(n_nationkey AS STRING)) AS slug",
        "n_name AS legal_name", "n_name AS display_name",
        f"{pk(K.TENANT_PLAYBOOKS, 'n_nationkey % 4')} AS playbook",
        "CASE WHEN n_nationkey % 7 = 6 THEN 'suspended' ELSE 'active' END AS status",
        "CASE WHEN n_nationkey % 2 = 0 THEN 'production' ELSE 'staging' END AS environment",
        f"{AS_OF_SQL} AS created_at", f"{AS_OF_SQL} AS updated_at")

def identifiers(t: Tables) -> DataFrame:
    """One raw identifier text per customer (some with hyphens, a third RUCs)."""
    raw = ("concat(lpad(CAST(c_custkey % 26 AS STRING), 2, '0'), "
           "CAST(CASE WHEN c_custkey % 8 = 7 THEN 9 ELSE c_custkey % 8 END AS STRING), "
           "lpad(CAST(c_custkey % 1000000 AS STRING), 6, '0'), CAST(floor(c_custkey / 3) % 10 AS STRING), "
           "CASE WHEN c_custkey % 3 = 0 THEN '001' ELSE '' END)")
    return t.customer.selectExpr("c_custkey", f"{raw} AS raw").selectExpr(
        "c_custkey", "concat('user-', CAST(c_custkey AS STRING)) AS user_id",
        "CASE WHEN c_custkey % 7 = 0 THEN concat(substr(raw, 1, 2), '-', substr(raw, 3, 7), '-', substr(raw, 10)) "
        "ELSE raw END AS identifier_text")

def users(t: Tables) -> DataFrame:
    return t.customer.selectExpr(
        "concat('user-', CAST(c_custkey AS STRING)) AS uid",
        "concat('user', CAST(c_custkey AS STRING), '@example.invalid') AS email",
        "true AS email_verified", "c_name AS display_name",
        "concat('+5939', lpad(CAST(c_custkey % 100000000 AS STRING), 8, '0')) AS phone",
        "'' AS tax_id", "CAST(NULL AS STRING) AS person_type", "c_name AS legal_name",
        "CAST(NULL AS STRING) AS photo_url",
        "CASE WHEN c_custkey % 17 = 0 THEN 'suspended' WHEN c_custkey % 3 <> 1 THEN 'pending_access' "
        "ELSE 'pending_profile' END AS status",
        "c_custkey % 3 <> 1 AS profile_complete",
        f"{AS_OF_SQL} AS created_at", f"{AS_OF_SQL} AS updated_at")

def memberships(t: Tables) -> DataFrame:
    roles = "CASE " + " ".join(f"WHEN role = '{r}' THEN array({_lits(p)})" for r, p in K.ROLE_DEFAULTS.items()) + \
        " ELSE CAST(array() AS ARRAY<STRING>) END"
    return t.customer.selectExpr(
        "concat('tenant-', CAST(c_nationkey AS STRING)) AS tenant_id",
        "concat('user-', CAST(c_custkey AS STRING)) AS user_id",
        f"{pk(K.ROLES, 'c_custkey % 4')} AS role",
        "CASE WHEN c_custkey % 17 = 0 THEN 'suspended' ELSE 'active' END AS status",
    ).selectExpr(
        "concat(tenant_id, '__', user_id) AS id", "tenant_id", "user_id", "role", f"{roles} AS permissions", "status",
        f"{AS_OF_SQL} AS created_at", f"{AS_OF_SQL} AS updated_at")

def invitations(t: Tables) -> DataFrame:
    base = "concat('user', CAST(c_custkey AS STRING), '@example.invalid')"
    return t.customer.where("c_custkey % 5 = 0").selectExpr(
        "c_custkey",
        "concat('tenant-', CAST((c_nationkey + c_custkey % 3) % 25 AS STRING)) AS tenant_id",
        f"CASE WHEN c_custkey % 4 = 0 THEN upper({base}) ELSE {base} END AS email",
    ).selectExpr(
        "concat(tenant_id, '__', lower(email)) AS id", "tenant_id", "email",
        f"{pk(K.INVITABLE_ROLES, 'floor(c_custkey / 5) % 3')} AS role",
        "CASE WHEN c_custkey % 10 = 0 THEN CAST(array() AS ARRAY<STRING>) "
        "ELSE array('cases.view', 'quotes.view') END AS permissions",
        "'pending' AS status", "'system' AS invited_by", "CAST(NULL AS STRING) AS accepted_by",
        f"{AS_OF_SQL} AS created_at", f"{AS_OF_SQL} AS updated_at")

# --------------------------------------------------------------------------- contacts, workflows


def contacts(t: Tables) -> DataFrame:
    return t.customer.selectExpr(
        "concat('contact-', CAST(c_custkey AS STRING)) AS id",
        "concat('tenant-', CAST(c_nationkey AS STRING)) AS tenant_id",
        f"{pk(K.CONTACT_PLAYBOOKS, 'c_custkey % 2')} AS playbook",
        "'synthetic' AS environment", "true AS synthetic", "c_name AS display_name",
        "concat('Cuenta ', c_mktsegment, ' ', CAST(c_custkey AS STRING)) AS account_name",
        "concat('+593000000', lpad(CAST(c_custkey % 1000 AS STRING), 3, '0')) AS phone",
        "concat('contact', CAST(c_custkey % 997 AS STRING), '@example.invalid') AS email",
        f"{pk(K.CONTACT_CHANNELS, 'c_custkey % 4')} AS channel",
        "lower(c_mktsegment) AS segment",
        "concat('Oportunidad ', lower(c_mktsegment)) AS opportunity",
        "CASE WHEN c_custkey % 8 = 0 THEN '' ELSE concat('Seguimiento ', CAST(c_custkey AS STRING)) END AS next_action",
        "CAST(floor(abs(c_acctbal)) AS BIGINT) AS estimated_value_usd",
        f"{pk(K.CONTACT_PRIORITIES, 'c_custkey % 3')} AS priority",
        f"{pk(K.CONTACT_STATUSES, 'c_custkey % 5')} AS status",
        "'not_applicable_synthetic' AS consent_status",
        "c_custkey % 23 = 0 AS outbound_allowed",
        f"timestampadd(DAY, -CAST(c_custkey % 90 AS INT), {AS_OF_SQL}) AS last_interaction_at",
        f"timestampadd(DAY, CAST(c_custkey % 30 - 15 AS INT), {AS_OF_SQL}) AS due_at",
        "CASE c_custkey % 5 WHEN 4 THEN 'ready_for_review' WHEN 3 THEN 'pending_review' ELSE 'none' END "
        "AS billing_state",
    )

def analysis_struct(playbook: Column) -> Column:
    """The constant analysis of a playbook as a struct column (two folded
    JSON literals, one per playbook)."""
    import json
    ddl = K.CASE_ANALYSIS.simpleString()
    lits = {pb: F.from_json(F.lit(json.dumps(a)), ddl) for pb, a in K.DEMO_ANALYSIS.items()}
    return F.when(playbook == "photography_studio", lits["photography_studio"]) \
        .when(playbook == "iapro", lits["iapro"])


def stored_workflows(t: Tables) -> DataFrame:
    c = t.customer
    k = c.c_custkey
    status = pick(K.WORKFLOW_STATUSES, F.floor(k / 3) % 5)
    playbook = pick(K.CONTACT_PLAYBOOKS, k % 2)
    analysis = F.when(status != "new", analysis_struct(playbook))
    updated = ts(AS_OF) - F.make_interval(days=(k % 45).cast("int"))
    return c.where(k % 3 == 0).select(
        F.concat(F.lit("demo-case-contact-"), _s(k)).alias("id"),
        F.concat(F.lit("contact-"), _s(k)).alias("contact_id"),
        F.concat(F.lit("tenant-"), _s(c.c_nationkey)).alias("tenant_id"),
        playbook.alias("playbook"),
        status.alias("status"),
        F.lit(True).alias("synthetic"),
        F.lit(False).alias("outbound_allowed"),
        F.lit(False).alias("invoice_issued"),
        F.when(status == "awaiting_approval", "pending").when(status.isin("approved", "billing_review"), "approved")
        .when(status == "rejected", "rejected").otherwise("not_requested").alias("approval_status"),
        F.when(status == "billing_review", "ready_for_review").otherwise("none").alias("billing_status"),
        analysis.alias("analysis"),
        F.coalesce(analysis["draft_reply"], F.lit("")).alias("draft_reply"),
        updated.alias("created_at"),
        updated.alias("updated_at"),
    )


# --------------------------------------------------------------------------- cases


CANONICAL_ACTIONS = [a for a in K.CASE_ACTIONS if a != "reject_quote"]


def cases(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    c = t.customer.select("c_custkey", "c_nationkey", "c_name")
    ids = identifiers(t).select(F.col("c_custkey").alias("ik"), "identifier_text")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner").join(ids, F.col("o_custkey") == F.col("ik"), "inner")
    return j.selectExpr(
        "concat('case-', CAST(o_orderkey AS STRING)) AS id",
        "concat('tenant-', CAST(c_nationkey AS STRING)) AS tenant_id",
        f"{pk(K.TENANT_PLAYBOOKS, 'c_nationkey % 4')} AS playbook",
        "concat('contact-', CAST(o_custkey AS STRING)) AS customer_id",
        "concat('user-', CAST(o_custkey AS STRING)) AS customer_user_id",
        "c_name AS customer_name",
        # case creation keeps the digits of the identifier only
        "regexp_replace(identifier_text, '[^0-9]', '') AS customer_identifier",
        "concat('Orden ', CAST(o_orderkey AS STRING)) AS title",
        "concat('Prioridad ', o_orderpriority) AS description",
        "'intake' AS current_stage", "'open' AS status",
        f"CAST(NULL AS {K.IDENTITY_VALIDATION.simpleString()}) AS identity_validation",
        "CAST(NULL AS DECIMAL(18,2)) AS quote_amount_usd", "'not_requested' AS quote_approval",
        "false AS billing_prepared", "false AS invoice_issued", "false AS outbound_allowed", "true AS synthetic",
        "CAST(NULL AS STRING) AS assigned_to", "'system' AS created_by",
        "o_orderdate AS created_at", "o_orderdate AS updated_at",
    )

def case_actions(t: Tables) -> DataFrame:
    """Ordered action log per case: a prefix of the canonical path, an extra
    reject after the quote for some cases and an early close for others."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    base = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"]
    steps = o.selectExpr(*base, f"posexplode(slice(array({_lits(CANONICAL_ACTIONS)}), 1, "
                               f"CAST(least(o_orderkey % 10, 8) AS INT))) AS (pos, action)") \
        .selectExpr(*base, "CAST((pos + 1) * 10 AS INT) AS action_no", "action")
    reject = o.where("o_orderkey % 11 = 0 AND o_orderkey % 10 >= 4") \
        .selectExpr(*base, "45 AS action_no", "'reject_quote' AS action")
    early = o.where("o_orderkey % 13 = 0").selectExpr(*base, "15 AS action_no", "'close_case' AS action")
    a = steps.unionByName(reject).unionByName(early)
    return a.selectExpr(
        "concat('case-', CAST(o_orderkey AS STRING)) AS case_id",
        "o_custkey AS customer_key",
        "concat('user-', CAST(o_custkey AS STRING)) AS actor_user_id",
        "action_no", "action",
        "CASE WHEN action = 'prepare_quote' AND o_orderkey % 17 <> 0 "
        "THEN CAST(round(o_totalprice, 2) AS DECIMAL(18,2)) END AS quote_amount_usd",
        "timestampadd(HOUR, action_no, o_orderdate) AS requested_at",
    )

# --------------------------------------------------------------------------- audit events, messages


def audit_events(t: Tables) -> DataFrame:
    model_row = "event_type IN ('click', 'error')"
    return t.events.selectExpr(
        "ts AS timestamp",
        "concat('evt-', CAST(event_id AS STRING)) AS event_id",
        "CASE event_type WHEN 'signup' THEN 'customer_created' WHEN 'view' THEN 'case_created' "
        "WHEN 'click' THEN 'agent_decision_completed' "
        "WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'agent_retry' ELSE 'agent_error' END "
        "WHEN 'purchase' THEN 'human_approval_completed' END AS event_name",
        "concat('tenant-', CAST(user_id % 25 AS STRING)) AS tenant_id",
        "concat('contact-', CAST(user_id AS STRING)) AS customer_id",
        "concat('case-', CAST(user_id AS STRING)) AS case_id",
        "concat('agent-', CAST(user_id % 6 AS STRING)) AS agent_id",
        f"CASE WHEN {model_row} THEN 'agent' WHEN event_type = 'purchase' THEN 'human' "
        "WHEN event_type = 'signup' THEN 'customer' ELSE 'system' END AS actor_type",
        "event_type AS action", "'' AS input_summary", "'' AS decision", "'' AS result",
        f"CASE WHEN {model_row} THEN concat('model-', CAST(user_id % 2 AS STRING)) END AS model",
        f"CASE WHEN {model_row} THEN concat('req-', CAST(event_id AS STRING)) END AS request_reference",
        f"CASE WHEN {model_row} THEN CAST(get_json_object(props, '$.k') AS BIGINT) END AS input_tokens",
        f"CASE WHEN {model_row} THEN CAST(get_json_object(props, '$.k') AS BIGINT) * 3 END AS output_tokens",
        "CAST(NULL AS DECIMAL(18,2)) AS estimated_cost_usd",
        "CASE WHEN event_type = 'purchase' THEN "
        f"{pk(['approved', 'edited', 'rejected'], 'event_id % 3')} "
        "WHEN event_type = 'click' THEN 'required' ELSE 'not_required' END AS human_approval",
        "CAST(value * 100 AS BIGINT) AS duration_ms",
        "CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status",
        "CASE WHEN event_type = 'error' THEN 'agent_error' END AS error",
        f"'{K.EVIDENCE_VERSION}' AS evidence_version",
    )

def messages(t: Tables) -> DataFrame:
    d = t.documents.select(
        F.concat(F.lit("doc-"), _s(F.col("doc_id"))).alias("message_id"),
        F.col("source").alias("source"), F.col("text").alias("text"),
    )
    cv = t.conversations.select(
        F.concat(F.lit("conv-"), _s(F.col("conv_id")), F.lit("-"), _s(F.col("turn"))).alias("message_id"),
        F.lit("conversation").alias("source"), F.col("text").alias("text"),
    )
    return d.unionByName(cv)


# --------------------------------------------------------------------------- portfolio


def properties(t: Tables) -> DataFrame:
    s = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    c = t.customer
    k = c.c_custkey
    # smallest / largest active collaborator per nation: a map-side partial
    # aggregate, one tiny row per nation.
    collab = c.where((k % 4 == 2) & (k % 17 != 0)).groupBy("c_nationkey").agg(
        F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi")
    )
    j = s.join(collab, s.s_nationkey == collab.c_nationkey, "left")
    sk = j.s_suppkey
    return j.select(
        F.concat(F.lit("prop-"), _s(sk)).alias("id"),
        F.concat(F.lit("tenant-"), _s(j.s_nationkey)).alias("tenant_id"),
        j.s_name.alias("name"),
        pick(K.PROPERTY_TYPES, sk % 5).alias("property_type"),
        F.when(sk % 9 == 0, "onboarding").otherwise("active").alias("status"),
        F.concat(F.lit("Ciudad "), _s(j.s_nationkey)).alias("city"),
        F.concat(F.lit("Calle "), _s(sk)).alias("address"),
        (sk % 200 + 1).cast("bigint").alias("unit_count"),
        F.lit("").alias("administrator_name"),
        F.when(sk % 2 == 0, F.concat(F.lit("user-"), _s(j.lo))).alias("administrator_user_id"),
        F.lit(True).alias("synthetic"),
        F.when((sk % 3 == 0) & j.hi.isNotNull(), F.concat(F.lit("user-"), _s(j.hi))).otherwise(F.lit("system"))
        .alias("created_by"),
        ts(AS_OF).alias("created_at"),
        ts(AS_OF).alias("updated_at"),
    )


def _supplier_tenant(t: Tables) -> DataFrame:
    return t.supplier.selectExpr("s_suppkey AS sk", "concat('tenant-', CAST(s_nationkey AS STRING)) AS tenant_id")

def systems(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_suppkey", "l_partkey").distinct()
    p = t.part.select("p_partkey", "p_size", "p_name")
    j = li.join(p, li.l_partkey == p.p_partkey, "inner").join(
        _supplier_tenant(t), F.col("l_suppkey") == F.col("sk"), "inner")
    return j.selectExpr(
        "substr(sha2(concat_ws('|', CAST(l_suppkey AS STRING), CAST(l_partkey AS STRING)), 256), 1, 32) AS id",
        "tenant_id", "concat('prop-', CAST(l_suppkey AS STRING)) AS property_id",
        f"{pk(K.SYSTEM_TYPES, 'p_partkey % 17')} AS system_type", "p_name AS name",
        f"{pk(K.SYSTEM_CONDITIONS, 'p_size % 4')} AS condition",
        "CAST(p_size % 5 + 1 AS BIGINT) AS inventory_count",
        "CAST(NULL AS TIMESTAMP_NTZ) AS last_inspection_at", "CAST(NULL AS TIMESTAMP_NTZ) AS next_inspection_at",
        "'' AS notes", "true AS synthetic", "'system' AS created_by",
        f"{AS_OF_SQL} AS created_at", f"{AS_OF_SQL} AS updated_at")

def issues(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_linestatus", "l_shipdate")
    j = li.join(_supplier_tenant(t), li.l_suppkey == F.col("sk"), "inner")
    return j.selectExpr(
        "substr(sha2(concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)), 256), 1, 32) AS id",
        "tenant_id", "concat('prop-', CAST(l_suppkey AS STRING)) AS property_id",
        f"{pk(K.ISSUE_CATEGORIES, 'l_partkey % 15')} AS category",
        "concat('Novedad ', CAST(l_orderkey AS STRING)) AS title",
        "concat('Parte ', CAST(l_partkey AS STRING)) AS description",
        f"{pk(K.ISSUE_PRIORITIES, 'l_orderkey % 4')} AS priority",
        "CASE WHEN l_linestatus = 'F' THEN 'closed' ELSE 'reported' END AS status",
        "'system' AS source", "CAST(NULL AS STRING) AS assigned_to", "l_shipdate AS due_at",
        "true AS synthetic", "'system' AS created_by",
        f"{AS_OF_SQL} AS created_at", f"{AS_OF_SQL} AS updated_at")

def commitments(t: Tables) -> DataFrame:
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    o = t.orders.select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey, "inner").join(
        _supplier_tenant(t), F.col("l_suppkey") == F.col("sk"), "inner")
    return j.selectExpr(
        "substr(sha2(concat_ws('|', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)), 256), 1, 32) AS id",
        "tenant_id",
        "CASE WHEN l_orderkey % 10 <> 0 THEN concat('prop-', CAST(l_suppkey AS STRING)) END AS property_id",
        f"{pk(K.COMMITMENT_TYPES, 'l_orderkey % 6')} AS commitment_type",
        "concat('Compromiso ', CAST(l_orderkey AS STRING)) AS title",
        "CASE WHEN l_orderkey % 5 <> 1 THEN l_shipdate END AS starts_at",
        "o_orderdate AS due_at", "CAST(NULL AS TIMESTAMP_NTZ) AS reminder_at",
        "CAST(NULL AS STRING) AS owner_user_id",
        f"{pk(K.COMMITMENT_STATUSES, 'l_orderkey % 3')} AS status",
        "'' AS notes", "true AS synthetic", "'system' AS created_by",
        f"{AS_OF_SQL} AS created_at", f"{AS_OF_SQL} AS updated_at")

# --------------------------------------------------------------------------- identity registry


def identity_requests(t: Tables) -> DataFrame:
    """One identity check per order, for the ordering customer's identifier,
    twelve hours after the order date; even customers ask the registry."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    i = identifiers(t)
    j = o.join(i, o.o_custkey == i.c_custkey, "inner")
    return j.select(
        F.concat(F.lit("req-"), _s(j.o_orderkey)).alias("request_id"),
        j.identifier_text,
        F.when(j.o_custkey % 2 == 0, "authorized").otherwise("local").alias("lookup"),
        (j.o_orderdate + F.make_interval(hours=F.lit(12))).alias("requested_at"),
    )


def registry_snapshots(t: Tables) -> DataFrame:
    """Registry answers kept over time: one per order not divisible by 3,
    fetched 0-47 hours after the order date; pending orders are 'not found'."""
    o = t.orders.where(F.col("o_orderkey") % 3 != 0).select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    i = identifiers(t)
    c = t.customer.select("c_custkey", "c_name")
    j = o.join(i, o.o_custkey == i.c_custkey, "inner").join(c, o.o_custkey == c.c_custkey, "inner")
    from caseflow.functions.identity import strip_separators
    return j.select(
        strip_separators(j.identifier_text).alias("identifier"),
        (j.o_orderdate + F.make_interval(hours=(j.o_orderkey % 48).cast("int"))).alias("fetched_at"),
        F.concat(F.lit("snap-"), _s(j.o_orderkey)).alias("snapshot_id"),
        (j.o_orderstatus != "P").alias("found"),
        F.concat(F.lit("  "), j.c_name, F.lit(" ")).alias("legal_name"),
        F.concat(F.lit("Comercial "), _s(j.o_custkey)).alias("commercial_name"),
        F.lit("Servicios").alias("activity"),
    )


def model_outputs(t: Tables) -> DataFrame:
    """Stored model answers for agent decisions: a JSON analysis, fenced as
    Markdown for even events, truncated (unparseable) for every 29th."""
    e = t.events.where(F.col("event_type") == "click")
    body = F.to_json(F.struct(
        F.lit("Resumen").alias("summary"),
        F.lit("consulta").alias("intent"),
        pick(["low", "medium", "high", "urgent"], e.event_id % 4).alias("urgency"),
        pick(["photography_session", "process_engineering", "repair"], e.user_id % 3).alias("service_family"),
        F.array(F.lit("Fecha")).alias("missing_information"),
        F.lit("Llamar").alias("next_best_action"),
        F.lit("Hola").alias("draft_reply"),
        F.lit(True).alias("requires_human_approval"),
        F.round(e.value / 20, 4).alias("confidence"),
    ))
    text = F.when(e.event_id % 2 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    text = F.when(e.event_id % 29 == 0, F.substring(text, 1, 20)).otherwise(text)
    return e.select(F.concat(F.lit("evt-"), _s(e.event_id)).alias("event_id"), text.alias("raw_text"))


WORKFLOW_ACTIONS = ["analyze", "draft", "approve", "reject", "billing_review"]


def workflow_actions(t: Tables) -> DataFrame:
    """Reviewer actions on demo workflows: one per order of the contact's
    customer, ordered by order key; every seventh draft is too short."""
    o = t.orders.select("o_orderkey", "o_custkey")
    k = o.o_orderkey
    action = pick(WORKFLOW_ACTIONS, F.floor(k / 7) % 5)
    return o.select(
        F.concat(F.lit("contact-"), _s(o.o_custkey)).alias("contact_id"),
        k.alias("action_no"),
        action.alias("action"),
        F.when(action == "draft", F.when(k % 7 == 0, F.lit(" ok ")).otherwise(
            F.concat(F.lit("Borrador revisado "), _s(k)))).alias("draft_reply"),
    )


def case_lookups(t: Tables) -> DataFrame:
    """Each member looks up one case id, which may belong to another tenant."""
    c = t.customer
    k = c.c_custkey
    return c.select(
        F.concat(F.lit("look-"), _s(k)).alias("request_id"),
        F.concat(F.lit("tenant-"), _s(c.c_nationkey)).alias("tenant_id"),
        F.concat(F.lit("case-"), _s(k * 10 + k % 10)).alias("id"),
    )


def member_updates(t: Tables) -> DataFrame:
    """Update requests by the rules of FIXTURES.md: each nation's first active
    administrator on every seventh customer, requests that no rule set passes,
    owners on owners, and a chain of members who are given rights by the batch,
    use them, and lose them again."""
    c = t.customer.select("c_custkey", "c_nationkey")
    k = c.c_custkey

    def first(cond):
        return F.min(F.when(cond, k))
    per = c.groupBy("c_nationkey").agg(
        first((k % 4 == 1) & (k % 17 != 0)).alias("admin"), first((k % 4 == 0) & (k % 17 != 0)).alias("owner"),
        first(k % 21 == 0).alias("s1"), first(k % 7 == 2).alias("s2"), first(k % 7 == 4).alias("s3"),
        first(k % 7 == 5).alias("s4"))
    seventh = c.where(k % 7 == 0).join(per, "c_nationkey")
    view, manage = F.array(F.lit("cases.view")), F.array(F.lit("cases.view"), F.lit("members.manage"))
    both = F.array(F.lit("cases.view"), F.lit("cases.manage"))
    user = lambda x: F.concat(F.lit("user-"), _s(F.col(x)))

    def rows(df, actor, target, no, role, permissions, status="active"):
        return df.where(F.col(actor).isNotNull() & F.col(target).isNotNull() & no.isNotNull()).select(
            F.concat(F.lit("tenant-"), _s(F.col("c_nationkey"))).alias("tenant_id"), user(target).alias("user_id"),
            user(actor).alias("actor_user_id"), no.cast("bigint").alias("update_no"), F.lit(role).alias("role"),
            permissions.alias("permissions"), (F.lit(status) if isinstance(status, str) else status).alias("status"))

    at, s1 = F.col("c_custkey") * 20, F.col("s1") * 20
    key = F.col("c_custkey")
    parts = [
        rows(seventh, "admin", "c_custkey", at, "customer", view),
        rows(seventh.where(key % 28 == 0), "owner", "c_custkey", at + 5, "customer", view),
        rows(seventh, "admin", "c_custkey", at + 10, "collaborator", F.when(key % 21 == 0, manage).otherwise(both),
             F.when((key % 2 == 0) & (key % 21 != 0), "suspended").otherwise("active")),
        rows(seventh.where(key % 35 == 0), "admin", "c_custkey", at + 12, "platform_owner", both),
        rows(per, "s1", "admin", s1 + 15, "administrator", view),
        rows(per, "s1", "s2", s1 + 16, "collaborator", manage),
        rows(per, "s2", "s3", s1 + 17, "collaborator", manage),
        rows(per, "s3", "s4", s1 + 18, "administrator", manage),
        rows(per, "s4", "s1", s1 + 19, "collaborator", manage, "suspended"),
        rows(per, "s1", "s2", s1 + 21, "customer", view),
        rows(per, "owner", "admin", s1 + 2000, "administrator", manage),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def model_call_costs(t: Tables) -> DataFrame:
    """Estimated cost of every model call from its token counts."""
    a = audit_events(t).where(F.col("model").isNotNull())
    cost = (a.input_tokens.cast("decimal(18,6)") * F.lit(0.0001).cast("decimal(18,6)")
            + a.output_tokens.cast("decimal(18,6)") * F.lit(0.0004).cast("decimal(18,6)"))
    return a.select("timestamp", "event_id", "model", cost.cast("decimal(18,6)").alias("cost_usd"))


def evidence_manifest(t: Tables) -> DataFrame:
    """Evidence index rows for model calls (two calls share an id now and then)."""
    e = t.events.where(F.col("event_type").isin("click", "error"))
    k = e.event_id
    return e.select(
        F.concat(F.lit("EV-"), _s(F.floor(k / 2))).alias("evidence_id"),
        F.concat(F.lit("evt-"), _s(k)).alias("event_id"),
        F.date_format(e.ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured_at_utc"),
        F.when(e.user_id % 5 == 0, "synthetic").otherwise("production").alias("environment"),
        F.lit("api-usage").alias("category"),
        F.when(k % 2 == 0, "production_usage").otherwise("pilot").alias("claim_supported"),
        F.lit("model-api").alias("source_system"),
        F.lit("not_applicable_synthetic").alias("consent_status"),
        F.when(k % 11 == 0, F.lit("pending")).otherwise(F.sha2(e.props, 256)).alias("sha256"),
        F.when(k % 13 == 0, F.lit("")).otherwise(F.lit("internal")).alias("visibility"),
        F.lit("captured").alias("status"),
    )


def call_logs(t: Tables) -> DataFrame:
    """Platform log lines of model calls: some calls never logged, some twice."""
    e = t.events.where(F.col("event_type").isin("click", "error"))
    once = e.where(e.event_id % 10 != 0).select(F.concat(F.lit("evt-"), _s(e.event_id)).alias("event_id"))
    twice = e.where(e.event_id % 25 == 0).select(F.concat(F.lit("evt-"), _s(e.event_id)).alias("event_id"))
    return once.unionByName(twice)
