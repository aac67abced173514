"""Rule sets, one query per entity.

Every rule gets rows that break it: of an entity whose rows carry a number
``_k``, those with ``_k % m = i`` have one column replaced so that they break
rule ``i`` and no other.  The oracle knows the numbers only, so a rule that is
missing, too weak or too strict turns its query red.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow import schemas as K
from caseflow.functions import validate as VA
from caseflow.operators.lifecycle import playbook_steps
from caseflow.plans import views as V
from caseflow.plans.registry import query

_LONG = "repeat('x', {n})".format


def _key(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("_k", F.substring_index(column, "-", -1).cast("bigint"))


def _hex_key(df: DataFrame) -> DataFrame:
    return df.withColumn("_k", F.conv(F.substring("id", 1, 7), 16, 10).cast("bigint"))


def _uuid(column: str):
    return F.regexp_replace(F.substring(F.sha2(F.col(column), 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$",
                            "$1-$2-$3-$4-$5")


def _broken(df: DataFrame, breaks: list[tuple[str, str, str]]) -> DataFrame:
    """Replace ``column`` by the SQL value in the rows of each break."""
    m = len(breaks) + 3
    by: dict[str, list[tuple[int, str]]] = {}
    for i, (_, column, value) in enumerate(breaks, 1):
        by.setdefault(column, []).append((i, value))
    kinds = {f.name: f.dataType for f in df.schema.fields}
    changed = {}
    for column, parts in by.items():
        new = F.col(column)
        for i, value in parts:
            new = F.when(F.col("_k") % m == i, F.expr(value).cast(kinds[column])).otherwise(new)
        changed[column] = new
    return df.withColumns(changed)


def _sql(entity: str, numbers: str, breaks: list[tuple[str, str, str]]) -> str:
    m = len(breaks) + 3
    parts = [f"SELECT '{entity}' AS entity, '_rows' AS error_code, count(*) AS rows FROM b"]
    parts += [f"SELECT '{entity}', '{code}', count(*) FROM b WHERE k % {m} = {i} HAVING count(*) > 0"
              for i, (code, _, _) in enumerate(breaks, 1)]
    return f"WITH b AS ({numbers})\n" + "\nUNION ALL ".join(parts)


def _register(entity: str, frame, rules, numbers: str, breaks: list[tuple[str, str, str]]):
    @query(f"validate_{entity}", _sql(entity, numbers, breaks))
    def run(t):
        return VA.rule_counts(_broken(frame(t), breaks), rules(), entity)
    return run


_CUSTOMERS = "SELECT c_custkey AS k FROM customer"
_ORDERS = "SELECT o_orderkey AS k FROM orders JOIN customer ON o_custkey = c_custkey"
_LINES = """SELECT ('0x' || substr(sha256(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
  CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR))), 1, 7))::INT AS k
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""
_SYSTEMS = """SELECT ('0x' || substr(sha256(concat_ws('|', CAST(l_suppkey AS VARCHAR), CAST(l_partkey AS VARCHAR))), 1, 7))
  ::INT AS k FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)"""


def _events(t):
    e = _key(V.audit_events(t), "event_id")
    return e.withColumns({"event_id": _uuid("event_id"), "human_approval": F.lit("required"),
                          "event_name": F.lit("case_created")})


_register("audit_event", _events, VA.audit_event_rules, "SELECT event_id AS k FROM events", [
    ("event_id", "event_id", "'4b825dc6-42cb-4eb9-a060-e54bf8d69288x'"), ("timestamp_missing", "timestamp", "NULL"),
    ("input_summary", "input_summary", "NULL"), ("decision", "decision", "NULL"), ("result", "result", "NULL"),
    ("event_name", "event_name", "'unheard_of'"), ("tenant_id", "tenant_id", "''"), ("customer_id", "customer_id", "''"),
    ("case_id", "case_id", "''"), ("agent_id", "agent_id", "''"), ("actor_type", "actor_type", "'robot'"),
    ("action", "action", "''"), ("input_tokens", "input_tokens", "-1"), ("output_tokens", "output_tokens", "-1"),
    ("estimated_cost_usd", "estimated_cost_usd", "-1"), ("human_approval", "human_approval", "'maybe'"),
    ("duration_ms", "duration_ms", "-1"), ("status", "status", "'lost'"), ("evidence_version", "evidence_version", "'2.0'")])

_register("analyze_request", lambda t: _key(V.contacts(t), "id").select(
    "_k", "tenant_id", F.col("id").alias("customer_id"), F.concat(F.lit("demo-case-"), F.col("id")).alias("case_id"),
    "playbook", F.lit("form").alias("channel"), F.col("opportunity").alias("message")),
    VA.analyze_request_rules, _CUSTOMERS, [
    ("tenant_id", "tenant_id", "'t'"), ("customer_id", "customer_id", _LONG(n=81)), ("case_id", "case_id", "NULL"),
    ("playbook", "playbook", "'pcdoctor'"), ("message", "message", "'hola'"), ("channel", "channel", "'email'")])


def _analysed(t):
    return _key(V.contacts(t), "id").select("_k", V.analysis_struct(F.col("playbook")).alias("a")).select("_k", "a.*")


@query("validate_case_analysis", _sql("case_analysis", _CUSTOMERS, _ANALYSIS := [
    ("summary", "summary", "NULL"), ("intent", "intent", "NULL"), ("service_family", "service_family", "NULL"),
    ("next_best_action", "next_best_action", "NULL"), ("draft_reply", "draft_reply", "NULL"),
    ("missing_information_member", "missing_information", "array('a', NULL)"), ("urgency", "urgency", "'asap'"),
    ("confidence", "confidence", "1.5"), ("missing_information", "missing_information", "NULL"),
    ("requires_human_approval", "requires_human_approval", "NULL")]))
def q_validate_case_analysis(t):
    """V3: the analysis of a case, field by field."""
    rows = _broken(_analysed(t), _ANALYSIS)
    a = rows.select(F.struct(*[c for c in rows.columns if c != "_k"]).alias("a"))
    codes = a.select(F.explode(F.array_union(F.array(F.lit("_rows")), F.array_compact(VA.case_analysis_errors(F.col("a")))))
                     .alias("error_code"))
    return codes.groupBy("error_code").agg(F.count("*").alias("rows")).select(F.lit("case_analysis").alias("entity"),
                                                                            "error_code", "rows")


_register("demo_workflow", lambda t: _key(V.stored_workflows(t), "id").withColumn(
    "tenant_id", F.when(F.col("playbook") == "iapro", "iapro-demo").otherwise("studio-demo")),
    VA.demo_workflow_rules, _CUSTOMERS + " WHERE c_custkey % 3 = 0", [
    ("tenant_id", "tenant_id", "'tenant-1'"), ("id", "id", "'x'"), ("contact_id", "contact_id", _LONG(n=81)),
    ("playbook", "playbook", "'pcdoctor'"), ("status", "status", "'done'"), ("synthetic", "synthetic", "false"),
    ("outbound_allowed", "outbound_allowed", "true"), ("invoice_issued", "invoice_issued", "NULL"),
    ("approval_status", "approval_status", "'asked'"), ("billing_status", "billing_status", "'paid'"),
    ("draft_reply", "draft_reply", _LONG(n=601)),
    ("analysis", "analysis", "named_struct('summary', '', 'intent', '', 'urgency', 'asap', 'service_family', '', "
     "'missing_information', array(''), 'next_best_action', '', 'draft_reply', '', 'requires_human_approval', true, "
     "'confidence', 0.5D)")])

_register("draft_update", lambda t: _key(V.contacts(t), "id").select("_k", F.lit("  un borrador ").alias("draft_reply")),
          VA.draft_update_rules, _CUSTOMERS, [("draft_reply", "draft_reply", "'  hola   '")])

_register("tenant", lambda t: _key(V.tenants(t), "id"), VA.tenant_rules, "SELECT n_nationkey AS k FROM nation", [
    ("id", "id", "'t1'"), ("slug", "slug", "'Con Espacio'"), ("legal_name", "legal_name", "'N'"),
    ("display_name", "display_name", _LONG(n=121)), ("playbook", "playbook", "'none'"), ("status", "status", "'closed'"),
    ("environment", "environment", "'local'")])

_register("user_profile", lambda t: _key(V.users(t), "uid"), VA.user_rules, _CUSTOMERS, [
    ("uid", "uid", "'u'"), ("email", "email", "'nobody'"), ("display_name", "display_name", _LONG(n=121)),
    ("phone", "phone", _LONG(n=21)), ("tax_id", "tax_id", _LONG(n=14)), ("person_type", "person_type", "'robot'"),
    ("status", "status", "'gone'"), ("legal_name", "legal_name", _LONG(n=181)), ("photo_url", "photo_url", "'no url'"),
    ("email_verified", "email_verified", "NULL"), ("profile_complete", "profile_complete", "NULL")])

_register("membership", lambda t: _key(V.memberships(t), "id"), VA.membership_rules, _CUSTOMERS, [
    ("id", "id", _LONG(n=261)), ("tenant_id", "tenant_id", "'t'"), ("user_id", "user_id", "NULL"),
    ("role", "role", "'guest'"), ("permissions", "permissions", "array('cases.view', 'fly')"),
    ("status", "status", "'pending'")])


def _invitations(t):
    i = V.invitations(t)
    return i.withColumn("_k", F.regexp_extract("email", "([0-9]+)@", 1).cast("bigint"))


_INVITED = _CUSTOMERS + " WHERE c_custkey % 5 = 0"
_register("invitation", _invitations, VA.invitation_rules, _INVITED, [
    ("id", "id", "'x'"), ("tenant_id", "tenant_id", "'t'"), ("email", "email", "'a@b'"), ("role", "role", "'platform_owner'"),
    ("permissions", "permissions", "array('fly')"), ("status", "status", "'lost'"), ("invited_by", "invited_by", "'me'"),
    ("accepted_by", "accepted_by", "'me'")])
_register("invitation_create", lambda t: _invitations(t).withColumn("email", F.concat(F.lit(" "), "email", F.lit(" "))),
          VA.invitation_create_rules, _INVITED, [
    ("email", "email", "'  '"), ("role", "role", "NULL"), ("permissions", "permissions", "array('fly')")])


# published examples of the checksum rules: a natural person's and a company's
# identifier
_PERSON, _COMPANY = "1710034065", "1790016919001"


def _profiles(t):
    company = F.col("_k") % 2 == 0
    return _key(V.users(t), "uid").select(
        "_k", F.concat(F.lit(" "), "display_name").alias("display_name"), "phone",
        F.when(company, _COMPANY).otherwise(_PERSON).alias("tax_id"),
        F.when(company, "company").otherwise("natural").alias("person_type"), "legal_name")


_register("profile_update", _profiles, VA.profile_update_rules, _CUSTOMERS, [
    ("invalid_ec_identifier", "tax_id", "CASE WHEN _k % 2 = 0 THEN '1790016919002' ELSE '1710034066' END"),
    ("display_name", "display_name", "'  N '"), ("phone", "phone", "'12-34'"),
    ("person_type", "person_type", "'robot'"), ("legal_name", "legal_name", _LONG(n=181))])


@query("validate_profile_company", """
SELECT 'profile_company' AS entity, '_rows' AS error_code, count(*) AS rows FROM customer
UNION ALL SELECT 'profile_company', 'company_ruc_required', count(*) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0
UNION ALL SELECT 'profile_company', 'legal_name_required', count(*) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 5 = 0""")
def q_validate_profile_company(t):
    """V10's rules across fields: a company needs a RUC and a legal name."""
    company = F.col("_k") % 2 == 0
    p = _profiles(t).withColumns({
        "tax_id": F.when(company & (F.col("_k") % 3 == 0), _PERSON).otherwise(F.col("tax_id")),
        "legal_name": F.when(F.col("_k") % 5 == 0, F.lit(" ")).otherwise(F.col("legal_name"))})
    return VA.rule_counts(p, VA.profile_update_rules(), "profile_company")


def _identity_struct(t):
    kinds = {f.name: f.dataType.simpleString() for f in K.IDENTITY_VALIDATION.fields}
    known = {"identifier": f"'{_PERSON}'", "identifier_type": "'cedula'", "locally_valid": "true", "registry_verified": "false",
             "source": "'local_checksum'", "legal_name": "''", "commercial_name": "''", "activity": "''",
             "status": "'locally_valid'"}
    return ", ".join(f"'{n}', CAST({known.get(n, 'NULL')} AS {k})" for n, k in kinds.items())


_register("identity_request", lambda t: _key(V.identity_requests(t), "request_id").withColumn(
    "identifier_text", F.lit(f" {_PERSON} ")), VA.identity_request_rules, _ORDERS, [
    ("identifier", "identifier_text", "' 171003406  '"), ("lookup", "lookup", "'guess'")])
_register("identity_result", lambda t: _key(V.identity_requests(t), "request_id").select(
    "_k", F.expr(f"named_struct({_identity_struct(t)})").alias("i")).select("_k", "i.*"),
    VA.identity_result_rules, _ORDERS, [
    ("identifier", "identifier", "'123'"), ("identifier_type", "identifier_type", "'passport'"),
    ("source", "source", "'hearsay'"), ("status", "status", "'maybe'"), ("legal_name", "legal_name", _LONG(n=181)),
    ("commercial_name", "commercial_name", _LONG(n=181)), ("activity", "activity", _LONG(n=301))])


def _cases(t):
    return _key(V.cases(t), "id").withColumn("identity_validation", F.when(
        F.col("_k") % 2 == 0, F.expr(f"named_struct({_identity_struct(t)})").cast(K.IDENTITY_VALIDATION)))


_CASE_TEXTS = [("customer_id", "customer_id", "'x'"), ("customer_user_id", "customer_user_id", "'x'"),
               ("customer_name", "customer_name", "'x'"), ("title", "title", "'x'"), ("description", "description", "'x'")]
_register("business_case", _cases, VA.business_case_rules, _ORDERS, [
    *_CASE_TEXTS, ("customer_identifier", "customer_identifier", _LONG(n=14)), ("id", "id", "'x'"),
    ("tenant_id", "tenant_id", "'x'"), ("playbook", "playbook", "'none'"), ("current_stage", "current_stage", "'limbo'"),
    ("status", "status", "'limbo'"), ("quote_amount_usd", "quote_amount_usd", "-1"),
    ("quote_approval", "quote_approval", "'maybe'"), ("billing_prepared", "billing_prepared", "NULL"),
    ("invoice_issued", "invoice_issued", "NULL"), ("outbound_allowed", "outbound_allowed", "NULL"),
    ("synthetic", "synthetic", "NULL"), ("assigned_to", "assigned_to", _LONG(n=161)), ("created_by", "created_by", "'me'")])
_register("case_identity", _cases, VA.business_case_rules, _ORDERS, [
    ("identity_validation", "identity_validation", f"named_struct({_identity_struct(None)})".replace("'cedula'", "'passport'"))])
_register("business_case_create", lambda t: _key(V.cases(t), "id").withColumn("title", F.concat(F.lit("  "), "title")),
          VA.business_case_create_rules, _ORDERS, [
    *_CASE_TEXTS, ("customer_identifier", "customer_identifier", _LONG(n=21)), ("assigned_to", "assigned_to", "' x '")])

_register("transition_request", lambda t: _key(V.cases(t), "id").select(
    "_k", F.lit("prepare_quote").alias("action"), F.lit(5).cast("decimal(18,2)").alias("quote_amount_usd"),
    F.lit("local").alias("identity_lookup"), F.lit("").alias("note")), VA.transition_request_rules, _ORDERS, [
    ("action", "action", "'undo'"), ("quote_amount_usd", "quote_amount_usd", "-1"),
    ("identity_lookup", "identity_lookup", "'guess'"), ("note", "note", _LONG(n=1001))])


def _playbooks(t):
    steps = playbook_steps(t.spark).groupBy("playbook").agg(F.collect_list("stage").alias("steps"))
    return _key(V.tenants(t), "id").select("_k", "playbook").join(F.broadcast(steps), "playbook")    # four playbooks


_register("playbook", _playbooks, VA.playbook_rules, "SELECT n_nationkey AS k FROM nation", [
    ("playbook", "playbook", "'none'"), ("steps", "steps", "array('intake')")])

_OWNED = [("id", "id", "'prop-1'"), ("tenant_id", "tenant_id", "'t'"), ("created_by", "created_by", "'me'"),
          ("synthetic", "synthetic", "NULL")]
_SUPPLIERS = "SELECT s_suppkey AS k FROM supplier"
_PROPERTY = [("name", "name", "'x'"), ("property_type", "property_type", "'tent'"), ("city", "city", "'x'"),
             ("address", "address", "'x'"), ("unit_count", "unit_count", "-1"),
             ("administrator_name", "administrator_name", _LONG(n=161))]
_register("managed_property", lambda t: _key(V.properties(t), "id").withColumn("id", _uuid("id")), VA.property_rules, _SUPPLIERS,
          [*_OWNED, *_PROPERTY, ("status", "status", "'sold'"),
           ("administrator_user_id", "administrator_user_id", _LONG(n=161))])
_register("property_create", lambda t: _key(V.properties(t), "id"), VA.property_create_rules, _SUPPLIERS,
          [*_PROPERTY, ("administrator_user_id", "administrator_user_id", "' x '")])


def _children(view):
    return lambda t: _hex_key(view(t)).withColumns({"id": _uuid("id"), "property_id": _uuid("property_id")})


_CHILD = [*_OWNED, ("property_id", "property_id", "'prop-1'")]
_SYSTEM = [("system_type", "system_type", "'magic'"), ("name", "name", "'x'"), ("condition", "condition", "'fine'"),
           ("inventory_count", "inventory_count", "-1"), ("notes", "notes", _LONG(n=2001))]
_ISSUE = [("category", "category", "'magic'"), ("title", "title", "'x'"), ("description", "description", "'x'"),
          ("priority", "priority", "'asap'"), ("source", "source", "'hearsay'")]
_COMMITMENT = [("commitment_type", "commitment_type", "'party'"), ("title", "title", "'x'"),
               ("notes", "notes", _LONG(n=2001))]
_register("property_system", _children(V.systems), VA.system_rules, _SYSTEMS, [*_CHILD, *_SYSTEM])
_register("system_create", _children(V.systems), VA.system_create_rules, _SYSTEMS, _SYSTEM)
_register("property_issue", _children(V.issues), VA.issue_rules, _LINES,
          [*_CHILD, *_ISSUE, ("status", "status", "'lost'"), ("assigned_to", "assigned_to", _LONG(n=161))])
_register("issue_create", _children(V.issues), VA.issue_create_rules, _LINES,
          [*_ISSUE, ("assigned_to", "assigned_to", "' x '")])
_register("property_commitment", _children(V.commitments), VA.commitment_rules, _LINES,
          [*_CHILD, *_COMMITMENT, ("status", "status", "'lost'"), ("owner_user_id", "owner_user_id", _LONG(n=161))])
_register("commitment_create", _children(V.commitments), VA.commitment_create_rules, _LINES,
          [("property_id", "property_id", "'prop-1'"), *_COMMITMENT, ("owner_user_id", "owner_user_id", "' x '")])
