"""Declared validation rules (V1-V16) as native Column expressions.

``validate(df, rules)`` adds an ``errors`` array built in one pass:
``array_compact(array(when(bad_1, code_1), ...))``.  Good rows have an empty
array; the rest go to quarantine with every broken rule listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow import schemas as K

Rule = tuple[str, Column]

UUID_RE = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
# A pragmatic e-mail shape (local@domain.tld, no spaces).
URL_RE = "^[A-Za-z][A-Za-z0-9+.-]*:[^ ]+$"
EMAIL_RE = "^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$"


def c(name: str) -> Column:
    return F.col(name)


# -- rule builders: each returns the *bad* condition (null-safe) -------------
# A rule on a plain column name is returned as SQL text and a whole rule set
# becomes one expression (one JVM call while the plan is built); a rule on a
# computed Column stays a Column.


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _lits(values) -> str:
    return ", ".join("'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def _sql_or_col(col, sql_fn, col_fn):
    return sql_fn(_q(col)) if isinstance(col, str) else col_fn(col)


def _nullable(sql: str, q: str, nullable: bool) -> str:
    return f"NOT coalesce(({sql}){f' OR {q} IS NULL' if nullable else ''}, false)"


def bad_enum(col, values: list[str], nullable: bool = False):
    def cf(c):
        ok = c.isin(*values) | (F.lit(nullable) & c.isNull())
        return ~F.coalesce(ok, F.lit(False))
    return _sql_or_col(col, lambda q: _nullable(f"{q} IN ({_lits(values)})", q, nullable), cf)


def bad_len(col, lo: int | None = None, hi: int | None = None, nullable: bool = False):
    def sf(q):
        parts = [f"length({q}) >= {lo}" if lo is not None else None, f"length({q}) <= {hi}" if hi is not None else None]
        return _nullable(" AND ".join(p for p in parts if p) or "true", q, nullable)

    def cf(c):
        n = F.length(c)
        ok = F.lit(True)
        if lo is not None:
            ok = ok & (n >= lo)
        if hi is not None:
            ok = ok & (n <= hi)
        return ~F.coalesce(ok, F.lit(nullable))
    return _sql_or_col(col, sf, cf)


def bad_regex(col, pattern: str, nullable: bool = False):
    if "'" in pattern:
        raise ValueError("quote in pattern")
    return _sql_or_col(col, lambda q: _nullable(f"{q} RLIKE r'{pattern}'", q, nullable),
                       lambda c: ~F.coalesce(c.rlike(pattern) | (F.lit(nullable) & c.isNull()), F.lit(False)))


def bad_nonneg(col, nullable: bool = False):
    return _sql_or_col(col, lambda q: _nullable(f"{q} >= 0", q, nullable),
                       lambda c: ~F.coalesce((c >= 0) | (F.lit(nullable) & c.isNull()), F.lit(False)))


def bad_null(col):
    return _sql_or_col(col, lambda q: f"{q} IS NULL", lambda c: c.isNull())


def bad_literal(col, value):
    lit = ("true" if value else "false") if isinstance(value, bool) else f"'{value}'"
    return _sql_or_col(col, lambda q: f"NOT coalesce({q} = {lit}, false)",
                       lambda c: ~F.coalesce(c == F.lit(value), F.lit(False)))


def bad_array_enum(col, values: list[str]):
    return _sql_or_col(col, lambda q: f"coalesce(size(array_except({q}, array({_lits(values)}))) > 0, true)",
                       lambda c: F.coalesce(F.size(F.array_except(c, F.array(*[F.lit(v) for v in values]))) > 0,
                                            F.lit(True)))


def bad_uuid(col, nullable: bool = False):
    return bad_regex(col, UUID_RE, nullable)


def bad_any_null(col: str):
    """A missing array or one with a null member."""
    return f"coalesce(exists({_q(col)}, x -> x IS NULL), true)"


def trimmed(name: str) -> Column:
    from caseflow.functions.text import js_trim
    return js_trim(F.col(name))


def errors(rules: list[Rule]) -> Column:
    """``array_compact(array(CASE WHEN bad THEN code END, ...))`` in one pass."""
    if all(isinstance(bad, str) for _, bad in rules):
        body = ", ".join(f"CASE WHEN {bad} THEN '{code}' END" for code, bad in rules)
        return F.expr(f"array_compact(array({body}))")
    cols = [F.expr(bad) if isinstance(bad, str) else bad for _, bad in rules]
    return F.array_compact(F.array(*[F.when(b, F.lit(code)) for (code, _), b in zip(rules, cols)]))


def validate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    return df.withColumn("errors", errors(rules))


def split(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(good rows without ``errors``, quarantine rows with ``errors``)."""
    v = validate(df, rules)
    return v.where(F.size("errors") == 0).drop("errors"), v.where(F.size("errors") > 0)


def error_counts(df: DataFrame, rules: list[Rule], entity: str) -> DataFrame:
    """Rows per error code (map-side partial aggregate of exploded codes)."""
    v = validate(df, rules).select(F.explode("errors").alias("error_code"))
    return v.groupBy("error_code").agg(F.count("*").alias("rows")).select(
        F.lit(entity).alias("entity"), "error_code", "rows")


def rule_counts(df: DataFrame, rules: list[Rule], entity: str) -> DataFrame:
    """Rows of the entity (code ``_rows``) and rows that break each rule, those
    broken by none left out: one pass with one counter per rule."""
    bad = [(code, F.expr(b) if isinstance(b, str) else b) for code, b in rules]
    one = df.agg(F.count("*").alias("_rows"), *[F.count_if(b).alias(code) for code, b in bad])
    codes = ["_rows", *[code for code, _ in bad]]
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("error_code"), F.col(x).alias("rows")) for x in codes]))
    return one.select(each.alias("x")).where("x.rows > 0").select(F.lit(entity).alias("entity"), "x.error_code", "x.rows")


# -- rule sets ---------------------------------------------------------------


def audit_event_rules(ids: bool = True) -> list[Rule]:  # V1
    """``ids=False`` leaves out the UUID form of the event id, for logs whose
    writers number their events."""
    return [
        *([("event_id", bad_uuid("event_id"))] if ids else []),
        ("input_summary", bad_null("input_summary")),
        ("decision", bad_null("decision")),
        ("result", bad_null("result")),
        ("timestamp_missing", bad_null("timestamp")),
        ("event_id_empty", bad_len("event_id", 1)),
        ("event_name", bad_enum("event_name", K.EVENT_NAMES)),
        ("tenant_id", bad_len("tenant_id", 1)),
        ("customer_id", bad_len("customer_id", 1, nullable=True)),
        ("case_id", bad_len("case_id", 1, nullable=True)),
        ("agent_id", bad_len("agent_id", 1)),
        ("actor_type", bad_enum("actor_type", K.ACTOR_TYPES)),
        ("action", bad_len("action", 1)),
        ("input_tokens", bad_nonneg("input_tokens", nullable=True)),
        ("output_tokens", bad_nonneg("output_tokens", nullable=True)),
        ("estimated_cost_usd", bad_nonneg("estimated_cost_usd", nullable=True)),
        ("human_approval", bad_enum("human_approval", K.HUMAN_APPROVAL_VALUES)),
        ("duration_ms", bad_nonneg("duration_ms")),
        ("status", bad_enum("status", K.EVENT_STATUSES)),
        ("evidence_version", bad_literal("evidence_version", K.EVIDENCE_VERSION)),
    ]


def analyze_request_rules() -> list[Rule]:  # V2
    return [
        ("tenant_id", bad_len("tenant_id", 2, 80)),
        ("customer_id", bad_len("customer_id", 2, 80)),
        ("case_id", bad_len("case_id", 2, 80)),
        ("playbook", bad_enum("playbook", K.ANALYZE_PLAYBOOKS)),
        ("message", bad_len("message", 5, 12000)),
        ("channel", bad_enum("channel", K.ANALYZE_CHANNELS)),
    ]


def case_analysis_errors(a: Column) -> Column:  # V3, on a struct column
    present = a.isNotNull()
    rules = [
        *[(f, F.when(present, a[f].isNull())) for f in
          ("summary", "intent", "service_family", "next_best_action", "draft_reply")],
        ("missing_information_member", F.when(present, F.exists(a["missing_information"], lambda x: x.isNull()))),
        ("urgency", F.when(a.isNotNull(), bad_enum(a["urgency"], K.URGENCIES))),
        ("confidence", F.when(a.isNotNull(), ~F.coalesce(a["confidence"].between(0, 1), F.lit(False)))),
        ("missing_information", F.when(a.isNotNull(), a["missing_information"].isNull())),
        ("requires_human_approval", F.when(a.isNotNull(), a["requires_human_approval"].isNull())),
    ]
    return F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(code)) for code, bad in rules])


def demo_workflow_rules(tenants: bool = True) -> list[Rule]:  # V4
    """``tenants=False`` leaves out the list of the two demo tenants."""
    return [
        *([("tenant_id", bad_enum("tenant_id", K.WORKFLOW_TENANTS))] if tenants else []),
        ("analysis", F.size(F.array_compact(case_analysis_errors(F.col("analysis")))) > 0),
        ("id", bad_len("id", 3, 100)),
        ("contact_id", bad_len("contact_id", 3, 80)),
        ("playbook", bad_enum("playbook", K.ANALYZE_PLAYBOOKS)),
        ("status", bad_enum("status", K.WORKFLOW_STATUSES)),
        ("synthetic", bad_literal("synthetic", True)),
        ("outbound_allowed", bad_literal("outbound_allowed", False)),
        ("invoice_issued", bad_literal("invoice_issued", False)),
        ("approval_status", bad_enum("approval_status", K.APPROVAL_STATUSES)),
        ("billing_status", bad_enum("billing_status", K.WORKFLOW_BILLING_STATUSES)),
        ("draft_reply", bad_len("draft_reply", None, 600)),
    ]


def draft_update_rules(col: str = "draft_reply") -> list[Rule]:  # V5
    from caseflow.functions.text import js_trim
    return [("draft_reply", bad_len(js_trim(c(col)), 5, 600))]


def tenant_rules() -> list[Rule]:  # V6
    return [
        ("id", bad_len("id", 3, 80)),
        ("slug", bad_regex("slug", "^[a-z0-9-]{3,50}$")),
        ("legal_name", bad_len("legal_name", 2, 180)),
        ("display_name", bad_len("display_name", 2, 120)),
        ("playbook", bad_enum("playbook", K.TENANT_PLAYBOOKS)),
        ("status", bad_enum("status", K.TENANT_STATUSES)),
        ("environment", bad_enum("environment", K.TENANT_ENVIRONMENTS)),
    ]


def user_rules() -> list[Rule]:  # V7
    return [
        ("uid", bad_len("uid", 3, 160)),
        ("email", bad_regex("email", EMAIL_RE)),
        ("display_name", bad_len("display_name", None, 120)),
        ("phone", bad_len("phone", None, 20)),
        ("tax_id", bad_len("tax_id", None, 13)),
        ("person_type", bad_enum("person_type", K.PERSON_TYPES, nullable=True)),
        ("status", bad_enum("status", K.USER_STATUSES)),
        ("legal_name", bad_len("legal_name", None, 180)),
        ("photo_url", bad_regex("photo_url", URL_RE, nullable=True)),
        ("email_verified", bad_null("email_verified")),
        ("profile_complete", bad_null("profile_complete")),
    ]


def membership_rules() -> list[Rule]:  # V8
    return [
        ("id", bad_len("id", 3, 260)),
        ("tenant_id", bad_len("tenant_id", 3, 80)),
        ("user_id", bad_len("user_id", 3, 160)),
        ("role", bad_enum("role", K.ROLES)),
        ("permissions", bad_array_enum("permissions", K.PERMISSIONS)),
        ("status", bad_enum("status", K.MEMBERSHIP_STATUSES)),
    ]


def invitation_rules() -> list[Rule]:  # V9
    return [
        ("id", bad_len("id", 3, 260)),
        ("tenant_id", bad_len("tenant_id", 3, 80)),
        ("email", bad_regex("email", EMAIL_RE)),
        ("role", bad_enum("role", K.INVITABLE_ROLES)),
        ("permissions", bad_array_enum("permissions", K.PERMISSIONS)),
        ("status", bad_enum("status", K.INVITATION_STATUSES)),
        ("invited_by", bad_len("invited_by", 3, 160)),
        ("accepted_by", bad_len("accepted_by", 3, 160, nullable=True)),
    ]


def invitation_create_rules() -> list[Rule]:  # V9, the request
    return [
        ("email", bad_regex(trimmed("email"), EMAIL_RE)),
        ("role", bad_enum("role", K.INVITABLE_ROLES)),
        ("permissions", bad_array_enum("permissions", K.PERMISSIONS)),
    ]


def member_update_rules() -> list[Rule]:  # T12, the request
    return [
        ("role", bad_enum("role", K.INVITABLE_ROLES)),
        ("permissions", bad_array_enum("permissions", K.PERMISSIONS)),
        ("status", bad_enum("status", ["active", "suspended"])),
    ]


def profile_update_rules(checksum: bool = True) -> list[Rule]:  # V10
    """``checksum=False``: the form alone, without the tax id's check digit and
    the rule that a company has a RUC."""
    from caseflow.functions.identity import identifier_type_sql
    from caseflow.functions.text import js_trim
    pt = F.col("person_type")
    kind = identifier_type_sql("tax_id")
    return [
        *([("invalid_ec_identifier", kind.isNull()),
           ("company_ruc_required", F.coalesce((pt == "company") & (kind != "ruc"), F.lit(False)))] if checksum else []),
        ("display_name", bad_len(js_trim("display_name"), 2, 120)),
        ("phone", bad_regex(js_trim("phone"), "^\\+?[0-9]{8,15}$")),
        ("tax_id", bad_regex(js_trim("tax_id"), "^([0-9]{10}|[0-9]{13})$")),
        ("person_type", bad_enum(pt, K.PERSON_TYPES)),
        ("legal_name", bad_len(js_trim("legal_name"), None, 180)),
        ("legal_name_required", F.coalesce((pt == "company") & (F.length(js_trim("legal_name")) < 2),
                                           F.lit(False))),
    ]


def identity_result_rules() -> list[Rule]:  # V11
    return [
        ("identifier", bad_regex("identifier", "^([0-9]{10}|[0-9]{13})$")),
        ("identifier_type", bad_enum("identifier_type", K.IDENTIFIER_TYPES)),
        ("source", bad_enum("source", K.IDENTITY_SOURCES)),
        ("status", bad_enum("status", K.IDENTITY_STATUSES)),
        ("legal_name", bad_len("legal_name", None, 180)),
        ("commercial_name", bad_len("commercial_name", None, 180)),
        ("activity", bad_len("activity", None, 300)),
    ]


def identity_request_rules() -> list[Rule]:  # V11, the request
    return [
        ("identifier", bad_len(trimmed("identifier_text"), 10, 20)),
        ("lookup", bad_enum("lookup", K.IDENTITY_LOOKUPS)),
    ]


def _identity_struct_bad(a: Column) -> Column:
    """A stored identity result (a struct column) that breaks V11; null is fine."""
    ok = (a["identifier"].rlike("^([0-9]{10}|[0-9]{13})$") & a["identifier_type"].isin(*K.IDENTIFIER_TYPES)
          & a["source"].isin(*K.IDENTITY_SOURCES) & a["status"].isin(*K.IDENTITY_STATUSES)
          & (F.length(a["legal_name"]) <= 180) & (F.length(a["commercial_name"]) <= 180)
          & (F.length(a["activity"]) <= 300) & a["locally_valid"].isNotNull() & a["registry_verified"].isNotNull())
    return a.isNotNull() & ~F.coalesce(ok, F.lit(False))


def business_case_create_rules() -> list[Rule]:  # V12, the request
    return [
        ("customer_id", bad_len(trimmed("customer_id"), 3, 100)),
        ("customer_user_id", bad_len(trimmed("customer_user_id"), 3, 160, nullable=True)),
        ("customer_name", bad_len(trimmed("customer_name"), 2, 180)),
        ("customer_identifier", bad_len(trimmed("customer_identifier"), None, 20)),
        ("title", bad_len(trimmed("title"), 3, 180)),
        ("description", bad_len(trimmed("description"), 3, 12000)),
        ("assigned_to", bad_len(trimmed("assigned_to"), 3, 160, nullable=True)),
    ]


def business_case_rules() -> list[Rule]:  # V12
    return [
        ("identity_validation", _identity_struct_bad(F.col("identity_validation"))),
        *[(f, bad_null(f)) for f in ("billing_prepared", "invoice_issued", "outbound_allowed", "synthetic")],
        ("assigned_to", bad_len("assigned_to", None, 160, nullable=True)),
        ("created_by", bad_len("created_by", 3, 160)),
        ("id", bad_len("id", 3, 100)),
        ("tenant_id", bad_len("tenant_id", 3, 80)),
        ("playbook", bad_enum("playbook", K.TENANT_PLAYBOOKS)),
        ("customer_id", bad_len("customer_id", 3, 100)),
        ("customer_user_id", bad_len("customer_user_id", 3, 160, nullable=True)),
        ("customer_name", bad_len("customer_name", 2, 180)),
        ("customer_identifier", bad_len("customer_identifier", None, 13)),
        ("title", bad_len("title", 3, 180)),
        ("description", bad_len("description", 3, 12000)),
        ("current_stage", bad_enum("current_stage", K.CASE_STAGES)),
        ("status", bad_enum("status", K.CASE_STATUSES)),
        ("quote_amount_usd", bad_nonneg("quote_amount_usd", nullable=True)),
        ("quote_approval", bad_enum("quote_approval", K.QUOTE_APPROVALS)),
    ]


def transition_request_rules(whole: bool = True) -> list[Rule]:  # V13
    """``whole=False``: for action logs that keep neither lookup nor note."""
    return [
        ("action", bad_enum("action", K.CASE_ACTIONS)),
        ("quote_amount_usd", bad_nonneg("quote_amount_usd", nullable=True)),
        *([("identity_lookup", bad_enum("identity_lookup", K.IDENTITY_LOOKUPS)),
           ("note", bad_len(trimmed("note"), None, 1000))] if whole else []),
    ]


def _owned(ids: bool, parent: bool | None = None) -> list[Rule]:
    """Ids, tenant and owner that all portfolio entities share."""
    return [
        *([("id", bad_uuid("id"))] if ids else []),
        *([("property_id", bad_uuid("property_id", nullable=parent))] if ids and parent is not None else []),
        ("tenant_id", bad_len("tenant_id", 3, 80)),
        ("created_by", bad_len("created_by", 3, 160)),
        ("synthetic", bad_null("synthetic")),
    ]


def property_create_rules() -> list[Rule]:  # V15, the requests
    return [
        ("name", bad_len(trimmed("name"), 2, 160)),
        ("property_type", bad_enum("property_type", K.PROPERTY_TYPES)),
        ("city", bad_len(trimmed("city"), 2, 100)),
        ("address", bad_len(trimmed("address"), 2, 240)),
        ("unit_count", bad_nonneg("unit_count", nullable=True)),
        ("administrator_name", bad_len(trimmed("administrator_name"), None, 160)),
        ("administrator_user_id", bad_len(trimmed("administrator_user_id"), 3, 160, nullable=True)),
    ]


def system_create_rules() -> list[Rule]:
    return [
        ("system_type", bad_enum("system_type", K.SYSTEM_TYPES)),
        ("name", bad_len(trimmed("name"), 2, 160)),
        ("condition", bad_enum("condition", K.SYSTEM_CONDITIONS)),
        ("inventory_count", bad_nonneg("inventory_count")),
        ("notes", bad_len(trimmed("notes"), None, 2000)),
    ]


def issue_create_rules() -> list[Rule]:
    return [
        ("category", bad_enum("category", K.ISSUE_CATEGORIES)),
        ("title", bad_len(trimmed("title"), 3, 180)),
        ("description", bad_len(trimmed("description"), 3, 8000)),
        ("priority", bad_enum("priority", K.ISSUE_PRIORITIES)),
        ("source", bad_enum("source", K.ISSUE_SOURCES)),
        ("assigned_to", bad_len(trimmed("assigned_to"), 3, 160, nullable=True)),
    ]


def commitment_create_rules() -> list[Rule]:
    return [
        ("property_id", bad_uuid("property_id", nullable=True)),
        ("commitment_type", bad_enum("commitment_type", K.COMMITMENT_TYPES)),
        ("title", bad_len(trimmed("title"), 3, 180)),
        ("owner_user_id", bad_len(trimmed("owner_user_id"), 3, 160, nullable=True)),
        ("notes", bad_len(trimmed("notes"), None, 2000)),
    ]


def property_rules(ids: bool = True) -> list[Rule]:  # V15 (property)
    return [
        *_owned(ids),
        ("administrator_name", bad_len("administrator_name", None, 160)),
        ("administrator_user_id", bad_len("administrator_user_id", None, 160, nullable=True)),
        ("name", bad_len("name", 2, 160)),
        ("property_type", bad_enum("property_type", K.PROPERTY_TYPES)),
        ("status", bad_enum("status", K.PROPERTY_STATUSES)),
        ("city", bad_len("city", 2, 100)),
        ("address", bad_len("address", 2, 240)),
        ("unit_count", bad_nonneg("unit_count", nullable=True)),
    ]


def system_rules(ids: bool = True) -> list[Rule]:
    return [
        *_owned(ids, parent=False),
        ("system_type", bad_enum("system_type", K.SYSTEM_TYPES)),
        ("name", bad_len("name", 2, 160)),
        ("condition", bad_enum("condition", K.SYSTEM_CONDITIONS)),
        ("inventory_count", bad_nonneg("inventory_count")),
        ("notes", bad_len("notes", None, 2000)),
    ]


def issue_rules(ids: bool = True) -> list[Rule]:
    return [
        *_owned(ids, parent=False),
        ("assigned_to", bad_len("assigned_to", None, 160, nullable=True)),
        ("category", bad_enum("category", K.ISSUE_CATEGORIES)),
        ("title", bad_len("title", 3, 180)),
        ("description", bad_len("description", 3, 8000)),
        ("priority", bad_enum("priority", K.ISSUE_PRIORITIES)),
        ("status", bad_enum("status", K.ISSUE_STATUSES)),
        ("source", bad_enum("source", K.ISSUE_SOURCES)),
    ]


def commitment_rules(ids: bool = True) -> list[Rule]:
    return [
        *_owned(ids, parent=True),
        ("owner_user_id", bad_len("owner_user_id", None, 160, nullable=True)),
        ("commitment_type", bad_enum("commitment_type", K.COMMITMENT_TYPES)),
        ("title", bad_len("title", 3, 180)),
        ("status", bad_enum("status", K.COMMITMENT_STATUSES)),
        ("notes", bad_len("notes", None, 2000)),
    ]


def contact_rules() -> list[Rule]:  # V16
    return [
        ("id", bad_len("id", 3, 80)),
        ("playbook", bad_enum("playbook", K.CONTACT_PLAYBOOKS)),
        ("environment", bad_literal("environment", "synthetic")),
        ("synthetic", bad_literal("synthetic", True)),
        ("display_name", bad_len("display_name", 2, 120)),
        ("account_name", bad_len("account_name", 2, 160)),
        ("phone", bad_regex("phone", "^\\+593000000[0-9]{3}$")),
        ("email", bad_regex("email", "^[a-z0-9.-]+@example\\.invalid$")),
        ("channel", bad_enum("channel", K.CONTACT_CHANNELS)),
        ("segment", bad_len("segment", 2, 100)),
        ("opportunity", bad_len("opportunity", 2, 160)),
        ("next_action", bad_len("next_action", 2, 200)),
        ("estimated_value_usd", bad_nonneg("estimated_value_usd")),
        ("priority", bad_enum("priority", K.CONTACT_PRIORITIES)),
        ("status", bad_enum("status", K.CONTACT_STATUSES)),
        ("consent_status", bad_literal("consent_status", "not_applicable_synthetic")),
        ("outbound_allowed", bad_literal("outbound_allowed", False)),
        ("billing_state", bad_enum("billing_state", K.CONTACT_BILLING_STATES)),
    ]


def playbook_rules() -> list[Rule]:  # V14, on (playbook, steps array)
    return [
        ("playbook", bad_enum("playbook", K.TENANT_PLAYBOOKS)),
        ("steps", ~F.coalesce(F.size("steps") == len(K.CASE_STAGES), F.lit(False))),
    ]
