"""Declared schemas and the fixed value lists every operator shares.

Everything under "Fixed values" must equal the service contract this library
re-implements: enum members, permission names, role defaults, playbook steps
and the constant analysis per playbook. They are stated here once, in their
natural order, and every operator, view and test imports them from here.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must match the service contract exactly)
# ---------------------------------------------------------------------------

EVENT_NAMES = [
    "customer_created",
    "contact_import_completed",
    "case_created",
    "media_received",
    "gemini_analysis_completed",
    "inspection_plan_generated",
    "inspection_completed",
    "findings_structured",
    "technical_recommendation_generated",
    "quote_generated",
    "human_approval_requested",
    "human_approval_completed",
    "quote_sent",
    "customer_followup_sent",
    "quote_accepted",
    "service_scheduled",
    "technician_assigned",
    "service_completed",
    "delivery_report_generated",
    "invoice_created",
    "billing_item_prepared",
    "payment_received",
    "agent_error",
    "agent_retry",
    "agent_decision_completed",
    "user_registered",
    "tenant_created",
    "member_invited",
    "member_permissions_updated",
    "identity_validation_completed",
    "workflow_transition_completed",
    "managed_property_created",
    "property_system_created",
    "property_issue_created",
    "property_commitment_created",
]
ACTOR_TYPES = ["agent", "human", "system", "customer"]
EVENT_STATUSES = ["pending", "completed", "failed", "blocked"]
HUMAN_APPROVAL_VALUES = ["not_required", "required", "approved", "rejected"]

ANALYZE_PLAYBOOKS = ["photography_studio", "iapro"]
ANALYZE_CHANNELS = ["whatsapp", "form", "audio_transcript", "spreadsheet"]
URGENCIES = ["low", "medium", "high"]

WORKFLOW_STATUSES = ["new", "awaiting_approval", "approved", "rejected", "billing_review"]
WORKFLOW_TENANTS = ["studio-demo", "iapro-demo"]
APPROVAL_STATUSES = ["not_requested", "pending", "approved", "rejected"]
WORKFLOW_BILLING_STATUSES = ["none", "ready_for_review"]

ROLES = ["platform_owner", "administrator", "collaborator", "customer"]
INVITABLE_ROLES = ["administrator", "collaborator", "customer"]
PERMISSIONS = [
    "tenant.manage",
    "members.manage",
    "customers.view",
    "customers.manage",
    "cases.view",
    "cases.manage",
    "quotes.view",
    "quotes.manage",
    "quotes.approve",
    "services.view",
    "services.manage",
    "billing.view",
    "billing.prepare",
    "billing.issue",
    "messages.prepare",
    "messages.approve",
    "messages.send",
    "reports.view",
    "audit.view",
    "integrations.manage",
    "portfolio.view",
    "portfolio.manage",
]
# administrator = every permission except the one below; the collaborator
# screen never offers the three listed after it.
ADMIN_EXCLUDED = ["billing.issue"]
NOT_ASSIGNABLE = ["tenant.manage", "members.manage", "billing.issue"]
COLLABORATOR_DEFAULTS = [
    "customers.view",
    "customers.manage",
    "cases.view",
    "cases.manage",
    "quotes.view",
    "quotes.manage",
    "services.view",
    "services.manage",
    "billing.view",
    "billing.prepare",
    "messages.prepare",
    "reports.view",
    "portfolio.view",
    "portfolio.manage",
]
CUSTOMER_DEFAULTS = ["cases.view", "quotes.view", "services.view", "billing.view"]

TENANT_PLAYBOOKS = ["pcdoctor", "iapro", "photography_studio", "condominium_management"]
TENANT_STATUSES = ["active", "suspended"]
TENANT_ENVIRONMENTS = ["staging", "production"]
USER_STATUSES = ["pending_profile", "pending_access", "active", "suspended"]
PERSON_TYPES = ["natural", "company"]
MEMBERSHIP_STATUSES = ["active", "suspended"]
INVITATION_STATUSES = ["pending", "accepted", "revoked"]

IDENTIFIER_TYPES = ["cedula", "ruc"]
IDENTITY_SOURCES = ["local_checksum", "authorized_registry"]
IDENTITY_STATUSES = ["locally_valid", "verified", "not_found", "unavailable"]
IDENTITY_LOOKUPS = ["local", "authorized"]

CASE_STAGES = ["intake", "identity", "discovery", "quote", "approval", "service", "billing", "completed"]
CASE_ACTIONS = [
    "complete_intake",
    "validate_identity",
    "complete_discovery",
    "prepare_quote",
    "approve_quote",
    "reject_quote",
    "complete_service",
    "prepare_billing",
    "close_case",
]
CASE_STATUSES = ["open", "waiting_approval", "active", "billing_review", "completed"]
QUOTE_APPROVALS = ["not_requested", "pending", "approved", "rejected"]
# action -> (required stage, next stage); reject_quote moves approval -> quote.
STAGE_GUARD = {
    "complete_intake": ("intake", "identity"),
    "validate_identity": ("identity", "discovery"),
    "complete_discovery": ("discovery", "quote"),
    "prepare_quote": ("quote", "approval"),
    "approve_quote": ("approval", "service"),
    "reject_quote": ("approval", "quote"),
    "complete_service": ("service", "billing"),
    "prepare_billing": ("billing", "billing"),
    "close_case": ("billing", "completed"),
}
# status set by an accepted action (everything else sets "open")
STATUS_BY_ACTION = {
    "prepare_quote": "waiting_approval",
    "approve_quote": "active",
    "complete_service": "billing_review",
    "prepare_billing": "billing_review",
    "close_case": "completed",
}
TRANSITION_ERRORS = [
    "invalid_case_transition",
    "identity_validation_required",
    "quote_amount_required",
    "billing_preparation_required",
]

PROPERTY_TYPES = ["condominium", "urbanization", "residential_building", "mixed_use", "commercial_complex"]
PROPERTY_STATUSES = ["onboarding", "active", "suspended"]
SYSTEM_TYPES = [
    "electric_fence",
    "fire_detection",
    "fire_suppression",
    "cctv",
    "access_control",
    "alarms",
    "elevators",
    "pumps",
    "generator",
    "water",
    "lighting",
    "gas",
    "gates",
    "intercom",
    "playground",
    "pool",
    "other",
]
SYSTEM_CONDITIONS = ["unknown", "operational", "attention", "critical"]
ISSUE_CATEGORIES = [
    "security",
    "fire_safety",
    "coexistence",
    "maintenance",
    "infrastructure",
    "utilities",
    "finance",
    "collections",
    "legal",
    "governance",
    "communication",
    "staff",
    "supplier",
    "emergency",
    "other",
]
ISSUE_PRIORITIES = ["low", "medium", "high", "critical"]
ISSUE_STATUSES = ["reported", "triaged", "in_progress", "waiting", "closed"]
ISSUE_SOURCES = ["manual", "audio", "email", "whatsapp", "meeting", "system"]
COMMITMENT_TYPES = ["meeting", "task", "deadline", "assembly", "inspection", "payment"]
COMMITMENT_STATUSES = ["scheduled", "done", "cancelled"]

CONTACT_PLAYBOOKS = ["photography_studio", "iapro"]
CONTACT_PRIORITIES = ["high", "medium", "low"]
CONTACT_STATUSES = ["new", "followup_due", "discovery", "approval_required", "billing_review"]
CONTACT_CHANNELS = ["whatsapp", "email", "form", "spreadsheet"]
CONTACT_BILLING_STATES = ["none", "pending_review", "ready_for_review"]

# Column order of the contacts CSV export.
CONTACT_CSV_COLUMNS = [
    "id",
    "tenant_id",
    "playbook",
    "display_name",
    "account_name",
    "phone",
    "email",
    "channel",
    "segment",
    "opportunity",
    "next_action",
    "estimated_value_usd",
    "priority",
    "status",
    "consent_status",
    "outbound_allowed",
    "environment",
    "synthetic",
    "last_interaction_at",
    "due_at",
    "billing_state",
]

# Constant analysis per playbook (the deterministic, model-free decision).
DEMO_ANALYSIS = {
    "photography_studio": {
        "summary": "Cliente solicita información sobre una sesión y necesita seguimiento.",
        "intent": "booking_followup",
        "urgency": "medium",
        "service_family": "photography_session",
        "missing_information": ["Tipo de sesión", "Fecha preferida", "Presupuesto aproximado"],
        "next_best_action": "Solicitar los tres datos faltantes y crear una oportunidad.",
        "draft_reply": "Gracias por escribirnos. Para recomendarte la sesión adecuada, ¿qué tipo de sesión buscas, para qué fecha y qué rango de inversión tienes previsto?",
        "requires_human_approval": True,
        "confidence": 0.91,
    },
    "iapro": {
        "summary": "Organización solicita optimización de un proceso operativo no documentado.",
        "intent": "consulting_discovery",
        "urgency": "medium",
        "service_family": "process_engineering",
        "missing_information": [
            "Proceso actual",
            "Volumen mensual",
            "Personas involucradas",
            "Costo o impacto del problema",
        ],
        "next_best_action": "Abrir diagnóstico y enviar cuestionario de descubrimiento.",
        "draft_reply": "Podemos comenzar con un diagnóstico del proceso. Para delimitarlo necesitamos conocer el flujo actual, su volumen, las áreas involucradas y el impacto que genera.",
        "requires_human_approval": True,
        "confidence": 0.88,
    },
}

# Playbook step labels, one list of eight per playbook in stage order.
PLAYBOOK_LABELS = {
    "pcdoctor": ["Ingreso", "Cliente", "Diagnóstico", "Cotización", "Aprobación", "Servicio técnico", "Facturación", "Cerrado"],
    "iapro": ["Ingreso", "Cliente", "Descubrimiento", "Propuesta", "Aprobación", "Proyecto", "Facturación", "Cerrado"],
    "photography_studio": ["Ingreso", "Cliente", "Necesidad", "Cotización", "Reserva", "Producción", "Facturación", "Cerrado"],
    "condominium_management": ["Ingreso", "Comunidad", "Diagnóstico", "Cotización", "Autorización", "Ejecución", "Facturación", "Cerrado"],
}
# Case status labels and workflow status labels shown on the dashboards.
CASE_STATUS_LABELS = {
    "open": "En preparación",
    "waiting_approval": "Esperando aprobación",
    "active": "En ejecución",
    "billing_review": "Revisión de cobro",
    "completed": "Cerrado",
}
WORKFLOW_STATUS_LABELS = {
    "new": "Sin analizar",
    "awaiting_approval": "Por aprobar",
    "approved": "Aprobado",
    "rejected": "Devuelto",
    "billing_review": "Revisar cobro",
}
PRIORITY_LABELS = {"high": "Alta", "medium": "Media", "low": "Baja"}

# Redaction tags and the bounded message length stored in the audit log.
TAG_EMAIL = "[REDACTED_EMAIL]"
TAG_PHONE = "[REDACTED_PHONE]"
TAG_ID = "[REDACTED_ID]"
REDACT_MAX_LEN = 500

# Request cap per client and minute; identity cache lifetime (ms, default).
REQUEST_LIMIT_PER_MINUTE = 100
IDENTITY_TTL_MS = 900_000
# Page caps of the list calls.
PAGE_CAPS = {"cases": 500, "identity": 500, "portfolio": 500, "events": 100, "contacts": 100, "workflows": 20}
# Monthly budget (USD) and its alert points.
MONTHLY_BUDGET_USD = 25
BUDGET_THRESHOLDS = [0.5, 0.9, 1.0]
EVIDENCE_VERSION = "1.0"

# ---------------------------------------------------------------------------
# Derived lists (computed from the fixed values above)
# ---------------------------------------------------------------------------

ADMIN_DEFAULTS = [p for p in PERMISSIONS if p not in ADMIN_EXCLUDED]
ASSIGNABLE_PERMISSIONS = [p for p in PERMISSIONS if p not in NOT_ASSIGNABLE]
ROLE_DEFAULTS = {
    "platform_owner": list(PERMISSIONS),
    "administrator": ADMIN_DEFAULTS,
    "collaborator": COLLABORATOR_DEFAULTS,
    "customer": CUSTOMER_DEFAULTS,
}

# ---------------------------------------------------------------------------
# Declared StructTypes of the stored entities (snake_case columns)
# ---------------------------------------------------------------------------

S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()
TS = T.TimestampNTZType()
MONEY = T.DecimalType(18, 2)


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


CASE_ANALYSIS = _struct(
    ("summary", S), ("intent", S), ("urgency", S), ("service_family", S),
    ("missing_information", T.ArrayType(S)), ("next_best_action", S), ("draft_reply", S),
    ("requires_human_approval", B), ("confidence", D),
)
IDENTITY_VALIDATION = _struct(
    ("identifier", S), ("identifier_type", S), ("locally_valid", B), ("registry_verified", B),
    ("source", S), ("legal_name", S), ("commercial_name", S), ("activity", S), ("status", S),
    ("verified_at", TS),
)

ENTITY_SCHEMAS: dict[str, T.StructType] = {
    "audit_event": _struct(
        ("timestamp", TS), ("event_id", S), ("event_name", S), ("tenant_id", S), ("customer_id", S),
        ("case_id", S), ("agent_id", S), ("actor_type", S), ("action", S), ("input_summary", S),
        ("decision", S), ("result", S), ("model", S), ("request_reference", S), ("input_tokens", L),
        ("output_tokens", L), ("estimated_cost_usd", MONEY), ("human_approval", S), ("duration_ms", L),
        ("status", S), ("error", S), ("evidence_version", S),
    ),
    "tenant": _struct(
        ("id", S), ("slug", S), ("legal_name", S), ("display_name", S), ("playbook", S), ("status", S),
        ("environment", S), ("created_at", TS), ("updated_at", TS),
    ),
    "user": _struct(
        ("uid", S), ("email", S), ("email_verified", B), ("display_name", S), ("phone", S), ("tax_id", S),
        ("person_type", S), ("legal_name", S), ("photo_url", S), ("status", S), ("profile_complete", B),
        ("created_at", TS), ("updated_at", TS),
    ),
    "membership": _struct(
        ("id", S), ("tenant_id", S), ("user_id", S), ("role", S), ("permissions", T.ArrayType(S)),
        ("status", S), ("created_at", TS), ("updated_at", TS),
    ),
    "invitation": _struct(
        ("id", S), ("tenant_id", S), ("email", S), ("role", S), ("permissions", T.ArrayType(S)),
        ("status", S), ("invited_by", S), ("accepted_by", S), ("created_at", TS), ("updated_at", TS),
    ),
    "business_case": _struct(
        ("id", S), ("tenant_id", S), ("playbook", S), ("customer_id", S), ("customer_user_id", S),
        ("customer_name", S), ("customer_identifier", S), ("title", S), ("description", S),
        ("current_stage", S), ("status", S), ("identity_validation", IDENTITY_VALIDATION),
        ("quote_amount_usd", MONEY), ("quote_approval", S), ("billing_prepared", B), ("invoice_issued", B),
        ("outbound_allowed", B), ("synthetic", B), ("assigned_to", S), ("created_by", S),
        ("created_at", TS), ("updated_at", TS),
    ),
    "demo_workflow": _struct(
        ("id", S), ("contact_id", S), ("tenant_id", S), ("playbook", S), ("status", S), ("synthetic", B),
        ("outbound_allowed", B), ("invoice_issued", B), ("approval_status", S), ("billing_status", S),
        ("analysis", CASE_ANALYSIS), ("draft_reply", S), ("created_at", TS), ("updated_at", TS),
    ),
    "managed_property": _struct(
        ("id", S), ("tenant_id", S), ("name", S), ("property_type", S), ("status", S), ("city", S),
        ("address", S), ("unit_count", L), ("administrator_name", S), ("administrator_user_id", S),
        ("synthetic", B), ("created_by", S), ("created_at", TS), ("updated_at", TS),
    ),
    "property_system": _struct(
        ("id", S), ("tenant_id", S), ("property_id", S), ("system_type", S), ("name", S), ("condition", S),
        ("inventory_count", L), ("last_inspection_at", TS), ("next_inspection_at", TS), ("notes", S),
        ("synthetic", B), ("created_by", S), ("created_at", TS), ("updated_at", TS),
    ),
    "property_issue": _struct(
        ("id", S), ("tenant_id", S), ("property_id", S), ("category", S), ("title", S), ("description", S),
        ("priority", S), ("status", S), ("source", S), ("assigned_to", S), ("due_at", TS), ("synthetic", B),
        ("created_by", S), ("created_at", TS), ("updated_at", TS),
    ),
    "property_commitment": _struct(
        ("id", S), ("tenant_id", S), ("property_id", S), ("commitment_type", S), ("title", S),
        ("starts_at", TS), ("due_at", TS), ("reminder_at", TS), ("owner_user_id", S), ("status", S),
        ("notes", S), ("synthetic", B), ("created_by", S), ("created_at", TS), ("updated_at", TS),
    ),
    "contact": _struct(
        ("id", S), ("tenant_id", S), ("playbook", S), ("environment", S), ("synthetic", B),
        ("display_name", S), ("account_name", S), ("phone", S), ("email", S), ("channel", S),
        ("segment", S), ("opportunity", S), ("next_action", S), ("estimated_value_usd", L),
        ("priority", S), ("status", S), ("consent_status", S), ("outbound_allowed", B),
        ("last_interaction_at", TS), ("due_at", TS), ("billing_state", S),
    ),
}

# Evidence manifest, P&L and transaction register (CSV sources).
EVIDENCE_MANIFEST = _struct(
    ("evidence_id", S), ("captured_at_utc", S), ("environment", S), ("category", S), ("claim_supported", S),
    ("source_system", S), ("customer_id_redacted", S), ("consent_status", S), ("redaction_reviewer", S),
    ("sha256", S), ("commit_sha", S), ("deployment_revision", S), ("model", S), ("request_reference", S),
    ("visibility", S), ("status", S), ("notes", S),
)
PNL_COLUMNS = [
    "month", "revenue_implementation", "revenue_subscription", "revenue_usage", "total_revenue",
    "cogs_gcp", "cogs_vertex_ai", "cogs_whatsapp", "cogs_third_party", "cogs_direct_labor", "total_cogs",
    "gross_profit", "operating_expenses", "net_income", "evidence_ids", "notes",
]
PNL = T.StructType(
    [T.StructField("month", S)]
    + [T.StructField(c, T.DecimalType(18, 2)) for c in PNL_COLUMNS[1:14]]
    + [T.StructField("evidence_ids", S), T.StructField("notes", S)]
)
TRANSACTION_REGISTER = _struct(
    ("transaction_id", S), ("date_utc", S), ("type", S), ("customer_id_redacted", S), ("description", S),
    ("amount_usd", MONEY), ("invoice_reference_redacted", S), ("payment_reference_redacted", S),
    ("bank_reconciled", S), ("evidence_ids", S), ("notes", S),
)
