"""Text queries: X4 redaction, A20 redaction report, X5 normalisation,
X6 model-output parsing, X9 display formatting."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow import schemas as K
from caseflow.functions import text as TX
from caseflow.operators import text as OT
from caseflow.plans import views as V
from caseflow.plans.registry import query

# DuckDB (RE2) restatement: RE2's \b is already the ASCII word boundary.
_E = r"'\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b'"
_P = r"'(?:\+?593|0)[ -]?\d{2}[ -]?\d{3}[ -]?\d{4}\b'"
_I = r"'\b\d{10,13}\b'"

_MSG = """
msgs AS (
  SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS message_id, source, text FROM documents
  UNION ALL
  SELECT 'conv-' || CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), 'conversation', text
  FROM conversations),
red AS (
  SELECT message_id, source, text,
    regexp_replace(text, {e}, '[REDACTED_EMAIL]', 'gi') AS t1 FROM msgs),
red2 AS (SELECT *, regexp_replace(t1, {p}, '[REDACTED_PHONE]', 'g') AS t2 FROM red),
red3 AS (SELECT *, regexp_replace(t2, {i}, '[REDACTED_ID]', 'g') AS t3 FROM red2)""".format(e=_E, p=_P, i=_I)


@query("redact_text", "WITH " + _MSG.strip() + """
SELECT message_id, source, t3 AS redacted, substr(t3, 1, 500) AS summary, length(t3) AS redacted_length, t3 <> text AS changed
FROM red3""")
def q_redact_text(t):
    return OT.redact_messages(V.messages(t))


@query("redaction_report", "WITH " + _MSG.strip() + f"""
SELECT source, count(*) AS messages,
  count(*) FILTER (WHERE t3 <> text) AS messages_changed,
  sum(len(regexp_extract_all(text, {_E}, 0, 'i'))) AS email_matches,
  sum(len(regexp_extract_all(t1, {_P}))) AS phone_matches,
  sum(len(regexp_extract_all(t2, {_I}))) AS id_matches
FROM red3 GROUP BY source""")
def q_redaction_report(t):
    return OT.redaction_report(V.messages(t))


@query("normalize_contacts", """
SELECT 'contact-' || CAST(c_custkey AS VARCHAR) AS id,
  replace(replace(replace(replace('+593000000' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0'), ' ', ''),
    '(', ''), ')', ''), '-', '') AS phone_normalized,
  lower('contact' || CAST(c_custkey % 997 AS VARCHAR) || '@example.invalid') AS email_normalized,
  'tenant-' || CAST(c_nationkey AS VARCHAR) || '__' || lower('contact' || CAST(c_custkey % 997 AS VARCHAR)
    || '@example.invalid') AS contact_key,
  'tenant-' || CAST(c_nationkey AS VARCHAR) || '__user-' || CAST(c_custkey AS VARCHAR) AS membership_key
FROM customer""")
def q_normalize_contacts(t):
    c = V.contacts(t)
    return c.select(
        "id",
        TX.normalize_phone(F.col("phone")).alias("phone_normalized"),
        F.lower(TX.js_trim(F.col("email"))).alias("email_normalized"),
        TX.composite_id(F.col("tenant_id"), F.lower(F.col("email"))).alias("contact_key"),
        TX.composite_id(F.col("tenant_id"), F.regexp_replace(F.col("id"), "^contact-", "user-"))
        .alias("membership_key"),
    )


@query("case_identifier_digits", """
SELECT 'user-' || CAST(c_custkey AS VARCHAR) AS user_id,
  lpad(CAST(c_custkey % 26 AS VARCHAR), 2, '0')
    || CAST(CASE WHEN c_custkey % 8 = 7 THEN 9 ELSE c_custkey % 8 END AS VARCHAR)
    || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') || CAST((c_custkey // 3) % 10 AS VARCHAR)
    || CASE WHEN c_custkey % 3 = 0 THEN '001' ELSE '' END AS customer_identifier
FROM customer""")
def q_case_identifier_digits(t):
    # case creation keeps every digit and drops everything else
    i = V.identifiers(t)
    return i.select("user_id", TX.digits_only(F.col("identifier_text")).alias("customer_identifier"))


@query("parse_model_output", """
WITH m AS (SELECT event_id AS eid, user_id, round(value / 20, 4) AS conf FROM events WHERE event_type = 'click')
SELECT 'evt-' || CAST(eid AS VARCHAR) AS event_id,
  CASE WHEN eid % 29 <> 0 THEN CASE eid % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high'
    ELSE 'urgent' END END AS urgency,
  CASE WHEN eid % 29 <> 0 THEN CASE user_id % 3 WHEN 0 THEN 'photography_session' WHEN 1 THEN 'process_engineering'
    ELSE 'repair' END END AS service_family,
  CASE WHEN eid % 29 <> 0 THEN conf END AS confidence,
  CASE WHEN eid % 29 = 0 THEN 'unparseable'
    ELSE concat_ws(',', CASE WHEN eid % 4 = 3 THEN 'urgency' END, CASE WHEN conf > 1 THEN 'confidence' END) END
    AS errors,
  eid % 29 <> 0 AND eid % 4 <> 3 AND conf <= 1 AS valid
FROM m""")
def q_parse_model_output(t):
    p = OT.parse_model_output(V.model_outputs(t), "raw_text", keep=["event_id"])
    return p.withColumn("errors", F.array_join("errors", ","))


@query("format_metrics", """
SELECT 'demo-case-contact-' || CAST(c_custkey AS VARCHAR) AS id,
  CASE WHEN (c_custkey // 3) % 5 = 0 THEN NULL
    WHEN c_custkey % 2 = 0 THEN '91%' ELSE '88%' END AS confidence_label,
  CASE (c_custkey // 3) % 5 WHEN 0 THEN 'Sin analizar' WHEN 1 THEN 'Por aprobar' WHEN 2 THEN 'Aprobado'
    WHEN 3 THEN 'Devuelto' ELSE 'Revisar cobro' END AS status_label,
  upper(substr(c_name, 1, 1)) AS initials,
  '$' || replace(format('{:,}', CAST(round(abs(c_acctbal)) AS BIGINT)), ',', '.') AS value_label,
  replace(CASE (c_custkey // 3) % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'awaiting_approval' WHEN 2 THEN 'approved'
    WHEN 3 THEN 'rejected' ELSE 'billing_review' END, '_', ' ') AS status_text
FROM customer WHERE c_custkey % 3 = 0""")
def q_format_metrics(t):
    w = V.stored_workflows(t)
    c = t.customer.select(F.concat(F.lit("contact-"), F.col("c_custkey").cast("string")).alias("contact_id"),
                          F.abs(F.col("c_acctbal")).alias("value"), F.col("c_name"))
    j = w.join(c, "contact_id")
    return j.select(
        "id",
        F.when(F.col("analysis").isNotNull(), TX.percent(F.col("analysis.confidence"))).alias("confidence_label"),
        TX.label(F.col("status"), K.WORKFLOW_STATUS_LABELS).alias("status_label"),
        TX.initials(F.col("c_name")).alias("initials"),
        TX.whole_dollars(F.col("value")).alias("value_label"),
        TX.humanize(F.col("status")).alias("status_text"),
    )
