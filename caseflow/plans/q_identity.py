"""Identity queries: X1-X3 validation, J13 as-of enrichment, F10 projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.functions import identity as ID
from caseflow.operators import identity as OI
from caseflow.plans import views as V
from caseflow.plans.registry import query

# DuckDB restatement of the identifier view and both checksum rules.
_IDENT_CTE = """
raw_ids AS (
  SELECT c_custkey,
    lpad(CAST(c_custkey % 26 AS VARCHAR), 2, '0')
    || CAST(CASE WHEN c_custkey % 8 = 7 THEN 9 ELSE c_custkey % 8 END AS VARCHAR)
    || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') || CAST((c_custkey // 3) % 10 AS VARCHAR)
    || CASE WHEN c_custkey % 3 = 0 THEN '001' ELSE '' END AS raw
  FROM customer),
ident AS (
  SELECT c_custkey,
    CASE WHEN c_custkey % 7 = 0 THEN substr(raw, 1, 2) || '-' || substr(raw, 3, 7) || '-' || substr(raw, 10)
      ELSE raw END AS identifier_text
  FROM raw_ids),
clean AS (
  SELECT c_custkey, identifier_text, regexp_replace(identifier_text, '[\\s\\x{00A0}-]', '', 'g') AS identifier
  FROM ident),
dg AS (
  SELECT *, CAST(substr(identifier, 1, 2) AS INTEGER) AS prov, CAST(substr(identifier, 3, 1) AS INTEGER) AS third,
    ascii(substr(identifier, 1, 1)) - 48 AS d1,
    ascii(substr(identifier, 2, 1)) - 48 AS d2,
    ascii(substr(identifier, 3, 1)) - 48 AS d3,
    ascii(substr(identifier, 4, 1)) - 48 AS d4,
    ascii(substr(identifier, 5, 1)) - 48 AS d5,
    ascii(substr(identifier, 6, 1)) - 48 AS d6,
    ascii(substr(identifier, 7, 1)) - 48 AS d7,
    ascii(substr(identifier, 8, 1)) - 48 AS d8,
    ascii(substr(identifier, 9, 1)) - 48 AS d9,
    ascii(substr(identifier, 10, 1)) - 48 AS d10,
    ascii(substr(identifier, 11, 1)) - 48 AS d11,
    ascii(substr(identifier, 12, 1)) - 48 AS d12,
    ascii(substr(identifier, 13, 1)) - 48 AS d13
  FROM clean WHERE regexp_full_match(identifier, '[0-9]{10}([0-9]{3})?')),
ck AS (
  SELECT *,
    (10 - ((CASE WHEN d1*2 > 9 THEN d1*2 - 9 ELSE d1*2 END) + d2 + (CASE WHEN d3*2 > 9 THEN d3*2 - 9 ELSE d3*2 END) + d4 + (CASE WHEN d5*2 > 9 THEN d5*2 - 9 ELSE d5*2 END) + d6 + (CASE WHEN d7*2 > 9 THEN d7*2 - 9 ELSE d7*2 END) + d8 + (CASE WHEN d9*2 > 9 THEN d9*2 - 9 ELSE d9*2 END)) % 10) % 10 AS ced_check,
    11 - ((d1*3 + d2*2 + d3*7 + d4*6 + d5*5 + d6*4 + d7*3 + d8*2) % 11) AS pub_r,
    11 - ((d1*4 + d2*3 + d3*2 + d4*7 + d5*6 + d6*5 + d7*4 + d8*3 + d9*2) % 11) AS prv_r
  FROM dg),
typed AS (
  SELECT c.c_custkey, c.identifier,
    CASE
      WHEN length(c.identifier) = 10 AND k.prov BETWEEN 1 AND 24 AND k.third <= 5 AND k.ced_check = k.d10
        THEN 'cedula'
      WHEN length(c.identifier) = 13 AND (k.prov BETWEEN 1 AND 24 OR k.prov = 30) AND (
        (k.third <= 5 AND k.ced_check = k.d10 AND k.prov BETWEEN 1 AND 24 AND ends_with(c.identifier, '001'))
        OR (k.third = 6 AND (CASE WHEN k.pub_r = 11 THEN 0 ELSE k.pub_r END) = k.d9
            AND ends_with(c.identifier, '0001'))
        OR (k.third = 9 AND (CASE WHEN k.prv_r = 11 THEN 0 ELSE k.prv_r END) = k.d10
            AND ends_with(c.identifier, '001')))
        THEN 'ruc'
    END AS identifier_type
  FROM clean c LEFT JOIN ck k ON c.c_custkey = k.c_custkey)"""


def ident_sql(body: str) -> str:
    return "WITH " + _IDENT_CTE.strip() + "\n" + body


@query("validate_identifiers", ident_sql("""
SELECT 'user-' || CAST(c_custkey AS VARCHAR) AS user_id, identifier, identifier_type,
  identifier_type IS NOT NULL AS locally_valid,
  CASE WHEN identifier_type IS NULL THEN 'invalid_ec_identifier' END AS error_code
FROM typed"""))
def q_validate_identifiers(t):
    return OI.validate_identifiers(V.identifiers(t), keep=["user_id"])


@query("identifier_summary", ident_sql("""
SELECT CASE WHEN length(identifier) = 13 THEN 13 ELSE 10 END AS digits,
  coalesce(identifier_type, 'invalid') AS outcome, count(*) AS n
FROM typed GROUP BY ALL"""))
def q_identifier_summary(t):
    v = OI.validate_identifiers(V.identifiers(t))
    return v.groupBy(F.when(F.length("identifier") == 13, 13).otherwise(10).alias("digits"),
                     F.coalesce(F.col("identifier_type"), F.lit("invalid")).alias("outcome")) \
        .agg(F.count("*").alias("n"))


_TTL_MS = 86_400_000  # the longest cache lifetime the service allows (24 h)


def _requests(t):
    r = V.identity_requests(t)
    v = OI.validate_identifiers(r, keep=["request_id", "lookup", "requested_at"])
    return v.where("locally_valid").select("request_id", "identifier", "identifier_type", "lookup", "requested_at")


@query("enrich_identity", ident_sql(f"""
, req AS (
  SELECT 'req-' || CAST(o.o_orderkey AS VARCHAR) AS request_id, ty.identifier, ty.identifier_type,
    CASE WHEN o.o_custkey % 2 = 0 THEN 'authorized' ELSE 'local' END AS lookup,
    o.o_orderdate + INTERVAL 12 HOUR AS requested_at
  FROM orders o JOIN typed ty ON o.o_custkey = ty.c_custkey WHERE ty.identifier_type IS NOT NULL),
snap AS (
  SELECT cl.identifier, o.o_orderdate + (o.o_orderkey % 48) * INTERVAL 1 HOUR AS fetched_at,
    'snap-' || CAST(o.o_orderkey AS VARCHAR) AS snapshot_id, o.o_orderstatus <> 'P' AS found,
    trim(c.c_name) AS legal_name, 'Comercial ' || CAST(o.o_custkey AS VARCHAR) AS commercial_name
  FROM orders o JOIN clean cl ON o.o_custkey = cl.c_custkey JOIN customer c ON c.c_custkey = o.o_custkey
  WHERE o.o_orderkey % 3 <> 0),
best AS (
  SELECT r.request_id, s.snapshot_id, s.found, s.legal_name, s.commercial_name,
    row_number() OVER (PARTITION BY r.request_id ORDER BY s.fetched_at DESC, s.snapshot_id DESC) AS rn
  FROM req r JOIN snap s ON s.identifier = r.identifier AND s.fetched_at <= r.requested_at
    AND s.fetched_at > r.requested_at - INTERVAL {_TTL_MS // 1000} SECOND
  WHERE r.identifier_type = 'ruc' AND r.lookup = 'authorized')
SELECT r.request_id, r.identifier, r.identifier_type, true AS locally_valid,
  coalesce(r.identifier_type = 'ruc' AND r.lookup = 'authorized' AND b.found, false) AS registry_verified,
  CASE WHEN r.identifier_type = 'ruc' AND r.lookup = 'authorized' AND b.found THEN 'authorized_registry'
    ELSE 'local_checksum' END AS source,
  CASE WHEN r.identifier_type = 'ruc' AND r.lookup = 'authorized' AND b.found THEN b.legal_name ELSE '' END
    AS legal_name,
  CASE WHEN r.identifier_type = 'ruc' AND r.lookup = 'authorized' AND b.found THEN b.commercial_name ELSE '' END
    AS commercial_name,
  CASE WHEN r.identifier_type = 'ruc' AND r.lookup = 'authorized' AND b.found THEN 'Servicios' ELSE '' END
    AS activity,
  CASE WHEN NOT (r.identifier_type = 'ruc' AND r.lookup = 'authorized') THEN 'locally_valid'
    WHEN b.snapshot_id IS NULL THEN 'unavailable' WHEN b.found THEN 'verified' ELSE 'not_found' END AS status,
  CASE WHEN r.identifier_type = 'ruc' AND r.lookup = 'authorized' THEN b.snapshot_id END AS snapshot_id,
  r.requested_at AS verified_at
FROM req r LEFT JOIN (SELECT * FROM best WHERE rn = 1) b ON r.request_id = b.request_id""".replace(
    "\n, req AS", ",\nreq AS")))
def q_enrich_identity(t):
    return OI.enrich_identity(_requests(t), V.registry_snapshots(t), _TTL_MS)


@query("registry_projection", """
SELECT 'snap-' || CAST(o.o_orderkey AS VARCHAR) AS snapshot_id, trim(c.c_name) AS legal_name,
  'Comercial ' || CAST(o.o_custkey AS VARCHAR) AS commercial_name, 'Servicios' AS activity
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE o.o_orderkey % 3 <> 0""")
def q_registry_projection(t):
    # registry answers rendered from the snapshots, with one private field that
    # must never reach the output
    s = V.registry_snapshots(t)
    payload = F.to_json(F.struct(F.struct(F.array(F.struct(
        F.col("identifier").alias("numeroRuc"), F.col("legal_name").alias("razonSocial"),
        F.col("commercial_name").alias("nombreComercial"), F.col("activity").alias("actividadContribuyente"),
        F.lit("private").alias("identificacionLegal"))).alias("main")).alias("data")))
    return OI.public_registry(s.select("snapshot_id", payload.alias("payload")), keep=["snapshot_id"])
