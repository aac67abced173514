"""Identity jobs: whole-table identifier validation (X1-X3), the as-of
registry enrichment (J13) and the public projection of registry answers (F10).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions import identity as ID


def validate_identifiers(df: DataFrame, col: str = "identifier_text", keep: list[str] | None = None) -> DataFrame:
    """Strip spaces and hyphens, classify as cédula / RUC, flag the rest.

    Output: ``keep`` columns + identifier, identifier_type, locally_valid,
    error_code ('invalid_ec_identifier' when neither rule holds).
    """
    keep = keep or []
    clean = ID.strip_separators(F.col(col))
    out = df.select(*keep, clean.alias("identifier"))
    # classify once; the flags below read the result column, so the checksum
    # expression is not repeated per output column
    out = out.select(*keep, "identifier", ID.identifier_type_sql("identifier").alias("identifier_type"))
    kind = F.col("identifier_type")
    return out.select(
        *keep, "identifier", "identifier_type",
        kind.isNotNull().alias("locally_valid"),
        F.when(kind.isNull(), F.lit("invalid_ec_identifier")).alias("error_code"),
    )


def enrich_identity(requests: DataFrame, snapshots: DataFrame, ttl_ms: int) -> DataFrame:
    """As-of join of identity requests with registry snapshots.

    requests:  request_id, identifier (clean), identifier_type, lookup, requested_at
    snapshots: identifier, fetched_at, snapshot_id, found, legal_name, commercial_name, activity

    A request uses the newest snapshot with ``requested_at - ttl < fetched_at
    <= requested_at``.  Cédulas and local lookups never use the registry.

    Plan: time is cut into buckets as long as the TTL, so a fresh snapshot is
    either in the request's bucket or in the one before.  Same-bucket matches
    come from a running ``last`` over (identifier, bucket) on the union of
    both sides; the previous bucket contributes its newest snapshot through
    an equi-join on (identifier, bucket - 1).  No pairs are emitted, and a
    hot identifier is spread over its time buckets.
    """
    ttl_s = ttl_ms / 1000.0
    from caseflow.operators.audit import micros_between
    epoch = micros_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("at")) / 1_000_000
    bucket = F.floor(epoch / F.lit(ttl_s)).cast("bigint")

    use = (F.col("identifier_type") == "ruc") & (F.col("lookup") == "authorized")
    req = requests.select(
        "request_id", "identifier", "identifier_type", "lookup", F.col("requested_at").alias("at"),
        use.alias("uses_registry"))
    snap_struct = F.struct(
        F.col("fetched_at"), F.col("snapshot_id"), F.col("found"), F.col("legal_name"),
        F.col("commercial_name"), F.col("activity"))
    snaps = snapshots.select(
        "identifier", F.col("fetched_at").alias("at"), snap_struct.alias("snap"))

    r = req.where("uses_registry").select(
        "request_id", "identifier", "at", F.lit(1).alias("side"), F.lit(None).cast(snaps.schema["snap"].dataType)
        .alias("snap"))
    s = snaps.select(F.lit(None).cast("string").alias("request_id"), "identifier", "at", F.lit(0).alias("side"),
                     "snap")
    u = r.unionByName(s).withColumn("bucket", bucket)
    # snapshots sort before requests at the same instant (fetched_at <= requested_at)
    w = (Window.partitionBy("identifier", "bucket")
         .orderBy(F.col("at"), F.col("side"), F.col("snap.snapshot_id"))
         .rowsBetween(Window.unboundedPreceding, 0))
    same = u.withColumn("same", F.last("snap", ignorenulls=True).over(w)).where(F.col("side") == 1)
    prev = snaps.withColumn("bucket", bucket + 1).groupBy("identifier", "bucket").agg(
        F.max_by("snap", F.struct(F.col("snap.fetched_at"), F.col("snap.snapshot_id"))).alias("prev"))
    m = same.join(prev, ["identifier", "bucket"], "left")
    lower = F.col("at") - F.expr(f"make_dt_interval(0, 0, 0, {ttl_s:.6f})")
    fresh = lambda c: F.when(F.col(c).isNotNull() & (F.col(c + ".fetched_at") > lower), F.col(c))
    m = m.select("request_id", F.coalesce(fresh("same"), fresh("prev")).alias("hit"))

    out = req.join(m, "request_id", "left")
    hit = F.col("hit")
    status = (
        F.when(~F.col("uses_registry"), "locally_valid")
        .when(hit.isNull(), "unavailable")
        .when(hit["found"], "verified")
        .otherwise("not_found")
    )
    verified = F.col("uses_registry") & hit.isNotNull() & hit["found"]
    return out.select(
        "request_id", "identifier", "identifier_type",
        F.lit(True).alias("locally_valid"),
        F.coalesce(verified, F.lit(False)).alias("registry_verified"),
        F.when(F.coalesce(verified, F.lit(False)), "authorized_registry").otherwise("local_checksum").alias("source"),
        F.when(verified, F.trim(hit["legal_name"])).otherwise(F.lit("")).alias("legal_name"),
        F.when(verified, F.trim(hit["commercial_name"])).otherwise(F.lit("")).alias("commercial_name"),
        F.when(verified, F.trim(hit["activity"])).otherwise(F.lit("")).alias("activity"),
        status.alias("status"),
        F.when(F.col("uses_registry"), hit["snapshot_id"]).alias("snapshot_id"),
        F.col("at").alias("verified_at"),
    )


REGISTRY_ANSWER = (
    "struct<data: struct<main: array<struct<numeroRuc: string, razonSocial: string, nombreComercial: string,"
    " actividadContribuyente: string>>>>"
)


def public_registry(df: DataFrame, payload_col: str = "payload", keep: list[str] | None = None) -> DataFrame:
    """Keep only the three public registry fields (trimmed, '' when absent);
    every other field of the answer is dropped by the declared schema."""
    keep = keep or []
    parsed = F.from_json(F.col(payload_col), REGISTRY_ANSWER)
    first = F.try_element_at(parsed["data"]["main"], F.lit(1))
    return df.select(
        *keep,
        F.coalesce(F.trim(first["razonSocial"]), F.lit("")).alias("legal_name"),
        F.coalesce(F.trim(first["nombreComercial"]), F.lit("")).alias("commercial_name"),
        F.coalesce(F.trim(first["actividadContribuyente"]), F.lit("")).alias("activity"),
    )
