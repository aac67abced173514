"""Case transitions as one fold with two outputs.

A batch of actions changes cases and writes audit rows; both appear together or
not at all.  ``commit_batch`` folds the batch from the stored cases, writes the
changed cases, the audit rows and the judged actions to folders of the batch's
number, and last a row of the commit manifest.  Readers see the batches of the
manifest only, so a batch that failed half-way does not exist; running it again
overwrites its folders.  A batch that is committed is not run again, and an
action that some batch has judged is not judged again by a later one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow import schemas as K
from caseflow.operators.access import latest_per_key
from caseflow.operators.lifecycle import transition_log

CASE = K.ENTITY_SCHEMAS["business_case"]
EVENT = K.ENTITY_SCHEMAS["audit_event"]
JUDGED = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("action_no", T.LongType()),
                       T.StructField("accepted", T.BooleanType()), T.StructField("error", T.StringType())])
MANIFEST = T.StructType([T.StructField(n, T.LongType()) for n in ("cases", "events", "judged")])
_TABLES = {"cases": CASE, "events": EVENT, "judged": JUDGED, "commits": MANIFEST}
_FIRST = -1
# the columns of a case that actions write
WRITTEN = ("customer_identifier", "customer_name", "identity_validation", "current_stage", "status", "quote_approval",
           "quote_amount_usd", "billing_prepared", "updated_at")


def create_store(spark: SparkSession, base: str) -> str:
    """An empty store: every table with an empty batch."""
    for name, schema in _TABLES.items():
        rows = [(0, 0, 0)] if name == "commits" else []
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{base}/{name}/batch={_FIRST}")
    return base


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Committed rows with their ``batch``; the manifest's numbers prune the
    scan to folders of committed batches."""
    def load(n):
        return spark.read.schema(T.StructType([*_TABLES[n].fields, T.StructField("batch", T.LongType())])).parquet(f"{base}/{n}")
    return load(name).join(load("commits").select("batch").distinct(), "batch", "left_semi")


def stored_cases(spark: SparkSession, base: str, cases: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The cases after all committed batches; ``cases`` as they were before.
    Only ``columns`` are carried (all by default): what no action writes comes
    from ``cases``, the rest from the last changed row, if there is one."""
    columns = columns or CASE.fieldNames()
    first = cases.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in CASE.fields)).select(
        "id", *(c for c in columns if c != "id")).dropDuplicates(["id"])
    written = [c for c in columns if c in WRITTEN]
    if not written:
        return first.select(*columns)
    changed = latest_per_key(read_table(spark, base, "cases").select("id", "batch", *written), ["id"], [F.col("batch")])
    changed = changed.select("id", F.col("batch").alias("_batch"), *(F.col(c).alias(f"_{c}") for c in written))
    return first.join(changed, "id", "left").select(*(
        F.when(F.col("_batch").isNull(), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) if c in written else F.col(c)
        for c in columns))


def event_uuid(*parts: Column) -> Column:
    """A UUID (version 8) from the hash of the parts, the same on every run."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("8"), F.substring(h, 14, 3)),
                       F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def status_after(action: Column) -> Column:
    return F.coalesce(*[F.when(action == a, F.lit(s)) for a, s in K.STATUS_BY_ACTION.items()], F.lit("open"))


def write_back(cases: DataFrame, log: DataFrame, identity: DataFrame) -> DataFrame:
    """Cases with at least one accepted action, all columns as the accepted
    actions left them.  An accepted identity check writes the check itself, the
    checked identifier and, if the registry knows one, the legal name."""
    act, ok, no = F.col("action"), F.col("accepted"), F.col("action_no")

    def last(value: Column, cond: Column) -> Column:
        return F.max_by(F.when(ok & cond, value), F.when(ok & cond, no))
    approval = (F.when(act == "prepare_quote", "pending").when(act == "approve_quote", "approved")
                .when(act == "reject_quote", "rejected"))
    agg = log.groupBy("case_id").agg(
        last(F.col("stage_after"), F.lit(True)).alias("_stage"), last(status_after(act), F.lit(True)).alias("_status"),
        last(approval, approval.isNotNull()).alias("_approval"),
        last(F.col("quote_amount_usd"), act == "prepare_quote").alias("_amount"),
        F.max(ok & F.col("billing_prepared")).alias("_billing"),
        last(F.col("requested_at"), F.lit(True)).alias("_at"),
        last(F.col("requested_at"), act == "validate_identity").alias("_verified")).where("_stage is not null")
    known = identity.select(F.col("identifier").alias("customer_identifier"), F.struct(
        *(F.col(f.name) if f.name in identity.columns else F.lit(None).cast(f.dataType).alias(f.name)
          for f in K.IDENTITY_VALIDATION.fields if f.name != "verified_at")).alias("_check")).dropDuplicates(["customer_identifier"])
    j = cases.join(agg, cases.id == agg.case_id)
    # only checked cases meet the checks; the others stay where they are
    j = (j.where("_verified is not null").join(known, "customer_identifier", "left")
         .unionByName(j.where("_verified is null"), allowMissingColumns=True))
    checked = F.col("_verified").isNotNull()
    check = F.struct(*((F.col("_verified") if f.name == "verified_at" else F.col(f"_check.{f.name}")).cast(f.dataType).alias(f.name)
                       for f in K.IDENTITY_VALIDATION.fields))
    legal = F.when(checked & (F.coalesce(F.col("_check.legal_name"), F.lit("")) != ""), F.col("_check.legal_name"))
    new = {
        "customer_identifier": F.when(checked, F.col("_check.identifier")).otherwise(F.col("customer_identifier")),
        "customer_name": F.coalesce(legal, "customer_name"),
        "identity_validation": F.when(checked, check).otherwise(F.col("identity_validation")),
        "current_stage": F.col("_stage"), "status": F.col("_status"),
        "quote_approval": F.coalesce("_approval", "quote_approval"),
        "quote_amount_usd": F.coalesce("_amount", "quote_amount_usd"),
        "billing_prepared": F.col("billing_prepared") | F.col("_billing"), "updated_at": F.col("_at")}
    return j.select(*(new.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in CASE.fields))


def audit_rows(log: DataFrame, cases: DataFrame) -> DataFrame:
    """One complete audit row per accepted action (T4), in the log's schema."""
    c = cases.select(F.col("id").alias("case_id"), "tenant_id", "customer_id", "title")
    a = log.where("accepted").join(c, "case_id")
    act, no = F.col("action"), F.col("action_no").cast("string")
    note = F.when(F.trim(F.coalesce("note", F.lit(""))) != "", F.col("note"))
    given = {
        "timestamp": F.col("requested_at"), "event_id": event_uuid(F.col("case_id"), no),
        "event_name": F.when(act == "validate_identity", "identity_validation_completed").otherwise("workflow_transition_completed"),
        "agent_id": F.col("actor_user_id"), "actor_type": F.lit("human"), "input_summary": F.coalesce(note, "title"),
        "decision": F.concat("stage_before", F.lit(" → "), "stage_after"),
        "result": F.concat(F.lit("Expediente actualizado a "), status_after(act), F.lit(".")),
        "request_reference": F.concat_ws("/", "case_id", no),
        "human_approval": F.when(act == "approve_quote", "approved").when(act == "reject_quote", "rejected")
        .when(act == "prepare_quote", "required").otherwise("not_required"),
        "duration_ms": F.lit(0), "status": F.lit("completed"), "evidence_version": F.lit(K.EVIDENCE_VERSION)}
    same = ("tenant_id", "customer_id", "case_id", "action")
    return a.select(*((given[f.name] if f.name in given else F.col(f.name) if f.name in same else F.lit(None))
                      .cast(f.dataType).alias(f.name) for f in EVENT.fields))


def commit_batch(spark: SparkSession, base: str, batch: int, cases: DataFrame, actions: DataFrame,
                 identity: DataFrame) -> bool:
    """Judge ``actions`` (case_id, action_no, action, quote_amount_usd,
    actor_user_id, requested_at, note) on the stored cases and commit the
    result as ``batch``; False if that batch is committed already.

    ``cases`` are the cases before the first batch, ``identity`` the checks of
    identifiers (identifier, identifier_type, locally_valid and what the registry
    gave).  Action numbers order a case's actions and must not fall back behind
    those of earlier batches."""
    if not read_table(spark, base, "commits").where(F.col("batch") == batch).isEmpty():
        return False
    def before(*columns: str) -> DataFrame:
        return stored_cases(spark, base, cases, list(columns))
    known = read_table(spark, base, "judged").select("case_id", "action_no")
    fresh = actions.withColumn("action_no", F.col("action_no").cast("long"))
    log = transition_log(before("id", "customer_identifier", "current_stage", "billing_prepared"), fresh, identity,
                         carry=("actor_user_id", "requested_at", "note"), known=known, stored_only=True)
    log.write.mode("overwrite").parquet(f"{base}/work/batch={batch}")
    log = spark.read.schema(log.schema).parquet(f"{base}/work/batch={batch}")
    tables = (("judged", log.select("case_id", "action_no", "accepted", "error")),
              ("events", audit_rows(log, before("id", "tenant_id", "customer_id", "title"))),
              ("cases", write_back(before(), log, identity)))
    counts = {}
    for name, rows in tables:
        # a batch without a judged action writes no audit row and changes no case
        (rows.limit(0) if counts.get("judged") == 0 else rows).write.mode("overwrite").parquet(f"{base}/{name}/batch={batch}")
        counts[name] = spark.read.schema(_TABLES[name]).parquet(f"{base}/{name}/batch={batch}").count()
    manifest = [tuple(counts[f.name] for f in MANIFEST.fields)]
    spark.createDataFrame(manifest, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{base}/commits/batch={batch}")
    return True
