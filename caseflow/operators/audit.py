"""Audit log jobs: append / merge (S8, S9), feeds and pages (L1, L2),
agent metrics (A9, A11, A13, A14), sequences (W2-W4), evidence (J14, G1),
request rate and health windows in batch form (T9, T10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow import schemas as K
from caseflow.operators.sequence import exact_median, last_value_before, next_in_sequence


def micros_between(start: Column, end: Column) -> Column:
    """Wall-clock microseconds between two TIMESTAMP_NTZ values (no session
    time zone involved, so DST never shifts a duration)."""
    iv = end - start
    part = lambda unit: F.extract(F.lit(unit), iv).cast("bigint")
    return (part("DAY") * 86_400_000_000 + part("HOUR") * 3_600_000_000 + part("MINUTE") * 60_000_000
            + (F.extract(F.lit("SECOND"), iv) * 1_000_000).cast("bigint"))


def append_events(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` to append: one per event id, none already stored.

    Of rows with one id the earliest stays (ties: the smallest row hash), so a
    task that is run again picks the same one.  A partial aggregate runs first,
    then an anti join on the id, so a replayed batch appends nothing."""
    row = F.struct(*new.columns)
    batch = new.groupBy("event_id").agg(
        F.min_by(row, F.struct("timestamp", F.xxhash64(*new.columns))).alias("_r")).select("_r.*")
    return batch.join(existing.select("event_id"), "event_id", "left_anti")


def merge_event_sources(*dfs: DataFrame) -> DataFrame:
    """One log out of several writers, in the canonical audit schema."""
    schema = K.ENTITY_SCHEMAS["audit_event"]
    out = None
    for d in dfs:
        d = d.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in d.columns
                       else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        out = d if out is None else out.unionByName(d)
    return out


def event_feed(events: DataFrame, tenant_id: str | None = None, n: int = K.PAGE_CAPS["events"]) -> DataFrame:
    """Newest first, capped; the tenant filter runs before the cap (L1)."""
    e = events if tenant_id is None else events.where(F.col("tenant_id") == tenant_id)
    return e.orderBy(F.col("timestamp").desc(), F.col("event_id").asc()).limit(n)


def page(df: DataFrame, key: str, size: int, after: str | None = None) -> DataFrame:
    """Keyset page: rows after ``after`` in ``key`` order, at most ``size`` (L2)."""
    d = df if after is None else df.where(F.col(key) > after)
    return d.orderBy(key).limit(size)


def time_to_classified(events: DataFrame) -> DataFrame:
    """Median seconds from a case's first inbound event to its first analysis
    after it, per tenant (A9)."""
    inbound = F.col("event_name").isin("case_created", "customer_created", "media_received")
    analysis = F.col("event_name").isin("agent_decision_completed", "gemini_analysis_completed")
    first_in = events.where(inbound).groupBy("tenant_id", "case_id").agg(F.min("timestamp").alias("t_in"))
    an = events.where(analysis).select("tenant_id", "case_id", F.col("timestamp").alias("t_an"))
    j = an.join(first_in, ["tenant_id", "case_id"]).where(F.col("t_an") >= F.col("t_in"))
    per_case = j.groupBy("tenant_id", "case_id").agg(
        micros_between(F.first("t_in"), F.min("t_an")).alias("us"))
    # exact median from bucketed counts: no tenant's values are gathered in one task
    med = exact_median(per_case, ["tenant_id"], "us", "_med_us")
    cnt = per_case.groupBy("tenant_id").agg(F.count("*").alias("cases"))
    return cnt.join(med, "tenant_id", "left").select(
        "tenant_id", "cases", F.round(F.col("_med_us") / 1e6, 3).alias("median_seconds"))


def approval_rates(events: DataFrame) -> DataFrame:
    """Accepted / edited / rejected shares of human decisions per agent."""
    d = events.where(F.col("event_name") == "human_approval_completed")
    n = F.count("*")
    return d.groupBy("agent_id").agg(
        n.alias("decisions"),
        F.round(F.count_if(F.col("human_approval") == "approved") / n, 6).alias("approved_share"),
        F.round(F.count_if(F.col("human_approval") == "edited") / n, 6).alias("edited_share"),
        F.round(F.count_if(F.col("human_approval") == "rejected") / n, 6).alias("rejected_share"),
    )


def error_retry_rates(events: DataFrame) -> DataFrame:
    """agent_error, agent_retry and failed shares per agent."""
    n = F.count("*")
    return events.groupBy("agent_id").agg(
        n.alias("events"),
        F.count_if(F.col("event_name") == "agent_error").alias("errors"),
        F.count_if(F.col("event_name") == "agent_retry").alias("retries"),
        F.round(F.count_if(F.col("status") == "failed") / n, 6).alias("failed_share"),
    )


def model_usage(events: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Calls, tokens and duration percentiles by tenant, model and day (A14);
    cost from a per-model price table when given; evidence completeness is
    the share of calls carrying a request reference."""
    e = events.where(F.col("model").isNotNull()).withColumn("day", F.to_date("timestamp"))
    keys = ["tenant_id", "model", "day"]
    per = e.groupBy(*keys, "duration_ms").agg(
        F.count("*").alias("n"), F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o"),
        F.count_if(F.col("request_reference").isNotNull()).alias("r"))
    g = per.groupBy(*keys).agg(
        F.sum("n").alias("calls"), F.sum("i").alias("input_tokens"), F.sum("o").alias("output_tokens"),
        F.round(F.percentile("duration_ms", 0.5, F.col("n")), 6).alias("p50_ms"),
        F.round(F.percentile("duration_ms", 0.95, F.col("n")), 6).alias("p95_ms"),
        F.round(F.sum("r") / F.sum("n"), 6).alias("evidence_share"))
    if prices is None:
        return g.withColumn("cost_usd", F.lit(None).cast("decimal(18,6)"))
    j = g.join(prices.select("model", "usd_per_1k_input", "usd_per_1k_output"), "model", "left")
    cost = (F.col("input_tokens").cast("decimal(20,0)") * F.col("usd_per_1k_input") / 1000
            + F.col("output_tokens").cast("decimal(20,0)") * F.col("usd_per_1k_output") / 1000)
    return j.select(*g.columns, cost.cast("decimal(18,6)").alias("cost_usd"))


def stage_durations(log: DataFrame, requested: DataFrame) -> DataFrame:
    """Hours spent in each stage from consecutive accepted transitions.

    The next accepted transition comes from the bucketed ``next_in_sequence``
    helper, not a per-case window."""
    a = log.where("accepted").join(requested, ["case_id", "action_no"], "inner") \
        .select("case_id", "action_no", F.col("stage_after").alias("stage"), F.col("requested_at").alias("entered_at"))
    n = next_in_sequence(a, ["case_id"], "action_no", "entered_at", "left_at")
    hours = micros_between(F.col("entered_at"), F.col("left_at")) / 3.6e9
    return n.select("case_id", "action_no", "stage", "entered_at", "left_at", F.round(hours, 6).alias("hours"))


def approval_validity(log: DataFrame) -> DataFrame:
    """An approval still holds only while the draft it approved is the
    latest draft (W3): payload hash of the draft at approval time versus the
    hash of the current draft."""
    drafts = log.where(F.col("accepted") & F.col("action").isin("analyze", "draft")).select(
        "contact_id", "action_no", F.sha2(F.coalesce(F.col("draft"), F.lit("#analysis")), 256).alias("h"))
    approvals = log.where(F.col("accepted") & (F.col("action") == "approve")).select("contact_id", "action_no")
    # hash at approval time: newest draft before the approval (as-of on the sequence)
    at = last_value_before(drafts, approvals, ["contact_id"], "action_no", "h", "h_at")
    current = drafts.groupBy("contact_id").agg(F.max_by("h", "action_no").alias("h_now"))
    j = at.join(current, "contact_id", "left")
    return j.select("contact_id", F.col("action_no").alias("approval_no"),
                    F.coalesce(F.col("h_at") == F.col("h_now"), F.lit(False)).alias("valid"))


def budget_alerts(costs: DataFrame, budget: float = K.MONTHLY_BUDGET_USD,
                  thresholds: list[float] = K.BUDGET_THRESHOLDS) -> DataFrame:
    """First day in each month when the running cost passes each alert point
    (W4).  Costs are reduced to days first, so the month window sees at most
    31 rows."""
    daily = costs.groupBy(F.to_date("timestamp").alias("day")).agg(F.sum("cost_usd").alias("cost_usd"))
    daily = daily.withColumn("month", F.date_trunc("month", F.col("day")).cast("date"))
    w = Window.partitionBy("month").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    run = daily.withColumn("running", F.sum("cost_usd").over(w))
    th = F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold")
    hits = run.select("month", "day", "running", th).where(F.col("running") >= F.col("threshold") * F.lit(budget))
    return hits.groupBy("month", "threshold").agg(F.min("day").alias("first_day"))


def evidence_match(manifest: DataFrame, audit: DataFrame, logs: DataFrame) -> DataFrame:
    """Per evidence row: audit rows and log rows with its event id; complete
    when both are exactly one (J14).  Both sides are pre-aggregated."""
    a = audit.groupBy("event_id").agg(F.count("*").alias("audit_rows"))
    lg = logs.groupBy("event_id").agg(F.count("*").alias("log_rows"))
    j = manifest.join(a, "event_id", "left").join(lg, "event_id", "left")
    ar = F.coalesce("audit_rows", F.lit(0))
    lr = F.coalesce("log_rows", F.lit(0))
    return j.select("evidence_id", "event_id", ar.alias("audit_rows"), lr.alias("log_rows"),
                    ((ar == 1) & (lr == 1)).alias("complete"))


def evidence_gate(manifest: DataFrame) -> DataFrame:
    """Evidence rows that cannot back a claim (G1): required fields, 64-hex
    hash, unique id, visibility and consent set, and synthetic rows never
    count as production proof."""
    ids = manifest.groupBy("evidence_id").agg(F.count("*").alias("_copies"))
    m = manifest.join(ids, "evidence_id", "left")
    blank = lambda c: F.coalesce(F.trim(F.col(c)) == "", F.lit(True))
    errs = F.array_compact(F.array(
        *[F.when(blank(c), F.lit(f"missing_{c}")) for c in ["evidence_id", "captured_at_utc", "category",
                                                             "source_system", "status"]],
        F.when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), F.lit("bad_sha256")),
        F.when(F.col("_copies") > 1, F.lit("duplicate_id")),
        F.when(blank("visibility"), F.lit("missing_visibility")),
        F.when(blank("consent_status"), F.lit("missing_consent")),
        F.when((F.col("environment") == "synthetic") & (F.col("claim_supported") == "production_usage"),
               F.lit("synthetic_as_production")),
    ))
    return m.select("evidence_id", F.array_join(errs, ",").alias("errors"), (F.size(errs) == 0).alias("usable"))


def request_rate(events: DataFrame, limit: int = K.REQUEST_LIMIT_PER_MINUTE, window: str = "1 minute",
                 client: str = "agent_id") -> DataFrame:
    """Clients above ``limit`` events in an aligned window."""
    g = events.groupBy(F.window(F.col("timestamp"), window).alias("w"), client).agg(
        F.count("*").alias("events"))
    return g.where(F.col("events") > limit).select(
        F.col("w.start").cast("timestamp_ntz").alias("window_start"), client, "events")


def health_windows(events: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Error share and latency per aligned window (T10, exact batch form)."""
    e = events.withColumn("window_start", F.window(F.col("timestamp"), window)["start"])
    # one scan: rows are counted per window and duration first, so a busy window
    # is cut before the shuffle, and its percentile is taken over the counts
    per = e.groupBy("window_start", "duration_ms").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed"))
    return per.groupBy("window_start").agg(
        F.sum("n").alias("events"), F.round(F.sum("failed") / F.sum("n"), 6).alias("error_share"),
        F.round(F.percentile("duration_ms", 0.5, F.col("n")), 6).alias("p50_ms"), F.max("duration_ms").alias("max_ms"))
