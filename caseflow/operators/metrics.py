"""Business metrics and contact jobs: F2, F4, F5, F11, A4-A8, A10, A12, A15,
A16, A18, A19, A21, A22, L4, U2, W5, J15, J16, X11."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import text as TX
from caseflow.functions.validate import contact_rules, errors
from caseflow.operators.components import components
from caseflow.operators.sequence import rank_by_counts, top_n_per_group


# --------------------------------------------------------------------------- contact filters


def filter_contacts(contacts: DataFrame, tenant_id: str | None = None, playbook: str | None = None) -> DataFrame:
    """Optional conjunctive filters; blank means no filter (F2)."""
    c = contacts
    if tenant_id and tenant_id.strip():
        c = c.where(F.col("tenant_id") == tenant_id)
    if playbook and playbook.strip():
        c = c.where(F.col("playbook") == playbook)
    return c


def list_total(df: DataFrame, by: list[str]) -> DataFrame:
    """Count beside a listing (A6), as a grouped aggregate."""
    return df.groupBy(*by).agg(F.count("*").alias("total"))


def safe_contacts(contacts: DataFrame) -> DataFrame:
    """Only synthetic rows in the synthetic environment with outbound blocked."""
    return contacts.where(F.col("synthetic") & (F.col("environment") == "synthetic") & ~F.col("outbound_allowed"))


def search_contacts(contacts: DataFrame, playbook: str, text: str) -> DataFrame:
    """Trimmed, lower-cased substring over name, account and opportunity."""
    needle = text.strip().lower()
    c = contacts.where(F.col("playbook") == playbook)
    if not needle:
        return c
    hay = F.lower(F.concat_ws(" ", "display_name", "account_name", "opportunity"))
    return c.where(hay.contains(F.lit(needle)))


def campaign_eligible(contacts: DataFrame, consent: DataFrame, suppression: DataFrame) -> DataFrame:
    """Contacts whose newest consent decision is a grant and that no
    suppression entry names by phone or e-mail (F11).

    consent: contact_id, decision, decided_at (of decisions at one time,
    anything but a grant wins); suppression: phone, email, either may be null.
    Phones are compared without separators, e-mails trimmed and lower-cased.
    """
    newest = consent.groupBy("contact_id").agg(
        F.max_by("decision", F.struct("decided_at", F.col("decision") != "granted")).alias("decision"))
    granted = newest.where(F.col("decision") == "granted").select("contact_id")
    mail = lambda c: F.lower(TX.js_trim(c))
    phones = suppression.where("phone is not null").select(TX.normalize_phone(F.col("phone")).alias("_p"))
    mails = suppression.where("email is not null").select(mail(F.col("email")).alias("_m"))
    return (contacts.join(granted, contacts.id == granted.contact_id, "left_semi")
            .join(phones, TX.normalize_phone(F.col("phone")) == F.col("_p"), "left_anti")
            .join(mails, mail(F.col("email")) == F.col("_m"), "left_anti"))


# --------------------------------------------------------------------------- dashboards


def control_room_kpis(workflows: DataFrame, contacts: DataFrame) -> DataFrame:
    """Pending approvals, decisions, billing items, pipeline, per tenant (A4)."""
    w = workflows.groupBy("tenant_id").agg(
        F.count_if(F.col("status") == "awaiting_approval").alias("pending_approvals"),
        F.count_if(F.col("analysis").isNotNull()).alias("decisions"),
        F.count_if(F.col("status") == "billing_review").alias("billing_items"))
    c = contacts.groupBy("tenant_id").agg(F.sum("estimated_value_usd").alias("pipeline_usd"))
    return c.join(w, "tenant_id", "full").select(
        "tenant_id", *[F.coalesce(F.col(x), F.lit(0)).cast("bigint").alias(x)
                       for x in ["pending_approvals", "decisions", "billing_items", "pipeline_usd"]])


def seed_status(contacts: DataFrame) -> DataFrame:
    """Stored contacts and pipeline per tenant, plus the grand total (A5)."""
    g = contacts.rollup("tenant_id").agg(F.count("*").alias("contacts"),
                                         F.sum("estimated_value_usd").alias("pipeline_usd"),
                                         F.grouping_id().alias("level"))
    return g


def next_action_coverage(contacts: DataFrame) -> DataFrame:
    """Share of contacts with a non-blank next action, per tenant."""
    has = F.length(TX.js_trim(F.coalesce(F.col("next_action"), F.lit("")))) > 0
    return contacts.groupBy("tenant_id").agg(F.round(F.avg(has.cast("double")), 6).alias("coverage"))


def overview(contacts: DataFrame, workflows: DataFrame, events: DataFrame) -> DataFrame:
    """Contacts, active opportunities, continuity coverage %, decisions and
    pending approvals per tenant, computed instead of constants (A7)."""
    has = F.length(TX.js_trim(F.coalesce(F.col("next_action"), F.lit("")))) > 0
    c = contacts.groupBy("tenant_id").agg(
        F.count("*").alias("contacts"),
        F.count_if(F.col("status") != "billing_review").alias("active_opportunities"),
        F.round(F.avg(has.cast("double")) * 100, 0).cast("bigint").alias("continuity_coverage"))
    w = workflows.groupBy("tenant_id").agg(F.count_if(F.col("status") == "awaiting_approval")
                                           .alias("pending_approvals"))
    e = events.where(F.col("event_name").isin("agent_decision_completed", "gemini_analysis_completed")) \
        .groupBy("tenant_id").agg(F.count("*").alias("agent_decisions"))
    j = c.join(w, "tenant_id", "left").join(e, "tenant_id", "left")
    return j.select("tenant_id", "contacts", "active_opportunities", "continuity_coverage",
                    F.coalesce("agent_decisions", F.lit(0)).cast("bigint").alias("agent_decisions"),
                    F.coalesce("pending_approvals", F.lit(0)).cast("bigint").alias("pending_approvals"))


def followup_sla(contacts: DataFrame, followups: DataFrame, as_of: Column) -> DataFrame:
    """Share of contacts due before ``as_of`` that were followed up between
    their last interaction and their due date (A10).  Follow-ups are reduced
    to one flag per contact before meeting the contact table."""
    due = contacts.where(F.col("due_at") <= as_of).select("id", "tenant_id", "last_interaction_at", "due_at")
    f = followups.select(F.col("contact_id").alias("id"), F.col("at"))
    hit = due.join(f, "id").where((F.col("at") >= F.col("last_interaction_at")) & (F.col("at") <= F.col("due_at"))) \
        .select("id").distinct()
    j = due.join(hit.withColumn("_on", F.lit(True)), "id", "left")
    on = F.coalesce(F.col("_on"), F.lit(False))
    return j.groupBy("tenant_id").agg(F.count("*").alias("due"), F.count_if(on).alias("on_time"),
                                      F.round(F.avg(on.cast("double")), 6).alias("sla_share"))


def conversion(cases: DataFrame) -> DataFrame:
    """Completed over opened by playbook and tenant with subtotals."""
    g = cases.rollup("playbook", "tenant_id").agg(
        F.count("*").alias("opened"), F.count_if(F.col("current_stage") == "completed").alias("completed"),
        F.grouping_id().alias("level"))
    return g.withColumn("rate", F.round(F.col("completed") / F.col("opened"), 6))


def deidentified_rollup(df: DataFrame, dims: list[str], k: int) -> DataFrame:
    """Cross-tenant counts without ids; groups under ``k`` are suppressed."""
    return df.groupBy(*dims).agg(F.count("*").alias("n"), F.countDistinct("tenant_id").alias("tenants")) \
        .where(F.col("n") >= k)


def import_reconciliation(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Validate an import batch: input = stored + rejected + duplicates.

    Returns (stored rows, per-tenant reconciliation)."""
    v = incoming.withColumn("errors", errors(contact_rules()))
    good = v.where(F.size("errors") == 0)
    stored = good.dropDuplicates(["id"]).drop("errors")
    n_in = incoming.groupBy("tenant_id").agg(F.count("*").alias("input_rows"))
    n_bad = v.where(F.size("errors") > 0).groupBy("tenant_id").agg(F.count("*").alias("rejected"))
    n_good = good.groupBy("tenant_id").agg(F.count("*").alias("_good"), F.countDistinct("id").alias("stored"))
    r = n_in.join(n_bad, "tenant_id", "full").join(n_good, "tenant_id", "full")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    rec = r.select("tenant_id", z("input_rows").alias("input_rows"), z("stored").alias("stored"),
                   z("rejected").alias("rejected"), (z("_good") - z("stored")).alias("duplicates"))
    rec = rec.withColumn("balanced", F.col("input_rows") == F.col("stored") + F.col("rejected") + F.col("duplicates"))
    return stored, rec


def duplicate_contacts(contacts: DataFrame) -> DataFrame:
    """Contacts sharing a normalised phone or lower-cased e-mail (A19).  Groups
    are described by size and smallest member id, one output row per member --
    never a collected member list.  ``contact_groups`` joins groups across
    kinds of keys, identifiers included."""
    keys = _contact_keys(contacts)
    groups = keys.groupBy("kind", "key").agg(F.count("*").alias("group_size"), F.min("id").alias("group_id")) \
        .where(F.col("group_size") > 1)
    return keys.join(groups, ["kind", "key"], "inner").select("id", "tenant_id", "kind", "key", "group_size",
                                                              "group_id")


def _contact_keys(contacts: DataFrame) -> DataFrame:
    """(id, tenant_id, kind, key) of the phone and the e-mail of each contact."""
    return contacts.select(
        "id", "tenant_id",
        F.explode(F.array(
            F.struct(F.lit("phone").alias("kind"), TX.normalize_phone(F.col("phone")).alias("key")),
            F.struct(F.lit("email").alias("kind"), F.lower(TX.js_trim(F.col("email"))).alias("key")),
        )).alias("k")).select("id", "tenant_id", "k.kind", "k.key").where(F.col("key") != "")


def contact_groups(contacts: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Duplicate groups across kinds of keys (A19): contacts that share a phone,
    an e-mail or the digits of an identifier, directly or through others.

    ``identifiers`` has the contact's id and its identifier text.  One row per
    contact of a group of two or more: id, tenant_id, group_id (smallest id of
    the group), group_size.  Blank keys join nobody.  Contacts of a key are
    linked with its smallest id only, so a key shared by very many is as many
    links as contacts."""
    ids = identifiers.select("id", F.lit("identifier").alias("kind"),
                             F.regexp_replace("identifier", "[^0-9]", "").alias("key")).where(F.col("key") != "")
    keys = _contact_keys(contacts).select("id", "kind", "key").unionByName(
        ids.join(contacts.select("id"), "id", "left_semi"))
    first = keys.groupBy("kind", "key").agg(F.min("id").alias("first"))
    groups = components(keys.join(first, ["kind", "key"]), "id", "first")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("group_size"))
    rows = contacts.select("id", "tenant_id").distinct().join(groups, "id").join(sizes, "component")
    return rows.select("id", "tenant_id", F.col("component").alias("group_id"), "group_size")


def service_family_mix(analyses: DataFrame, cases: DataFrame) -> DataFrame:
    """Opportunities and quoted amount per service family (A21): quoted,
    not revenue."""
    j = analyses.join(cases.select("case_id", "quote_amount_usd"), "case_id", "inner")
    return j.groupBy("service_family").agg(
        F.count("*").alias("opportunities"),
        F.count_if(F.col("quote_amount_usd").isNotNull()).alias("quoted"),
        F.coalesce(F.sum("quote_amount_usd"), F.lit(0).cast("decimal(28,2)")).alias("quoted_usd"))


def billing_queue(cases: DataFrame, workflows: DataFrame, contacts: DataFrame) -> DataFrame:
    """Items waiting for billing review: count, amount, oldest."""
    c = cases.where(F.col("status") == "billing_review").select(
        "tenant_id", F.lit("case").alias("kind"), F.col("quote_amount_usd").cast("decimal(18,2)").alias("amount"),
        F.col("updated_at").alias("since"))
    v = contacts.select(F.col("id").alias("contact_id"), "estimated_value_usd", "last_interaction_at")
    w = workflows.where(F.col("billing_status") == "ready_for_review").join(v, "contact_id", "left").select(
        "tenant_id", F.lit("workflow").alias("kind"), F.col("estimated_value_usd").cast("decimal(18,2)")
        .alias("amount"), F.col("last_interaction_at").alias("since"))
    u = c.unionByName(w)
    return u.groupBy("tenant_id", "kind").agg(F.count("*").alias("items"),
                                              F.sum("amount").alias("amount_usd"), F.min("since").alias("oldest"))


def action_queue(contacts: DataFrame, n: int) -> DataFrame:
    """Top ``n`` contacts per tenant by priority, then due date (L4), with
    the salted two-phase top-n (no whole-tenant sort in one task)."""
    prio = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    c = contacts.select("id", "tenant_id", "priority", "due_at", prio.alias("_p"))
    out = top_n_per_group(c, ["tenant_id"], [F.col("_p"), F.col("due_at"), F.col("id")], n, salt_key="id")
    return out.select("tenant_id", "rank", "id", "priority", "due_at")


def stale_opportunities(contacts: DataFrame, as_of: Column) -> DataFrame:
    """Overdue days and recency rank per tenant (W5); the rank is computed
    from per-timestamp counts, not a whole-tenant window sort."""
    c = contacts.where(F.col("due_at") < as_of).select(
        "id", "tenant_id", "last_interaction_at", F.datediff(as_of, F.col("due_at")).alias("overdue_days"))
    return rank_by_counts(c, ["tenant_id"], "last_interaction_at", "recency_rank") \
        .select("id", "tenant_id", "overdue_days", "recency_rank")


def seed_drift(seed: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows on one side only, and on both.

    Same result as ``exceptAll`` both ways plus ``intersect``, computed as
    one aggregate over the tagged union: per distinct row, the multiplicity
    on each side (a single shuffle, partial aggregation on hot rows)."""
    cols = seed.columns
    u = seed.select(*cols, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        stored.select(*cols, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    g = u.groupBy(*cols).agg(F.sum("_a").alias("a"), F.sum("_b").alias("b"))
    sides = g.select(
        F.explode(F.array(
            F.struct(F.lit("seed_only").alias("side"), F.greatest(F.col("a") - F.col("b"), F.lit(0)).alias("n")),
            F.struct(F.lit("stored_only").alias("side"), F.greatest(F.col("b") - F.col("a"), F.lit(0)).alias("n")),
            F.struct(F.lit("both").alias("side"), F.when((F.col("a") > 0) & (F.col("b") > 0), 1).otherwise(0)
                     .alias("n")))).alias("x"))
    return sides.groupBy("x.side").agg(F.sum("x.n").alias("rows")).where(F.col("rows") > 0)


def evidence_chain(transactions: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Explode evidence ids; list missing links and unreconciled rows."""
    links = transactions.select("transaction_id", F.explode(F.split(F.col("evidence_ids"), ";")).alias("evidence_id")) \
        .select("transaction_id", F.trim("evidence_id").alias("evidence_id")).where(F.col("evidence_id") != "")
    missing = links.join(evidence.select("evidence_id"), "evidence_id", "left_anti")
    unreconciled = transactions.where(~F.coalesce(F.col("bank_reconciled"), F.lit(False))).select("transaction_id")
    return missing, unreconciled


def classification_eval(predicted: DataFrame, golden: DataFrame, label: str = "label") -> DataFrame:
    """Confusion counts, precision and recall per class."""
    j = predicted.select("doc_id", F.col(label).alias("pred")).join(
        golden.select("doc_id", F.col(label).alias("gold")), "doc_id", "inner")
    classes = j.select(F.col("gold").alias("cls")).union(j.select(F.col("pred").alias("cls"))).distinct()
    per = j.groupBy("gold", "pred").agg(F.count("*").alias("n"))
    tp = per.where(F.col("gold") == F.col("pred")).select(F.col("gold").alias("cls"), F.col("n").alias("tp"))
    fp = per.where(F.col("gold") != F.col("pred")).groupBy(F.col("pred").alias("cls")).agg(F.sum("n").alias("fp"))
    fn = per.where(F.col("gold") != F.col("pred")).groupBy(F.col("gold").alias("cls")).agg(F.sum("n").alias("fn"))
    r = classes.join(tp, "cls", "left").join(fp, "cls", "left").join(fn, "cls", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    r = r.select("cls", z("tp").alias("tp"), z("fp").alias("fp"), z("fn").alias("fn"))
    return r.select("cls", "tp", "fp", "fn",
                    F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), 6).alias("precision"),
                    F.round(F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0)), 6).alias("recall"))


def pnl(lines: DataFrame) -> DataFrame:
    """Monthly P&L from ledger lines (A15): revenue, COGS, gross profit, net
    income; ``line`` is one of revenue_*, cogs_*, opex.  The line pivot is a
    fixed list, so the pivot needs no distinct pass."""
    kinds = ["revenue_implementation", "revenue_subscription", "revenue_usage", "cogs_direct_labor",
             "cogs_third_party", "operating_expenses"]
    p = lines.groupBy("month").pivot("line", kinds).agg(F.sum("amount_usd"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(28,2)"))
    rev = z(kinds[0]) + z(kinds[1]) + z(kinds[2])
    cogs = z(kinds[3]) + z(kinds[4])
    return p.select("month", rev.alias("total_revenue"), cogs.alias("total_cogs"),
                    (rev - cogs).alias("gross_profit"), (rev - cogs - z("operating_expenses")).alias("net_income"))


def hash_artifacts(spark, paths: str, manifest: DataFrame | None = None) -> DataFrame:
    """SHA-256 of every file under ``paths`` (binaryFile source), matched
    against an optional manifest of expected hashes (X11)."""
    files = spark.read.format("binaryFile").load(paths).select(
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))
    if manifest is None:
        return files
    return files.join(manifest.select("name", F.col("sha256").alias("expected")), "name", "full").withColumn(
        "matches", F.col("sha256") == F.col("expected"))


def pnl_check(stored: DataFrame) -> DataFrame:
    """Check the arithmetic of stored P&L rows (A15): totals equal their
    parts, gross profit = revenue - COGS, net income = gross - opex."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0).cast("decimal(18,2)"))
    rev = z("revenue_implementation") + z("revenue_subscription") + z("revenue_usage")
    cogs = z("cogs_gcp") + z("cogs_vertex_ai") + z("cogs_whatsapp") + z("cogs_third_party") + z("cogs_direct_labor")
    return stored.select(
        "month",
        (z("total_revenue") == rev).alias("revenue_ok"),
        (z("total_cogs") == cogs).alias("cogs_ok"),
        (z("gross_profit") == z("total_revenue") - z("total_cogs")).alias("gross_ok"),
        (z("net_income") == z("gross_profit") - z("operating_expenses")).alias("net_ok"),
    )
