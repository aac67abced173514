"""Property portfolio: visibility grants, visible children, totals and the
grounded brief (J5, J6, J11, A1-A3, L3, A17).

Scale notes
-----------
* Visibility is returned as *grants*, not as (user, property) pairs: an owner
  or administrator gets one tenant-wide grant row; everybody else gets one row
  per property they administer or created (two equi-joins).  Emitting every
  pair inside a tenant would be quadratic in a hot tenant.
* Every child table is aggregated per (tenant, property) before it meets the
  property table, so the joins see one row per property, and the group-by runs
  a map-side partial aggregate first (a hot property costs nothing extra).
* The brief is a flat, globally sorted table (range partitioned), never one
  collected array per tenant.  Its lines travel packed, and to no more ranges
  than the shuffle deals out without sorting, so no map task holds its lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.sources.io import stored

#: grant lists up to this number (some 200 bytes each, counted first) are broadcast
FEW_GRANTS = 500_000
#: likewise for the brief's property keys
FEW_PROPERTIES = 500_000

#: ranges of the sorted brief: up to spark.shuffle.sort.bypassMergeThreshold
#: (200) the lines go straight to one file per range; above it every map task
#: holds and sorts its lines first, and spills them all where they do not fit
BRIEF_RANGES = 200
#: in text order, so that a line can be sorted by its section's number
SECTIONS = ["commitment", "issue", "property", "system"]

TENANT_WIDE_ROLES = ("platform_owner", "administrator")
ATTENTION = ("attention", "critical")

TOTAL_COLUMNS = ["properties", "open_issues", "critical_issues", "systems_requiring_attention",
                 "upcoming_commitments"]


def has_permission(role: Column, permissions: Column, permission: str) -> Column:
    """Owner role holds every permission; others need it in their list."""
    return (role == "platform_owner") | F.coalesce(F.array_contains(permissions, permission), F.lit(False))


def next_date(commitments: DataFrame) -> Column:
    # starts_at wins even when it is past; due_at only when starts_at is null
    return F.coalesce(commitments["starts_at"], commitments["due_at"])


def is_upcoming(c: DataFrame, as_of: Column) -> Column:
    nd = F.coalesce(c["starts_at"], c["due_at"])
    return (c["status"] == "scheduled") & nd.isNotNull() & (nd >= as_of)


# --------------------------------------------------------------------------- J5


def visible_properties(properties: DataFrame, memberships: DataFrame) -> DataFrame:
    """Grants: (tenant_id, user_id, property_id, scope).

    scope 'tenant' (property_id null) for owners and administrators, scope
    'assigned' / 'created' for a property the user administers or created.
    Only active memberships with ``portfolio.view`` get grants.
    """
    m = memberships.where(
        (F.col("status") == "active") & has_permission(F.col("role"), F.col("permissions"), "portfolio.view")
    ).select("tenant_id", "user_id", "role")
    wide = m.where(F.col("role").isin(*TENANT_WIDE_ROLES)).select(
        "tenant_id", "user_id", F.lit(None).cast("string").alias("property_id"), F.lit("tenant").alias("scope"))
    narrow = m.where(~F.col("role").isin(*TENANT_WIDE_ROLES)).select("tenant_id", "user_id")
    p = properties.select("tenant_id", F.col("id").alias("property_id"), "administrator_user_id", "created_by")
    by_admin = p.join(narrow, (p.tenant_id == narrow.tenant_id) & (p.administrator_user_id == narrow.user_id)) \
        .select(p.tenant_id, narrow.user_id, p.property_id, F.lit(1).alias("how"))
    by_creator = p.join(narrow, (p.tenant_id == narrow.tenant_id) & (p.created_by == narrow.user_id)) \
        .select(p.tenant_id, narrow.user_id, p.property_id, F.lit(2).alias("how"))
    assigned = by_admin.unionByName(by_creator).groupBy("tenant_id", "user_id", "property_id").agg(
        F.min("how").alias("how"))
    assigned = assigned.select("tenant_id", "user_id", "property_id",
                               F.when(F.col("how") == 1, "assigned").otherwise("created").alias("scope"))
    return wide.unionByName(assigned)


# --------------------------------------------------------------------------- J6 / J11


def visible_children(children: DataFrame, visible_props: DataFrame, allow_null: bool = False) -> DataFrame:
    """Children whose (tenant, property) is visible; with ``allow_null`` also
    the tenant-wide rows (null property) of tenants that have visibility."""
    keys = visible_props.select("tenant_id", F.col("id").alias("property_id")).distinct()
    hit = children.join(keys, ["tenant_id", "property_id"], "left_semi")
    if not allow_null:
        return hit
    tenants = visible_props.select("tenant_id").distinct()
    nulls = children.where(F.col("property_id").isNull()).join(tenants, "tenant_id", "left_semi")
    return hit.unionByName(nulls)


def member_children(children: DataFrame, properties: DataFrame, memberships: DataFrame,
                    allow_null: Column | None = None) -> DataFrame:
    """Grants on children: all columns of ``children`` with user_id and scope.

    scope 'assigned' / 'created': the member ``user_id`` administers or created
    the child's property.  scope 'tenant' (user_id null): the property exists,
    and every tenant-wide member sees it.  scope 'members' (user_id null): the
    child has no property, ``allow_null`` holds for it (nowhere by default), and
    every member with ``portfolio.view`` sees it, also one without a property.

    Grants of a property are one list of at most three entries, written and
    counted.  Up to ``FEW_GRANTS`` lists are broadcast, and the children, many
    times as many rows, stay where they are; above that both meet in one shuffle
    join on (tenant, property), whose skewed keys AQE can split.  No member is
    paired with every child.  Children of a missing property or of another
    tenant's, or without a tenant, are granted to nobody."""
    grants = visible_properties(properties, memberships)
    everyone = F.struct(F.lit(None).cast("string").alias("user_id"), F.lit("tenant").alias("scope"))
    wide = grants.where("scope = 'tenant'").select("tenant_id").distinct()
    exists = properties.select("tenant_id", F.col("id").alias("property_id")).where("property_id is not null").distinct()
    viewers = memberships.where(
        (F.col("status") == "active") & has_permission(F.col("role"), F.col("permissions"), "portfolio.view")
    ).select("tenant_id").distinct()
    entries = (exists.join(wide, "tenant_id", "left_semi").select("tenant_id", "property_id", everyone.alias("g"))
               .unionByName(grants.where("scope <> 'tenant'").select("tenant_id", "property_id",
                                                                     F.struct("user_id", "scope").alias("g")))
               .unionByName(viewers.select("tenant_id", F.lit(None).cast("string").alias("property_id"),
                                           F.struct(F.lit(None).cast("string").alias("user_id"),
                                                    F.lit("members").alias("scope")).alias("g"))))
    held = entries.groupBy(F.col("tenant_id").alias("_tenant"), F.col("property_id").alias("_property")).agg(
        F.collect_set("g").alias("_held"))
    held = stored(held, "grants")
    if held.count() <= FEW_GRANTS:
        held = F.broadcast(held)
    shown = F.col("property_id").isNotNull() | F.coalesce(F.lit(False) if allow_null is None else allow_null, F.lit(False))
    hit = children.where(shown).join(held, (F.col("tenant_id") == F.col("_tenant"))
                                     & F.col("property_id").eqNullSafe(F.col("_property")))
    return hit.select(*children.columns, F.explode("_held").alias("_g")).select(
        *children.columns, F.col("_g.user_id").alias("user_id"), F.col("_g.scope").alias("scope"))


def children_of_member(children: DataFrame, properties: DataFrame, memberships: DataFrame, tenant_id: str,
                       user_id: str, allow_null: Column | None = None) -> DataFrame:
    """The rows of ``children`` that one member sees; the tenant's rows only
    are read."""
    own = F.col("tenant_id") == tenant_id
    seen = member_children(children.where(own), properties.where(own),
                           memberships.where(own & (F.col("user_id") == user_id)), allow_null)
    return seen.drop("user_id", "scope")


def orphan_report(children: DataFrame, properties: DataFrame, kind: str) -> DataFrame:
    """Rows whose property is missing or belongs to another tenant."""
    keys = properties.select("tenant_id", F.col("id").alias("property_id"))
    return (
        children.where(F.col("property_id").isNotNull())
        .join(keys, ["tenant_id", "property_id"], "left_anti")
        .select(F.lit(kind).alias("kind"), F.col("id").alias("child_id"), "tenant_id", "property_id")
    )


# --------------------------------------------------------------------------- A1


def _child_counts(issues: DataFrame | None, systems: DataFrame | None, commitments: DataFrame, as_of: Column):
    i = s = None
    if issues is not None:
        i = issues.groupBy("tenant_id", "property_id").agg(
            F.count_if(F.col("status") != "closed").alias("open_issues"),
            F.count_if((F.col("status") != "closed") & (F.col("priority") == "critical")).alias("critical_issues"),
        )
    if systems is not None:
        s = systems.groupBy("tenant_id", "property_id").agg(
            F.count_if(F.col("condition").isin(*ATTENTION)).alias("systems_requiring_attention"))
    c = commitments.groupBy("tenant_id", "property_id").agg(
        F.count_if(is_upcoming(commitments, as_of)).alias("upcoming_commitments"))
    return i, s, c


def property_totals(properties: DataFrame, issues: DataFrame, systems: DataFrame, commitments: DataFrame,
                    as_of: Column) -> DataFrame:
    """One row per property: its four child counts (orphans excluded)."""
    i, s, c = _child_counts(issues, systems, commitments, as_of)
    p = properties.select("tenant_id", F.col("id").alias("property_id"))
    out = (p.join(i, ["tenant_id", "property_id"], "left")
           .join(s, ["tenant_id", "property_id"], "left")
           .join(c, ["tenant_id", "property_id"], "left"))
    return out.select(
        "tenant_id", "property_id",
        *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n)
          for n in ["open_issues", "critical_issues", "systems_requiring_attention", "upcoming_commitments"]])


def tenant_wide_commitments(commitments: DataFrame, as_of: Column) -> DataFrame:
    """Upcoming tenant-wide commitments (null property) per tenant.  Reads the
    same (tenant, property) aggregate as the per-property totals, so the
    commitment table is scanned and shuffled once."""
    c = _child_counts(None, None, commitments, as_of)[2]
    return c.where(F.col("property_id").isNull()).select(
        "tenant_id", F.col("upcoming_commitments").cast("bigint").alias("tenant_wide_upcoming"))


def portfolio_totals(tenants: DataFrame, properties: DataFrame, issues: DataFrame, systems: DataFrame,
                     commitments: DataFrame, as_of: Column) -> DataFrame:
    """Totals of the whole-tenant brief (what an owner sees), one row per tenant."""
    per_prop = property_totals(properties, issues, systems, commitments, as_of)
    agg = per_prop.groupBy("tenant_id").agg(
        F.count("*").alias("properties"),
        *[F.sum(n).alias(n) for n in ["open_issues", "critical_issues", "systems_requiring_attention",
                                      "upcoming_commitments"]])
    wide = tenant_wide_commitments(commitments, as_of)
    t = tenants.select(F.col("id").alias("tenant_id"))
    out = t.join(agg, "tenant_id", "left").join(wide, "tenant_id", "left")
    return out.select(
        "tenant_id",
        F.coalesce(F.col("properties"), F.lit(0)).cast("bigint").alias("properties"),
        F.coalesce(F.col("open_issues"), F.lit(0)).cast("bigint").alias("open_issues"),
        F.coalesce(F.col("critical_issues"), F.lit(0)).cast("bigint").alias("critical_issues"),
        F.coalesce(F.col("systems_requiring_attention"), F.lit(0)).cast("bigint")
        .alias("systems_requiring_attention"),
        (F.coalesce(F.col("upcoming_commitments"), F.lit(0))
         + F.coalesce(F.col("tenant_wide_upcoming"), F.lit(0))).cast("bigint").alias("upcoming_commitments"),
    )


def member_portfolio_totals(memberships: DataFrame, properties: DataFrame, issues: DataFrame,
                            systems: DataFrame, commitments: DataFrame, as_of: Column) -> DataFrame:
    """Brief totals as each member sees them (J5 -> J6 -> A1), one row per
    member holding ``portfolio.view``.  Tenant-wide grantees reuse the tenant
    totals; the others sum the per-property totals of their grants."""
    grants = visible_properties(properties, memberships)
    per_prop = property_totals(properties, issues, systems, commitments, as_of)
    wide = tenant_wide_commitments(commitments, as_of)
    tenant_sum = per_prop.groupBy("tenant_id").agg(
        F.count("*").alias("properties"),
        *[F.sum(n).alias(n) for n in ["open_issues", "critical_issues", "systems_requiring_attention",
                                      "upcoming_commitments"]])
    g_wide = grants.where(F.col("scope") == "tenant").select("tenant_id", "user_id")
    wide_rows = g_wide.join(tenant_sum, "tenant_id", "left")
    narrow = grants.where(F.col("scope") != "tenant")
    narrow_rows = narrow.join(per_prop, ["tenant_id", "property_id"], "inner").groupBy("tenant_id", "user_id").agg(
        F.count("*").alias("properties"),
        *[F.sum(n).alias(n) for n in ["open_issues", "critical_issues", "systems_requiring_attention",
                                      "upcoming_commitments"]])
    # members with the permission but no grant still see the tenant-wide commitments
    viewers = memberships.where(
        (F.col("status") == "active") & has_permission(F.col("role"), F.col("permissions"), "portfolio.view")
        & ~F.col("role").isin(*TENANT_WIDE_ROLES)).select("tenant_id", "user_id")
    narrow_all = viewers.join(narrow_rows, ["tenant_id", "user_id"], "left")
    both = wide_rows.unionByName(narrow_all)
    both = both.join(wide, "tenant_id", "left")
    return both.select(
        "tenant_id", "user_id",
        *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n)
          for n in ["properties", "open_issues", "critical_issues", "systems_requiring_attention"]],
        (F.coalesce(F.col("upcoming_commitments"), F.lit(0))
         + F.coalesce(F.col("tenant_wide_upcoming"), F.lit(0))).cast("bigint").alias("upcoming_commitments"),
    )


# --------------------------------------------------------------------------- A2 / A3 / L3 / A17


def _packed(lines: DataFrame) -> DataFrame:
    """Brief lines as they are shuffled: an id that is lower-case hex goes as its
    bytes (``code``), any other as it is (``plain``)."""
    is_code = (F.octet_length("item_id") % 2 == 0) & (F.lower("item_id") == F.col("item_id"))
    lines = lines.withColumn("code", F.when(is_code, F.unhex("item_id")))
    return lines.select("next_at", "section", "counts_in_totals", "state", "detail", "tenant_id", "property_id",
                        "code", F.when(F.col("code").isNull(), F.col("item_id")).alias("plain"))


def _sorted_lines(lines: DataFrame, ranges: int) -> DataFrame:
    """All lines in order of (tenant, section, item), packed for the shuffle.
    Ranges and sort see the whole id, so packed and plain ids may be mixed."""
    item_id = F.when(F.col("code").isNull(), F.col("plain")).otherwise(F.lower(F.hex("code")))
    dealt = _packed(lines).repartitionByRange(ranges, F.col("tenant_id"), F.col("section"), item_id)
    return dealt.select("tenant_id", "section", item_id.alias("item_id"), "property_id", "state", "detail", "next_at",
                        "counts_in_totals").sortWithinPartitions("tenant_id", "section", "item_id")


def portfolio_brief(properties: DataFrame, issues: DataFrame, systems: DataFrame, commitments: DataFrame,
                    as_of: Column, property_id: str | None = None, ranges: int = BRIEF_RANGES) -> DataFrame:
    """The grounded brief as flat lines: one row per listed item.

    Closed issues stay in the list (only totals exclude them).  With a
    ``property_id`` the tenant-wide commitments drop out (A3).  Lines are
    sorted by (tenant, section, item) with a global range-partitioned sort, the
    whole brief in ``ranges`` partitions.
    """
    p, i, s, c = properties, issues, systems, commitments
    keys = p.select("tenant_id", F.col("id").alias("property_id"))
    if property_id is not None:
        keys = keys.where(F.col("property_id") == property_id)
    # the children, many times as many rows, stay where they are for few keys
    few = property_id is None and keys.count() <= FEW_PROPERTIES
    sent = F.broadcast(keys) if few else keys
    i = i.join(sent, ["tenant_id", "property_id"], "left_semi")
    s = s.join(sent, ["tenant_id", "property_id"], "left_semi")
    if property_id is None:
        # one pass over the commitments; those without a property find no key
        known = keys.distinct().withColumn("_known", F.lit(True))
        c_hit = c.join(F.broadcast(known) if few else known, ["tenant_id", "property_id"], "left").where(
            F.col("_known").isNotNull() | F.col("property_id").isNull()).select(*c.columns)
    else:
        c_hit = c.join(keys, ["tenant_id", "property_id"], "left_semi")
    pr = p.join(sent.withColumnRenamed("property_id", "id"), ["tenant_id", "id"], "left_semi")

    def line(df, section, state, detail, when_col, flag):
        return df.select(
            "tenant_id", F.lit(SECTIONS.index(section)).alias("section"), F.col("id").alias("item_id"),
            (F.col("id") if section == "property" else F.col("property_id")).alias("property_id"),
            state.alias("state"), detail.alias("detail"), when_col.cast("timestamp_ntz").alias("next_at"),
            flag.alias("counts_in_totals"))

    lines = (
        line(pr, "property", F.col("status"), F.col("name"), F.lit(None), F.lit(True))
        .unionByName(line(i, "issue", F.col("status"), F.col("priority"), F.col("due_at"),
                          F.col("status") != "closed"))
        .unionByName(line(s, "system", F.col("condition"), F.col("system_type"), F.lit(None),
                          F.col("condition").isin(*ATTENTION)))
        .unionByName(line(c_hit, "commitment", F.col("status"), F.col("commitment_type"),
                          F.coalesce(F.col("starts_at"), F.col("due_at")), is_upcoming(c_hit, as_of)))
    )
    names = F.array(*map(F.lit, SECTIONS))
    lines = _sorted_lines(lines, ranges) if property_id is None else lines.orderBy("tenant_id", "section", "item_id")
    return lines.withColumn("section", F.element_at(names, F.col("section") + 1))


def agenda(commitments: DataFrame, as_of: Column, n: int) -> DataFrame:
    """Next ``n`` upcoming commitments across the portfolio (top-k feature)."""
    c = commitments.where(is_upcoming(commitments, as_of))
    return c.select("id", "tenant_id", "property_id", "title",
                    F.coalesce(F.col("starts_at"), F.col("due_at")).alias("next_at")) \
        .orderBy(F.col("next_at").asc(), F.col("id").asc()).limit(n)


def repeated_issues(issues: DataFrame) -> DataFrame:
    """Categories reported on more than one property, per tenant.

    Two-level aggregate (distinct pairs, then count) instead of
    count_distinct so a hot category never holds a set in one task."""
    pairs = issues.select("tenant_id", "category", "property_id").distinct()
    return pairs.groupBy("tenant_id", "category").agg(F.count("*").alias("properties")) \
        .where(F.col("properties") > 1)


def by_property(df: DataFrame, tenant_id: str, property_id: str | None = None) -> DataFrame:
    """Tenant predicate plus an optional property predicate (F3).  With a
    property, tenant-wide rows (null property) drop out, as in the service."""
    d = df.where(F.col("tenant_id") == tenant_id)
    return d if not property_id else d.where(F.col("property_id") == property_id)
