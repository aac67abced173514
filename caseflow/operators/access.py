"""Access: memberships, sessions, invitations, permission grants and member
updates (F1, F6-F9, J2-J4, J7, J8, J12, T11, T12, U1).

Visibility is expressed as grants (one tenant-wide row for staff, one row per
owned case for customers) instead of (user, row) pairs, so a hot tenant never
produces a quadratic output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow import schemas as K
from caseflow.functions.validate import errors, member_update_rules
from caseflow.operators.portfolio import has_permission
from caseflow.operators.sequence import last_value_before
from caseflow.plans.views import role_defaults
from caseflow.sources.io import stored


def tenant_scope(df: DataFrame, tenant_id: str) -> DataFrame:
    """Mandatory tenant predicate (partition column when written, so the
    scan prunes to one folder)."""
    return df.where(F.col("tenant_id") == tenant_id)


def active_memberships(memberships: DataFrame, user_id: str | None = None) -> DataFrame:
    m = memberships.where(F.col("status") == "active")
    return m if user_id is None else m.where(F.col("user_id") == user_id)


def pending_invitations(invitations: DataFrame, tenant_id: str | None = None) -> DataFrame:
    i = invitations.where(F.col("status") == "pending")
    return i if tenant_id is None else i.where(F.col("tenant_id") == tenant_id)


def public_member(users: DataFrame) -> DataFrame:
    """The five user fields a member list may show."""
    return users.select("uid", "display_name", "email", "photo_url", "status")


def tenant_members(memberships: DataFrame, users: DataFrame) -> DataFrame:
    """Every membership with its public user fields; user null when missing."""
    u = public_member(users).withColumnRenamed("status", "user_status")
    return memberships.join(u, memberships.user_id == u.uid, "left").select(
        F.col("id").alias("membership_id"), "tenant_id", "user_id", "role", F.col("status").alias("membership_status"),
        "uid", "display_name", "email", "photo_url", "user_status")


def session_memberships(memberships: DataFrame, tenants: DataFrame) -> DataFrame:
    """Active membership joined to its active tenant."""
    t = tenants.where(F.col("status") == "active").select(F.col("id").alias("tenant_id"), "playbook",
                                                          F.col("status").alias("tenant_status"))
    return active_memberships(memberships).join(t, "tenant_id", "inner")


def accept_invitations(invitations: DataFrame, users: DataFrame, memberships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending invitations meet users on lower-cased e-mail.

    Returns (new memberships, accepted invitations).  A membership is created
    only when none exists for (tenant, user) -- a suspended one is not
    revived; an empty permission list takes the role defaults.  Several
    pending invitations of one tenant to one user (e-mails that differ in case)
    make one membership, by the smallest invitation id.  Every matched
    invitation becomes accepted.
    """
    inv = pending_invitations(invitations).withColumn("_email", F.lower("email"))
    u = users.select(F.col("uid"), F.lower("email").alias("_email"))
    matched = inv.join(u, "_email", "inner")
    existing = memberships.select("tenant_id", F.col("user_id").alias("uid"))
    fresh = matched.join(existing, ["tenant_id", "uid"], "left_anti").groupBy("tenant_id", "uid").agg(
        F.min_by("role", "id").alias("role"), F.min_by("permissions", "id").alias("permissions"))
    new = fresh.select(
        F.concat_ws("__", "tenant_id", "uid").alias("id"), "tenant_id", F.col("uid").alias("user_id"), "role",
        F.when(F.size("permissions") > 0, F.col("permissions")).otherwise(role_defaults(F.col("role")))
        .alias("permissions"),
        F.lit("active").alias("status"))
    accepted = matched.select(
        "id", "tenant_id", "email", "role", "permissions", F.lit("accepted").alias("status"), "invited_by",
        F.col("uid").alias("accepted_by"))
    return new, accepted


def access_matrix(memberships: DataFrame) -> DataFrame:
    """(tenant, user, permission) for every permission an active membership
    holds: owners get the whole fixed list, others their own list (J8).
    Built with explode, not a cross join."""
    m = active_memberships(memberships)
    all_perms = F.array(*[F.lit(p) for p in K.PERMISSIONS])
    held = F.when(F.col("role") == "platform_owner", all_perms).otherwise(F.col("permissions"))
    return m.select("tenant_id", "user_id", F.explode(F.array_distinct(held)).alias("permission")) \
        .where(F.col("permission").isin(*K.PERMISSIONS))


def visible_cases(cases: DataFrame, memberships: DataFrame) -> DataFrame:
    """Case grants per member with ``cases.view`` (J7): staff see the whole
    tenant (one grant row), customers only their own cases."""
    m = active_memberships(memberships).where(has_permission(F.col("role"), F.col("permissions"), "cases.view"))
    staff = m.where(F.col("role") != "customer").select(
        "tenant_id", "user_id", F.lit(None).cast("string").alias("case_id"), F.lit("tenant").alias("scope"))
    cust = m.where(F.col("role") == "customer").select("tenant_id", "user_id")
    c = cases.select("tenant_id", F.col("customer_user_id").alias("user_id"), F.col("id").alias("case_id"))
    own = cust.join(c, ["tenant_id", "user_id"], "inner").select("tenant_id", "user_id", "case_id",
                                                                F.lit("own").alias("scope"))
    return staff.unionByName(own)


def visible_case_counts(cases: DataFrame, memberships: DataFrame) -> DataFrame:
    """How many cases each member with ``cases.view`` can see."""
    g = visible_cases(cases, memberships)
    per_tenant = cases.groupBy("tenant_id").agg(F.count("*").alias("tenant_cases"))
    staff = g.where(F.col("scope") == "tenant").join(per_tenant, "tenant_id", "left").select(
        "tenant_id", "user_id", F.coalesce("tenant_cases", F.lit(0)).alias("visible_cases"))
    m = active_memberships(memberships).where(
        (F.col("role") == "customer") & has_permission(F.col("role"), F.col("permissions"), "cases.view"))
    own = g.where(F.col("scope") == "own").groupBy("tenant_id", "user_id").agg(F.count("*").alias("n"))
    cust = m.select("tenant_id", "user_id").join(own, ["tenant_id", "user_id"], "left").select(
        "tenant_id", "user_id", F.coalesce("n", F.lit(0)).alias("visible_cases"))
    return staff.unionByName(cust).select("tenant_id", "user_id", F.col("visible_cases").cast("bigint"))


def lookup(df: DataFrame, requests: DataFrame, key: str = "id") -> DataFrame:
    """Point lookups by (tenant, id): a row of another tenant is never
    returned (F6)."""
    r = requests.select("request_id", "tenant_id", F.col(key).alias("_k"))
    return r.join(df.withColumnRenamed(key, "_k"), ["tenant_id", "_k"], "inner").withColumnRenamed("_k", key)


def bootstrap_owner(owners: DataFrame, owner_tenant_ids: list[str], memberships: DataFrame) -> DataFrame:
    """Owner memberships on the bootstrap tenants that are still missing
    (J12).  The bootstrap tenants are a short deployment constant, so they are
    exploded onto each owner row (no join, no cross product of tables)."""
    ids = F.array(*[F.lit(t) for t in owner_tenant_ids])
    want = owners.select(F.col("uid").alias("user_id"), F.explode(ids).alias("tenant_id")).select(
        F.concat_ws("__", "tenant_id", "user_id").alias("id"), "tenant_id", "user_id",
        F.lit("platform_owner").alias("role"), F.lit("active").alias("status"))
    return want.join(memberships.select("id"), "id", "left_anti")


def user_status(users: DataFrame, memberships: DataFrame) -> DataFrame:
    """Complete profile with >= 1 active membership -> active, else
    pending_access; incomplete profiles keep their status (T11)."""
    n = active_memberships(memberships).groupBy("user_id").agg(F.count("*").alias("active_memberships"))
    j = users.join(n, users.uid == n.user_id, "left")
    cnt = F.coalesce(F.col("active_memberships"), F.lit(0))
    st = F.when(F.col("profile_complete"), F.when(cnt > 0, "active").otherwise("pending_access")) \
        .otherwise(F.col("status"))
    return j.select("uid", st.alias("status"), cnt.cast("bigint").alias("active_memberships"))


def apply_member_updates(memberships: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply role / permission / status updates one after the other.

    updates: update_no (order within a tenant, one row each; equal rows count
    once), tenant_id, user_id (target), actor_user_id, role, permissions,
    status.  Each update is judged on the memberships as all earlier updates
    left them, in this order: the actor needs an active membership with
    ``members.manage`` (or the owner role); the request must pass
    ``member_update_rules`` (nobody is made an owner); the target must exist; an
    owner's row changes only when the actor is an owner.  Returns (decisions,
    memberships after the batch).

    The order is a dependency between actors, not a loop over rows.  Only updates
    of members who act themselves can change what another update may do, so the
    rounds take these only.  A round settles all updates whose actor is no target
    of an earlier open update; the actor's rights then follow from the accepted
    updates on the actor, looked up as of the update's number.  Whether a target
    still is an owner follows from one minimum: only an owner's update can end
    that, and it does.  A round settles at least the first open update of every
    tenant, so the number of rounds is the length of the longest chain of actors
    updating actors.  All other updates are judged in one last step, when the
    rights of every actor at every number are known.
    """
    state = F.struct("role", "permissions", "status")
    before = memberships.select("tenant_id", "user_id", state.alias("m"))
    todo = stored(updates.select("update_no", "tenant_id", "user_id", "actor_user_id", "role", "permissions", "status").distinct()
                  .withColumn("valid", F.size(errors(member_update_rules())) == 0), "member-updates")
    actors = stored(todo.select("tenant_id", "actor_user_id").distinct()
                    .join(before.select("tenant_id", F.col("user_id").alias("actor_user_id"), F.col("m").alias("a_before")),
                          ["tenant_id", "actor_user_id"], "left"), "member-actors")
    acting = actors.select("tenant_id", F.col("actor_user_id").alias("user_id"), F.lit(True).alias("acts")).distinct()
    todo = stored(todo.join(before.select("tenant_id", "user_id", F.col("m.role").alias("t_role")), ["tenant_id", "user_id"], "left")
                  .join(actors, ["tenant_id", "actor_user_id"], "left")
                  .join(acting, ["tenant_id", "user_id"], "left").withColumn("acts", F.coalesce("acts", F.lit(False))),
                  "member-updates")
    rest, todo = todo.where("not acts").drop("acts"), todo.where("acts").drop("acts")
    columns, done = todo.columns, None
    no, a_role = F.col("update_no"), F.col("a.role")
    owner = F.coalesce(F.col("t_role") == "platform_owner", F.lit(False))

    def as_of(todo, done):
        """``a``: the actor's membership as the decided updates left it."""
        if done is None:
            return todo.withColumn("a", F.col("a_before"))
        # of odd and even numbers, a change counts from the next update on
        values = done.where("error is null").select("tenant_id", F.col("user_id").alias("actor_user_id"),
                                                    (2 * F.col("update_no") + 1).alias("at"), state.alias("m"))
        return last_value_before(values, todo.withColumn("at", 2 * F.col("update_no")), ["tenant_id", "actor_user_id"],
                                 "at", "m", "a").withColumn("a", F.coalesce("a", "a_before"))

    def judged(now, settled, changed=None):
        """The error of each update and whether it is decided."""
        allowed = settled & F.coalesce((F.col("a.status") == "active")
                                       & has_permission(a_role, F.col("a.permissions"), "members.manage"), F.lit(False))
        now = (now.withColumn("settled", settled).withColumn("allowed", allowed)
               .withColumn("by_owner", F.col("allowed") & (a_role == "platform_owner")))
        ends = now.where(owner).groupBy("tenant_id", "user_id").agg(
            F.min(F.when(~F.col("settled"), no)).alias("wait"),
            F.min(F.when(F.col("by_owner") & F.col("valid"), no)).alias("ended"))
        now = now.join(ends, ["tenant_id", "user_id"], "left")
        now = now.withColumn("changed", F.lit(None).cast("bigint")) if changed is None else now.join(
            changed, ["tenant_id", "user_id"], "left")
        free = ~owner | F.col("by_owner") | F.coalesce(F.least("ended", "changed") < no, F.lit(False))
        error = (F.when(~F.col("allowed"), "member_management_forbidden").when(~F.col("valid"), "invalid_member_update")
                 .when(F.col("t_role").isNull(), "membership_not_found").when(~free, "platform_owner_protected"))
        return stored(now.select(*columns, error.alias("error"), (F.col("settled") & (
            ~owner | F.coalesce(F.col("wait") > no, F.lit(True)))).alias("decided")), "member-decisions")

    while not todo.isEmpty():
        changed = None if done is None else done.where("error is null").groupBy("tenant_id", "user_id").agg(
            F.min("update_no").alias("changed"))
        first = todo.groupBy("tenant_id", F.col("user_id").alias("actor_user_id")).agg(F.min("update_no").alias("first"))
        now = as_of(todo, done).join(first, ["tenant_id", "actor_user_id"], "left")
        step = judged(now, F.coalesce(F.col("first") >= no, F.lit(True)), changed)
        fresh = step.where("decided").drop("decided")
        done = fresh if done is None else done.unionByName(fresh)
        todo = step.where("not decided").select(*columns)
    last = judged(as_of(rest, done), F.lit(True)).drop("decided")
    done = last if done is None else done.unionByName(last)
    latest = latest_per_key(done.where("error is null").select("tenant_id", "user_id", "update_no", "role", "permissions", "status"),
                            ["tenant_id", "user_id"], [F.col("update_no")]).select(
        "tenant_id", "user_id", F.col("role").alias("n_role"), F.col("permissions").alias("n_perms"),
        F.col("status").alias("n_status"))
    after = memberships.join(latest, ["tenant_id", "user_id"], "left").select(
        "id", "tenant_id", "user_id",
        F.coalesce("n_role", "role").alias("role"), F.coalesce("n_perms", "permissions").alias("permissions"),
        F.coalesce("n_status", "status").alias("status"),
        F.col("n_role").isNotNull().alias("updated"))
    return done.select("update_no", "tenant_id", "user_id", "actor_user_id", "role", "status", "error"), after


def role_permissions(memberships: DataFrame) -> DataFrame:
    """Per membership: permissions a collaborator screen may assign versus
    reserved ones (U1, set difference with ``array_except``)."""
    reserved = F.array(*[F.lit(p) for p in K.NOT_ASSIGNABLE])
    return memberships.select(
        "id", "role",
        F.size(F.array_except("permissions", reserved)).alias("assignable"),
        F.size(F.array_intersect("permissions", reserved)).alias("reserved"),
        F.array_join(F.array_sort(F.array_except(role_defaults(F.col("role")), F.col("permissions"))), ",")
        .alias("missing_defaults"),
    )


def latest_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Current state, last write wins.

    Implemented as a max_by aggregate over a struct of the whole row, which
    runs a map-side partial aggregate: a hot key is reduced before the
    shuffle instead of being sorted in one task."""
    cols = [c for c in df.columns if c not in key]
    row = F.struct(*[F.col(c) for c in cols])
    ordering = F.struct(*order)
    out = df.groupBy(*key).agg(F.max_by(row, ordering).alias("_r"))
    return out.select(*key, *[F.col(f"_r.{c}").alias(c) for c in cols])
