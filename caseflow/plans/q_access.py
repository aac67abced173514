"""Access queries: F1, F6-F9, J2-J4, J7, J8, J12, T11, T12, U1, W1."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators import access as AC
from caseflow.plans import views as V
from caseflow.plans.oracle import with_views
from caseflow.plans.registry import query

_M = ["memberships_v"]


@query("tenant_scope", """
SELECT 'case-' || CAST(o.o_orderkey AS VARCHAR) AS id, o.o_totalprice AS amount FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_nationkey = 7""")
def q_tenant_scope(t):
    c = AC.tenant_scope(V.cases(t), "tenant-7")
    return c.join(t.orders.select(F.concat(F.lit("case-"), F.col("o_orderkey").cast("string")).alias("id"),
                                  F.col("o_totalprice").alias("amount")), "id").select("id", "amount")


@query("active_memberships", with_views("""
SELECT id, tenant_id, user_id, role FROM memberships_v WHERE status = 'active'""", *_M))
def q_active_memberships(t):
    return AC.active_memberships(V.memberships(t)).select("id", "tenant_id", "user_id", "role")


@query("pending_invitations", with_views("""
SELECT tenant_id, email, role FROM invitations_v WHERE status = 'pending' AND tenant_id = 'tenant-3'""",
                                         "invitations_v"))
def q_pending_invitations(t):
    return AC.pending_invitations(V.invitations(t), "tenant-3").select("tenant_id", "email", "role")


@query("tenant_members", with_views("""
SELECT m.id AS membership_id, m.tenant_id, m.user_id, m.role, m.status AS membership_status, u.uid,
  'Customer#' || lpad(substr(u.uid, 6), 9, '0') AS display_name, u.email, NULL::VARCHAR AS photo_url,
  u.status AS user_status
FROM memberships_v m LEFT JOIN users_v u ON u.uid = m.user_id""", "memberships_v", "users_v"))
def q_tenant_members(t):
    return AC.tenant_members(V.memberships(t), V.users(t))


@query("session_memberships", with_views("""
SELECT m.id, m.tenant_id, m.user_id, m.role, t.playbook FROM memberships_v m JOIN tenants_v t ON t.id = m.tenant_id
WHERE m.status = 'active' AND t.status = 'active'""", "memberships_v", "tenants_v"))
def q_session_memberships(t):
    return AC.session_memberships(V.memberships(t), V.tenants(t)).select("id", "tenant_id", "user_id", "role",
                                                                         "playbook")


_ACCEPT = """
SELECT i.tenant_id, u.uid, i.role, i.permissions, i.email FROM invitations_v i JOIN users_v u
  ON lower(i.email) = lower(u.email) WHERE i.status = 'pending'"""


@query("accept_invitations", with_views(f"""
SELECT a.tenant_id || '__' || a.uid AS id, a.tenant_id, a.uid AS user_id, a.role,
  len(a.permissions) = 0 AS role_defaults,
  CASE WHEN len(a.permissions) > 0 THEN len(a.permissions) ELSE CASE a.role WHEN 'administrator' THEN 21
    WHEN 'collaborator' THEN 14 ELSE 4 END END AS permission_count
FROM ({_ACCEPT}) a
WHERE NOT EXISTS (SELECT 1 FROM memberships_v m WHERE m.tenant_id = a.tenant_id AND m.user_id = a.uid)""",
                                        "invitations_v", "users_v", "memberships_v"))
def q_accept_invitations(t):
    inv = V.invitations(t)
    new, _ = AC.accept_invitations(inv, V.users(t), V.memberships(t))
    # was the invitation's own list empty?  (recover it by key)
    empty = inv.select("tenant_id", F.lower("email").alias("_e"), (F.size("permissions") == 0).alias("role_defaults"))
    u = V.users(t).select(F.col("uid").alias("user_id"), F.lower("email").alias("_e"))
    flags = empty.join(u, "_e").drop("_e")
    return new.join(flags, ["tenant_id", "user_id"]).select(
        "id", "tenant_id", "user_id", "role", "role_defaults", F.size("permissions").alias("permission_count"))


@query("accepted_invitations", with_views(f"""
SELECT a.tenant_id, a.email, a.uid AS accepted_by, 'accepted' AS status FROM ({_ACCEPT}) a""",
                                          "invitations_v", "users_v"))
def q_accepted_invitations(t):
    _, acc = AC.accept_invitations(V.invitations(t), V.users(t), V.memberships(t))
    return acc.select("tenant_id", "email", "accepted_by", "status")


@query("access_matrix", with_views("""
SELECT tenant_id, user_id, unnest(CASE WHEN role = 'platform_owner' THEN
  ['tenant.manage','members.manage','customers.view','customers.manage','cases.view',
    'cases.manage','quotes.view','quotes.manage','quotes.approve','services.view','services.manage','billing.view',
    'billing.prepare','billing.issue','messages.prepare','messages.approve','messages.send','reports.view',
    'audit.view','integrations.manage','portfolio.view','portfolio.manage'] ELSE permissions END) AS permission
FROM memberships_v WHERE status = 'active'""", *_M))
def q_access_matrix(t):
    return AC.access_matrix(V.memberships(t))


_CASES_SQL = """
SELECT 'case-' || CAST(o.o_orderkey AS VARCHAR) AS case_id, 'tenant-' || CAST(c.c_nationkey AS VARCHAR) AS tenant_id,
  'user-' || CAST(o.o_custkey AS VARCHAR) AS customer_user_id
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey"""


@query("visible_cases", with_views(f"""
SELECT m.tenant_id, m.user_id,
  CASE WHEN m.role = 'customer'
    THEN (SELECT count(*) FROM ({_CASES_SQL}) k WHERE k.tenant_id = m.tenant_id AND k.customer_user_id = m.user_id)
    ELSE (SELECT count(*) FROM ({_CASES_SQL}) k WHERE k.tenant_id = m.tenant_id) END AS visible_cases
FROM memberships_v m WHERE m.status = 'active' AND (m.role = 'platform_owner' OR list_contains(m.permissions,
  'cases.view'))""", *_M))
def q_visible_cases(t):
    return AC.visible_case_counts(V.cases(t), V.memberships(t))


@query("lookup_case", f"""
SELECT 'look-' || CAST(c.c_custkey AS VARCHAR) AS request_id, k.tenant_id, k.case_id AS id
FROM customer c JOIN ({_CASES_SQL}) k ON k.case_id = 'case-' || CAST(c.c_custkey * 10 + c.c_custkey % 10 AS VARCHAR)
  AND k.tenant_id = 'tenant-' || CAST(c.c_nationkey AS VARCHAR)""")
def q_lookup_case(t):
    return AC.lookup(V.cases(t).select("id", "tenant_id"), V.case_lookups(t)).select("request_id", "tenant_id", "id")


# bootstrap tenants: the first tenant of each playbook
_BOOT = ["tenant-0", "tenant-1", "tenant-2", "tenant-3"]


@query("bootstrap_owner", with_views("""
SELECT b.t || '__' || m.user_id AS id, b.t AS tenant_id, m.user_id, 'platform_owner' AS role, 'active' AS status
FROM memberships_v m, (VALUES ('tenant-0'), ('tenant-1'), ('tenant-2'), ('tenant-3')) b(t)
WHERE m.role = 'platform_owner' AND b.t || '__' || m.user_id NOT IN (SELECT id FROM memberships_v)""", *_M))
def q_bootstrap_owner(t):
    owners = V.memberships(t).where(F.col("role") == "platform_owner").select(F.col("user_id").alias("uid"))
    return AC.bootstrap_owner(owners, _BOOT, V.memberships(t))


@query("user_status", with_views("""
SELECT u.uid, CASE WHEN u.profile_complete THEN CASE WHEN coalesce(n.k, 0) > 0 THEN 'active' ELSE 'pending_access' END
  ELSE u.status END AS status, coalesce(n.k, 0) AS active_memberships
FROM users_v u LEFT JOIN (SELECT user_id, count(*) AS k FROM memberships_v WHERE status = 'active'
  GROUP BY user_id) n ON n.user_id = u.uid""", "users_v", "memberships_v"))
def q_user_status(t):
    return AC.user_status(V.users(t), V.memberships(t))


_UPD = """
per AS (SELECT c_nationkey AS n, min(c_custkey) FILTER (WHERE c_custkey % 4 = 1 AND c_custkey % 17 <> 0) AS admin,
    min(c_custkey) FILTER (WHERE c_custkey % 4 = 0 AND c_custkey % 17 <> 0) AS owner,
    min(c_custkey) FILTER (WHERE c_custkey % 21 = 0) AS s1, min(c_custkey) FILTER (WHERE c_custkey % 7 = 2) AS s2,
    min(c_custkey) FILTER (WHERE c_custkey % 7 = 4) AS s3, min(c_custkey) FILTER (WHERE c_custkey % 7 = 5) AS s4
  FROM customer GROUP BY c_nationkey),
sev AS (SELECT c_custkey AS k, per.* FROM customer JOIN per ON n = c_nationkey WHERE c_custkey % 7 = 0),
vw AS (SELECT ['cases.view'] AS v, ['cases.view', 'members.manage'] AS m, ['cases.view', 'cases.manage'] AS b),
raw AS (
  SELECT n, admin AS a, k AS t, k * 20 AS no, 'customer' AS role, v AS p, 'active' AS status FROM sev, vw
  UNION ALL SELECT n, owner, k, k * 20 + 5, 'customer', v, 'active' FROM sev, vw WHERE k % 28 = 0
  UNION ALL SELECT n, admin, k, k * 20 + 10, 'collaborator', CASE WHEN k % 21 = 0 THEN m ELSE b END,
    CASE WHEN k % 2 = 0 AND k % 21 <> 0 THEN 'suspended' ELSE 'active' END FROM sev, vw
  UNION ALL SELECT n, admin, k, k * 20 + 12, 'platform_owner', b, 'active' FROM sev, vw WHERE k % 35 = 0
  UNION ALL SELECT n, s1, admin, s1 * 20 + 15, 'administrator', v, 'active' FROM per, vw
  UNION ALL SELECT n, s1, s2, s1 * 20 + 16, 'collaborator', m, 'active' FROM per, vw
  UNION ALL SELECT n, s2, s3, s1 * 20 + 17, 'collaborator', m, 'active' FROM per, vw
  UNION ALL SELECT n, s3, s4, s1 * 20 + 18, 'administrator', m, 'active' FROM per, vw
  UNION ALL SELECT n, s4, s1, s1 * 20 + 19, 'collaborator', m, 'suspended' FROM per, vw
  UNION ALL SELECT n, s1, s2, s1 * 20 + 21, 'customer', v, 'active' FROM per, vw
  UNION ALL SELECT n, owner, admin, s1 * 20 + 2000, 'administrator', m, 'active' FROM per, vw),
upd AS (
  SELECT 'tenant-' || CAST(n AS VARCHAR) AS tenant_id, 'user-' || CAST(t AS VARCHAR) AS user_id,
    'user-' || CAST(a AS VARCHAR) AS actor_user_id, CAST(no AS BIGINT) AS update_no, role, p AS permissions, status,
    row_number() OVER (PARTITION BY n ORDER BY no) AS rn
  FROM raw WHERE a IS NOT NULL AND t IS NOT NULL AND no IS NOT NULL),
given AS (SELECT tenant_id, user_id, {'role': role, 'permissions': permissions, 'status': status} AS m
  FROM memberships_v),
walk AS (
  SELECT DISTINCT tenant_id, CAST(0 AS BIGINT) AS rn, CAST(MAP {} AS MAP(VARCHAR, STRUCT(role VARCHAR,
      permissions VARCHAR[], status VARCHAR))) AS st,
    CAST(NULL AS BIGINT) AS update_no, '' AS user_id, '' AS actor_user_id, '' AS role, '' AS status,
    CAST(NULL AS VARCHAR) AS error
  FROM upd
  UNION ALL
  SELECT tenant_id, rn, CASE WHEN error IS NULL THEN map_concat(st, MAP {user_id:
      {'role': role, 'permissions': permissions, 'status': status}}) ELSE st END,
    update_no, user_id, actor_user_id, role, status, error
  FROM (
    SELECT *, CASE WHEN a IS NULL OR a.status <> 'active' OR NOT (a.role = 'platform_owner'
          OR list_contains(a.permissions, 'members.manage')) THEN 'member_management_forbidden'
        WHEN role NOT IN ('administrator', 'collaborator', 'customer') THEN 'invalid_member_update'
        WHEN g IS NULL THEN 'membership_not_found'
        WHEN g.role = 'platform_owner' AND a.role <> 'platform_owner' THEN 'platform_owner_protected' END AS error
    FROM (
      SELECT u.*, w.st, coalesce(map_extract(w.st, u.actor_user_id)[1], ga.m) AS a,
        coalesce(map_extract(w.st, u.user_id)[1], gt.m) AS g
      FROM walk w JOIN upd u ON u.tenant_id = w.tenant_id AND u.rn = w.rn + 1
      LEFT JOIN given ga ON ga.tenant_id = u.tenant_id AND ga.user_id = u.actor_user_id
      LEFT JOIN given gt ON gt.tenant_id = u.tenant_id AND gt.user_id = u.user_id))),
dec AS (SELECT * FROM walk WHERE rn > 0)"""


def _walk_sql(tail):
    return with_views(", " + _UPD.strip() + tail, *_M).replace("\n, per", ",\nper").replace("WITH", "WITH RECURSIVE", 1)


@query("member_update_decisions", _walk_sql("""
SELECT update_no, tenant_id, user_id, actor_user_id, role, status, error FROM dec"""))
def q_member_update_decisions(t):
    d, _ = AC.apply_member_updates(V.memberships(t), V.member_updates(t))
    return d


@query("apply_member_updates", _walk_sql(""",
win AS (SELECT tenant_id, user_id, arg_max(role, update_no) AS role, arg_max(status, update_no) AS status
  FROM dec WHERE error IS NULL GROUP BY ALL)
SELECT m.id, m.tenant_id, m.user_id, coalesce(w.role, m.role) AS role, coalesce(w.status, m.status) AS status,
  w.role IS NOT NULL AS updated
FROM memberships_v m LEFT JOIN win w ON w.tenant_id = m.tenant_id AND w.user_id = m.user_id"""))
def q_apply_member_updates(t):
    _, after = AC.apply_member_updates(V.memberships(t), V.member_updates(t))
    return after.drop("permissions")


@query("role_permissions", with_views("""
SELECT id, role, len(list_filter(permissions, lambda p: p NOT IN ('tenant.manage', 'members.manage', 'billing.issue')))
    AS assignable,
  len(list_filter(permissions, lambda p: p IN ('tenant.manage', 'members.manage', 'billing.issue'))) AS reserved,
  '' AS missing_defaults
FROM memberships_v""", *_M))
def q_role_permissions(t):
    return AC.role_permissions(V.memberships(t))


@query("latest_per_key", """
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey,
  arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus,
  arg_max(o_orderdate, (o_orderdate, o_orderkey)) AS o_orderdate
FROM orders GROUP BY o_custkey""")
def q_latest_per_key(t):
    o = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return AC.latest_per_key(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])
