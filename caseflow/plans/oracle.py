"""DuckDB restatement of the entity views, for the correctness oracle.

These CTEs re-derive each entity from the driver tables independently of the
Spark code in ``views.py`` (plain CASE / arithmetic / joins).  ``with_views``
prefixes a query with the CTEs it names, pulling in their dependencies.
"""

from __future__ import annotations

AS_OF_SQL = "TIMESTAMP '1998-06-01 00:00:00'"
EVENTS_AS_OF_SQL = "TIMESTAMP '2024-01-15 00:00:00'"

_T = "CAST({} AS VARCHAR)"


def v(col: str) -> str:
    return _T.format(col)


ROLE_PERMS_SQL = """
CASE role
  WHEN 'platform_owner' THEN ['tenant.manage','members.manage','customers.view','customers.manage','cases.view',
    'cases.manage','quotes.view','quotes.manage','quotes.approve','services.view','services.manage','billing.view',
    'billing.prepare','billing.issue','messages.prepare','messages.approve','messages.send','reports.view',
    'audit.view','integrations.manage','portfolio.view','portfolio.manage']
  WHEN 'administrator' THEN ['tenant.manage','members.manage','customers.view','customers.manage','cases.view',
    'cases.manage','quotes.view','quotes.manage','quotes.approve','services.view','services.manage','billing.view',
    'billing.prepare','messages.prepare','messages.approve','messages.send','reports.view',
    'audit.view','integrations.manage','portfolio.view','portfolio.manage']
  WHEN 'collaborator' THEN ['customers.view','customers.manage','cases.view','cases.manage','quotes.view',
    'quotes.manage','services.view','services.manage','billing.view','billing.prepare','messages.prepare',
    'reports.view','portfolio.view','portfolio.manage']
  ELSE ['cases.view','quotes.view','services.view','billing.view']
END"""

VIEWS: dict[str, tuple[list[str], str]] = {
    "tenants_v": ([], f"""
SELECT 'tenant-' || {v('n_nationkey')} AS id,
  CASE n_nationkey % 4 WHEN 0 THEN 'pcdoctor' WHEN 1 THEN 'iapro' WHEN 2 THEN 'photography_studio'
    ELSE 'condominium_management' END AS playbook,
  CASE WHEN n_nationkey % 7 = 6 THEN 'suspended' ELSE 'active' END AS status
FROM nation"""),
    "memberships_v": ([], f"""
SELECT id, tenant_id, user_id, role, {ROLE_PERMS_SQL} AS permissions, status FROM (
  SELECT 'tenant-' || {v('c_nationkey')} || '__user-' || {v('c_custkey')} AS id,
    'tenant-' || {v('c_nationkey')} AS tenant_id, 'user-' || {v('c_custkey')} AS user_id,
    CASE c_custkey % 4 WHEN 0 THEN 'platform_owner' WHEN 1 THEN 'administrator' WHEN 2 THEN 'collaborator'
      ELSE 'customer' END AS role,
    CASE WHEN c_custkey % 17 = 0 THEN 'suspended' ELSE 'active' END AS status
  FROM customer)"""),
    "users_v": ([], f"""
SELECT 'user-' || {v('c_custkey')} AS uid, 'user' || {v('c_custkey')} || '@example.invalid' AS email,
  c_custkey % 3 <> 1 AS profile_complete,
  CASE WHEN c_custkey % 17 = 0 THEN 'suspended' WHEN c_custkey % 3 <> 1 THEN 'pending_access'
    ELSE 'pending_profile' END AS status
FROM customer"""),
    "invitations_v": ([], f"""
SELECT 'tenant-' || {v('(c_nationkey + c_custkey % 3) % 25')} AS tenant_id,
  CASE WHEN c_custkey % 4 = 0 THEN upper('user' || {v('c_custkey')} || '@example.invalid')
    ELSE 'user' || {v('c_custkey')} || '@example.invalid' END AS email,
  CASE (c_custkey // 5) % 3 WHEN 0 THEN 'administrator' WHEN 1 THEN 'collaborator' ELSE 'customer' END AS role,
  CASE WHEN c_custkey % 10 = 0 THEN []::VARCHAR[] ELSE ['cases.view', 'quotes.view'] END AS permissions,
  'pending' AS status
FROM customer WHERE c_custkey % 5 = 0"""),
    "properties_v": ([], f"""
SELECT 'prop-' || {v('s.s_suppkey')} AS id, 'tenant-' || {v('s.s_nationkey')} AS tenant_id, s.s_name AS name,
  CASE WHEN s.s_suppkey % 9 = 0 THEN 'onboarding' ELSE 'active' END AS status,
  CASE WHEN s.s_suppkey % 2 = 0 THEN 'user-' || {v('x.lo')} END AS administrator_user_id,
  CASE WHEN s.s_suppkey % 3 = 0 AND x.hi IS NOT NULL THEN 'user-' || {v('x.hi')} ELSE 'system' END AS created_by
FROM supplier s LEFT JOIN (
  SELECT c_nationkey, min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer
  WHERE c_custkey % 4 = 2 AND c_custkey % 17 <> 0 GROUP BY c_nationkey) x ON s.s_nationkey = x.c_nationkey"""),
    "issues_v": ([], f"""
SELECT substr(sha256(concat_ws('|', {v('l.l_orderkey')}, {v('l.l_linenumber')}, {v('l.l_partkey')},
    {v('l.l_suppkey')})), 1, 32) AS id,
  'tenant-' || {v('s.s_nationkey')} AS tenant_id, 'prop-' || {v('l.l_suppkey')} AS property_id,
  CASE l.l_orderkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS priority,
  CASE WHEN l.l_linestatus = 'F' THEN 'closed' ELSE 'reported' END AS status,
  l.l_partkey % 15 AS category_no, l.l_shipdate AS due_at
FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey"""),
    "systems_v": ([], f"""
SELECT substr(sha256(concat_ws('|', {v('d.l_suppkey')}, {v('d.l_partkey')})), 1, 32) AS id,
  'tenant-' || {v('s.s_nationkey')} AS tenant_id, 'prop-' || {v('d.l_suppkey')} AS property_id,
  CASE p.p_size % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'operational' WHEN 2 THEN 'attention'
    ELSE 'critical' END AS condition, d.l_partkey % 17 AS type_no
FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) d
JOIN part p ON d.l_partkey = p.p_partkey JOIN supplier s ON d.l_suppkey = s.s_suppkey"""),
    "commitments_v": ([], f"""
SELECT substr(sha256(concat_ws('|', {v('l.l_orderkey')}, {v('l.l_linenumber')}, {v('l.l_partkey')},
    {v('l.l_suppkey')})), 1, 32) AS id,
  'tenant-' || {v('s.s_nationkey')} AS tenant_id,
  CASE WHEN l.l_orderkey % 10 <> 0 THEN 'prop-' || {v('l.l_suppkey')} END AS property_id,
  CASE WHEN l.l_orderkey % 5 <> 1 THEN l.l_shipdate END AS starts_at,
  o.o_orderdate AS due_at,
  CASE l.l_orderkey % 3 WHEN 0 THEN 'scheduled' WHEN 1 THEN 'done' ELSE 'cancelled' END AS status,
  l.l_orderkey % 6 AS type_no
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey"""),
    "audit_v": ([], f"""
SELECT ts AS timestamp, 'evt-' || {v('event_id')} AS event_id, event_id AS eid,
  CASE event_type WHEN 'signup' THEN 'customer_created' WHEN 'view' THEN 'case_created'
    WHEN 'click' THEN 'agent_decision_completed'
    WHEN 'error' THEN CASE WHEN event_id % 3 = 0 THEN 'agent_retry' ELSE 'agent_error' END
    WHEN 'purchase' THEN 'human_approval_completed' END AS event_name,
  'tenant-' || {v('user_id % 25')} AS tenant_id, 'contact-' || {v('user_id')} AS customer_id,
  'case-' || {v('user_id')} AS case_id, 'agent-' || {v('user_id % 6')} AS agent_id,
  CASE WHEN event_type IN ('click', 'error') THEN 'model-' || {v('user_id % 2')} END AS model,
  CASE WHEN event_type IN ('click', 'error') THEN 'req-' || {v('event_id')} END AS request_reference,
  CASE WHEN event_type IN ('click', 'error') THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS input_tokens,
  CASE WHEN event_type IN ('click', 'error') THEN CAST(json_extract(props, '$.k') AS BIGINT) * 3 END AS output_tokens,
  CASE WHEN event_type = 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'edited'
      ELSE 'rejected' END
    WHEN event_type = 'click' THEN 'required' ELSE 'not_required' END AS human_approval,
  CAST(trunc(value * 100) AS BIGINT) AS duration_ms,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status,
  value
FROM events"""),
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with the CTEs ``names`` (and their dependencies)."""
    order: list[str] = []

    def visit(n: str):
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]}\n)" for n in order)
    return f"WITH {ctes}\n{body}"
