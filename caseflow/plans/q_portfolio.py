"""Portfolio queries (J5, J6, J11, A1-A3, L3, A17) on the derived views."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.operators import portfolio as P
from caseflow.plans import views as V
from caseflow.plans.oracle import AS_OF_SQL, with_views
from caseflow.plans.registry import query

def _as_of():
    return V.ts(V.AS_OF)

_UPCOMING = f"status = 'scheduled' AND coalesce(starts_at, due_at) >= {AS_OF_SQL}"

# children restricted to existing (tenant, property) pairs
_VIS = """
vi AS (SELECT i.* FROM issues_v i JOIN properties_v p ON i.tenant_id = p.tenant_id AND i.property_id = p.id),
vs AS (SELECT s.* FROM systems_v s JOIN properties_v p ON s.tenant_id = p.tenant_id AND s.property_id = p.id),
vc AS (SELECT c.* FROM commitments_v c LEFT JOIN properties_v p ON c.tenant_id = p.tenant_id AND c.property_id = p.id
       WHERE c.property_id IS NULL OR p.id IS NOT NULL)"""


def _with(body, *names):
    sql = with_views("SELECT 1", *names)
    return sql[: sql.rindex("SELECT 1")].rstrip() + ",\n" + _VIS + "\n" + body


@query("portfolio_totals", _with(f"""
SELECT t.id AS tenant_id,
  (SELECT count(*) FROM properties_v p WHERE p.tenant_id = t.id) AS properties,
  (SELECT count(*) FROM vi WHERE vi.tenant_id = t.id AND status <> 'closed') AS open_issues,
  (SELECT count(*) FROM vi WHERE vi.tenant_id = t.id AND status <> 'closed' AND priority = 'critical')
     AS critical_issues,
  (SELECT count(*) FROM vs WHERE vs.tenant_id = t.id AND condition IN ('attention', 'critical'))
     AS systems_requiring_attention,
  (SELECT count(*) FROM vc WHERE vc.tenant_id = t.id AND {_UPCOMING}) AS upcoming_commitments
FROM tenants_v t""", "tenants_v", "properties_v", "issues_v", "systems_v", "commitments_v"))
def q_portfolio_totals(t):
    return P.portfolio_totals(V.tenants(t), V.properties(t), V.issues(t), V.systems(t), V.commitments(t), _as_of())


@query("portfolio_totals_by_property", _with(f"""
SELECT p.tenant_id, p.id AS property_id,
  (SELECT count(*) FROM vi WHERE vi.property_id = p.id AND vi.tenant_id = p.tenant_id AND status <> 'closed')
     AS open_issues,
  (SELECT count(*) FROM vi WHERE vi.property_id = p.id AND vi.tenant_id = p.tenant_id AND status <> 'closed'
     AND priority = 'critical') AS critical_issues,
  (SELECT count(*) FROM vs WHERE vs.property_id = p.id AND vs.tenant_id = p.tenant_id
     AND condition IN ('attention', 'critical')) AS systems_requiring_attention,
  (SELECT count(*) FROM vc WHERE vc.property_id = p.id AND vc.tenant_id = p.tenant_id AND {_UPCOMING})
     AS upcoming_commitments
FROM properties_v p""", "properties_v", "issues_v", "systems_v", "commitments_v"))
def q_property_totals(t):
    return P.property_totals(V.properties(t), V.issues(t), V.systems(t), V.commitments(t), _as_of())


# Oracle for the per-member brief: materialise (user, property) pairs the
# naive way (fine for an oracle at small scale) and count.
_MEMBER_SQL = _with(f"""
, viewers AS (
  SELECT tenant_id, user_id, role FROM memberships_v
  WHERE status = 'active' AND (role = 'platform_owner' OR list_contains(permissions, 'portfolio.view'))),
seen AS (
  SELECT DISTINCT m.tenant_id, m.user_id, p.id AS property_id FROM viewers m JOIN properties_v p
    ON p.tenant_id = m.tenant_id
  WHERE m.role IN ('platform_owner', 'administrator') OR p.administrator_user_id = m.user_id
     OR p.created_by = m.user_id)
SELECT m.tenant_id, m.user_id,
  (SELECT count(*) FROM seen s WHERE s.tenant_id = m.tenant_id AND s.user_id = m.user_id) AS properties,
  (SELECT count(*) FROM seen s JOIN vi ON vi.tenant_id = s.tenant_id AND vi.property_id = s.property_id
     WHERE s.tenant_id = m.tenant_id AND s.user_id = m.user_id AND vi.status <> 'closed') AS open_issues,
  (SELECT count(*) FROM seen s JOIN vi ON vi.tenant_id = s.tenant_id AND vi.property_id = s.property_id
     WHERE s.tenant_id = m.tenant_id AND s.user_id = m.user_id AND vi.status <> 'closed'
       AND vi.priority = 'critical') AS critical_issues,
  (SELECT count(*) FROM seen s JOIN vs ON vs.tenant_id = s.tenant_id AND vs.property_id = s.property_id
     WHERE s.tenant_id = m.tenant_id AND s.user_id = m.user_id AND vs.condition IN ('attention', 'critical'))
     AS systems_requiring_attention,
  (SELECT count(*) FROM vc WHERE vc.tenant_id = m.tenant_id AND {_UPCOMING.replace('status', 'vc.status')}
     AND (vc.property_id IS NULL OR EXISTS (SELECT 1 FROM seen s WHERE s.tenant_id = m.tenant_id
       AND s.user_id = m.user_id AND s.property_id = vc.property_id))) AS upcoming_commitments
FROM viewers m""", "memberships_v", "properties_v", "issues_v", "systems_v", "commitments_v")
_MEMBER_SQL = _MEMBER_SQL.replace(",\n, viewers", ",\nviewers")
_MEMBER_SQL = _MEMBER_SQL.replace("\n, viewers", ",\nviewers")


@query("member_portfolio_totals", _MEMBER_SQL)
def q_member_portfolio_totals(t):
    return P.member_portfolio_totals(V.memberships(t), V.properties(t), V.issues(t), V.systems(t),
                                     V.commitments(t), _as_of())


@query("visible_properties", with_views("""
SELECT tenant_id, user_id, NULL::VARCHAR AS property_id, 'tenant' AS scope FROM memberships_v
WHERE status = 'active' AND role IN ('platform_owner', 'administrator')
  AND (role = 'platform_owner' OR list_contains(permissions, 'portfolio.view'))
UNION ALL
SELECT m.tenant_id, m.user_id, p.id AS property_id,
  CASE WHEN p.administrator_user_id = m.user_id THEN 'assigned' ELSE 'created' END AS scope
FROM memberships_v m JOIN properties_v p ON p.tenant_id = m.tenant_id
WHERE m.status = 'active' AND m.role NOT IN ('platform_owner', 'administrator')
  AND list_contains(m.permissions, 'portfolio.view')
  AND (p.administrator_user_id = m.user_id OR p.created_by = m.user_id)""", "memberships_v", "properties_v"))
def q_visible_properties(t):
    return P.visible_properties(V.properties(t), V.memberships(t))


@query("visible_children", _with("""
SELECT 'system' AS kind, id, tenant_id, property_id FROM vs
UNION ALL SELECT 'issue', id, tenant_id, property_id FROM vi
UNION ALL SELECT 'commitment', c.id, c.tenant_id, c.property_id FROM commitments_v c
  WHERE c.property_id IS NULL AND c.tenant_id IN (SELECT tenant_id FROM properties_v)
  OR EXISTS (SELECT 1 FROM properties_v p WHERE p.tenant_id = c.tenant_id AND p.id = c.property_id)""",
                                "properties_v", "issues_v", "systems_v", "commitments_v"))
def q_visible_children(t):
    props = V.properties(t)
    cols = ["id", "tenant_id", "property_id"]
    s = P.visible_children(V.systems(t).select(*cols), props).select(F.lit("system").alias("kind"), *cols)
    i = P.visible_children(V.issues(t).select(*cols), props).select(F.lit("issue").alias("kind"), *cols)
    c = P.visible_children(V.commitments(t).select(*cols), props, allow_null=True) \
        .select(F.lit("commitment").alias("kind"), *cols)
    return s.unionByName(i).unionByName(c)


# every member with portfolio.view, the properties each holds, and the children under them
@query("member_children", _with("""
, kids AS (SELECT 'system' AS kind, id, tenant_id, property_id FROM systems_v
  UNION ALL SELECT 'issue', id, tenant_id, property_id FROM issues_v
  UNION ALL SELECT 'commitment', id, tenant_id, property_id FROM commitments_v),
mem AS (SELECT tenant_id, user_id, role IN ('platform_owner', 'administrator') AS wide FROM memberships_v
  WHERE status = 'active' AND (role = 'platform_owner' OR list_contains(permissions, 'portfolio.view')))
SELECT k.kind, k.id, k.tenant_id, k.property_id, m.user_id,
  CASE WHEN p.administrator_user_id = m.user_id THEN 'assigned' ELSE 'created' END AS scope
FROM mem m JOIN properties_v p ON p.tenant_id = m.tenant_id
  AND (p.administrator_user_id = m.user_id OR p.created_by = m.user_id)
JOIN kids k ON k.tenant_id = p.tenant_id AND k.property_id = p.id WHERE NOT m.wide
UNION ALL SELECT k.kind, k.id, k.tenant_id, k.property_id, NULL, 'tenant'
FROM kids k JOIN properties_v p ON k.tenant_id = p.tenant_id AND k.property_id = p.id
WHERE k.tenant_id IN (SELECT tenant_id FROM mem WHERE wide)
UNION ALL SELECT k.kind, k.id, k.tenant_id, k.property_id, NULL, 'members'
FROM kids k WHERE k.kind = 'commitment' AND k.property_id IS NULL AND k.tenant_id IN (SELECT tenant_id FROM mem)""",
                              "properties_v", "issues_v", "systems_v", "commitments_v", "memberships_v")
       .replace("\n\n, kids AS", ",\nkids AS"))
def q_member_children(t):
    kids = [V.systems(t).select(F.lit("system").alias("kind"), "id", "tenant_id", "property_id"),
            V.issues(t).select(F.lit("issue").alias("kind"), "id", "tenant_id", "property_id"),
            V.commitments(t).select(F.lit("commitment").alias("kind"), "id", "tenant_id", "property_id")]
    return P.member_children(kids[0].unionByName(kids[1]).unionByName(kids[2]), V.properties(t), V.memberships(t),
                             F.col("kind") == "commitment")


# a sixteenth of the children name a property that does not exist, another
# sixteenth one that (but for the property's own tenant) is not theirs
def _strayed_sql(view: str) -> str:
    return (f"SELECT id, tenant_id, CASE substr(id, 1, 1) WHEN '0' THEN 'prop-none' WHEN '1' THEN 'prop-1' "
            f"ELSE property_id END AS property_id FROM {view}")


def _strayed(children):
    first = F.substring("id", 1, 1)
    return children.withColumn("property_id", F.when(first == "0", "prop-none").when(first == "1", "prop-1")
                               .otherwise(F.col("property_id")))


@query("orphan_report", with_views(f"""
SELECT kind, c.id AS child_id, c.tenant_id, c.property_id
FROM (SELECT 'issue' AS kind, * FROM ({_strayed_sql('issues_v')}) UNION ALL
      SELECT 'system', * FROM ({_strayed_sql('systems_v')}) UNION ALL
      SELECT 'commitment', * FROM ({_strayed_sql('commitments_v')})) c
WHERE c.property_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM properties_v p WHERE p.id = c.property_id AND p.tenant_id = c.tenant_id)""",
                                   "properties_v", "issues_v", "systems_v", "commitments_v"))
def q_orphan_report(t):
    props = V.properties(t)
    return (P.orphan_report(_strayed(V.issues(t)), props, "issue")
            .unionByName(P.orphan_report(_strayed(V.systems(t)), props, "system"))
            .unionByName(P.orphan_report(_strayed(V.commitments(t)), props, "commitment")))


_SYS_TYPES = ("['electric_fence','fire_detection','fire_suppression','cctv','access_control','alarms','elevators',"
              "'pumps','generator','water','lighting','gas','gates','intercom','playground','pool','other']")
_COM_TYPES = "['meeting','task','deadline','assembly','inspection','payment']"


def _brief_sql(prop: str | None) -> str:
    pf = f" AND p.id = '{prop}'" if prop else ""
    cf = f" AND c.property_id = '{prop}'" if prop else " OR c.property_id IS NULL"
    return _with(f"""
SELECT p.tenant_id, 'property' AS section, p.id AS item_id, p.id AS property_id, p.status AS state, p.name AS detail,
  NULL::TIMESTAMP AS next_at, true AS counts_in_totals FROM properties_v p WHERE true{pf}
UNION ALL SELECT vi.tenant_id, 'issue', vi.id, vi.property_id, vi.status, vi.priority, vi.due_at, vi.status <> 'closed'
  FROM vi JOIN properties_v p ON p.id = vi.property_id AND p.tenant_id = vi.tenant_id WHERE true{pf}
UNION ALL SELECT vs.tenant_id, 'system', vs.id, vs.property_id, vs.condition, {_SYS_TYPES}[vs.type_no + 1], NULL,
  vs.condition IN ('attention', 'critical')
  FROM vs JOIN properties_v p ON p.id = vs.property_id AND p.tenant_id = vs.tenant_id WHERE true{pf}
UNION ALL SELECT c.tenant_id, 'commitment', c.id, c.property_id, c.status, {_COM_TYPES}[c.type_no + 1],
  coalesce(c.starts_at, c.due_at), c.status = 'scheduled' AND coalesce(c.starts_at, c.due_at) >= {AS_OF_SQL}
  FROM commitments_v c WHERE EXISTS (SELECT 1 FROM properties_v p WHERE p.id = c.property_id
    AND p.tenant_id = c.tenant_id){cf}""", "properties_v", "issues_v", "systems_v", "commitments_v")


@query("portfolio_brief", _brief_sql(None))
def q_portfolio_brief(t):
    return P.portfolio_brief(V.properties(t), V.issues(t), V.systems(t), V.commitments(t), _as_of())


@query("property_detail", _brief_sql("prop-1"))
def q_property_detail(t):
    # one property's detail (the first supplier's property)
    return P.portfolio_brief(V.properties(t), V.issues(t), V.systems(t), V.commitments(t), _as_of(),
                             property_id="prop-1")


@query("agenda", with_views(f"""
SELECT id, tenant_id, property_id, coalesce(starts_at, due_at) AS next_at FROM commitments_v
WHERE {_UPCOMING} ORDER BY next_at, id LIMIT 50""", "commitments_v"))
def q_agenda(t):
    return P.agenda(V.commitments(t), _as_of(), 50).drop("title")


@query("repeated_issues", with_views("""
SELECT tenant_id, category, count(DISTINCT property_id) AS properties FROM (
  SELECT tenant_id, property_id,
    CASE category_no WHEN 0 THEN 'security' WHEN 1 THEN 'fire_safety' WHEN 2 THEN 'coexistence'
      WHEN 3 THEN 'maintenance' WHEN 4 THEN 'infrastructure' WHEN 5 THEN 'utilities' WHEN 6 THEN 'finance'
      WHEN 7 THEN 'collections' WHEN 8 THEN 'legal' WHEN 9 THEN 'governance' WHEN 10 THEN 'communication'
      WHEN 11 THEN 'staff' WHEN 12 THEN 'supplier' WHEN 13 THEN 'emergency' ELSE 'other' END AS category
  FROM issues_v) GROUP BY tenant_id, category HAVING count(DISTINCT property_id) > 1""", "issues_v"))
def q_repeated_issues(t):
    return P.repeated_issues(V.issues(t))


@query("by_property", with_views("""
SELECT id, tenant_id, property_id, 'all' AS scope FROM commitments_v WHERE tenant_id = 'tenant-3'
UNION ALL
SELECT id, tenant_id, property_id, 'one' FROM commitments_v WHERE tenant_id = 'tenant-3' AND property_id = 'prop-3'""",
                                 "commitments_v"))
def q_by_property(t):
    c = V.commitments(t).select("id", "tenant_id", "property_id")
    return (P.by_property(c, "tenant-3").withColumn("scope", F.lit("all"))
            .unionByName(P.by_property(c, "tenant-3", "prop-3").withColumn("scope", F.lit("one"))))
