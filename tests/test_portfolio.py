"""Children a member sees (J6), against a loop over members and children."""

import re

import pytest
from pyspark.sql import functions as F

from caseflow.operators import portfolio as P

VIEW = ["portfolio.view"]
MEMBERS = [  # tenant, user, role, permissions, status
    ("t1", "owner", "platform_owner", [], "active"), ("t1", "adm", "administrator", VIEW, "active"),
    ("t1", "blind", "administrator", ["cases.view"], "active"), ("t1", "col", "collaborator", VIEW, "active"),
    ("t1", "col2", "collaborator", VIEW, "active"), ("t1", "gone", "collaborator", VIEW, "suspended"),
    ("t1", "idle", "customer", VIEW, "active"), ("t2", "col", "collaborator", VIEW, "active"),
    ("t3", "gone", "administrator", VIEW, "suspended")]
PROPERTIES = [  # tenant, id, administrator, creator
    ("t1", "p1", "col", "col2"), ("t1", "p2", "col", "col"), ("t1", "p3", "gone", "adm"), ("t1", "p4", None, "col2"),
    ("t2", "p5", "col", None), ("t2", "p1", "col2", "owner"), ("t3", "p6", "gone", "gone")]
CHILDREN = [("commitment" if i % 2 else "issue", f"c{i}-{t}-{p}", t, p) for i in range(2)
            for t in ("t1", "t2", "t3", None) for p in ("p1", "p2", "p3", "p4", "p5", "p6", "none", None)]


def seen_by(tenant, user):
    """Kept children in the order of the service: properties first, then children."""
    roles = [(r, ps) for t, u, r, ps, st in MEMBERS
             if (t, u, st) == (tenant, user, "active") and (r == "platform_owner" or "portfolio.view" in ps)]
    if not roles:
        return set()
    wide = any(r in ("platform_owner", "administrator") for r, _ in roles)
    props = {p for t, p, a, c in PROPERTIES if t == tenant and (wide or user in (a, c))}
    return {i for k, i, t, p in CHILDREN if t == tenant and (p in props or (p is None and k == "commitment"))}


@pytest.fixture(scope="module")
def frames(spark):
    return (spark.createDataFrame(CHILDREN, "kind string, id string, tenant_id string, property_id string"),
            spark.createDataFrame(PROPERTIES, "tenant_id string, id string, administrator_user_id string, created_by string"),
            spark.createDataFrame(MEMBERS, "tenant_id string, user_id string, role string, permissions array<string>, "
                                           "status string"))


def test_grants_expand_to_what_each_member_sees(frames):
    rows = P.member_children(*frames, F.col("kind") == "commitment").collect()
    assert len(rows) == len(set(rows))
    for t, u, role, perms, status in MEMBERS:
        views = status == "active" and (role == "platform_owner" or "portfolio.view" in perms)
        wide = views and role in ("platform_owner", "administrator")
        got = {r.id for r in rows if r.tenant_id == t and views and (
            r.user_id == u or r.scope == "members" or (wide and r.scope == "tenant"))}
        assert got == seen_by(t, u), (t, u)
    assert {r.user_id for r in rows} == {None, "col", "col2"}


@pytest.mark.parametrize("few", [1000, 0])
def test_children_stay_where_they_are_for_few_grants(spark, frames, few, monkeypatch):
    want = sorted(map(str, P.member_children(*frames, F.col("kind") == "commitment").collect()))
    monkeypatch.setattr(P, "FEW_GRANTS", few)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # as with tables above it
    try:
        out = P.member_children(*frames, F.col("kind") == "commitment")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert ("hashpartitioning" in plan) == (few == 0)
        assert sorted(map(str, out.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_one_member(frames):
    for t, u in [("t1", "adm"), ("t1", "col2"), ("t1", "idle"), ("t1", "gone"), ("t2", "col"), ("t2", "adm")]:
        got = P.children_of_member(*frames, t, u, F.col("kind") == "commitment")
        assert got.columns == frames[0].columns
        ids = [r.id for r in got.collect()]
        assert len(ids) == len(set(ids)) and set(ids) == seen_by(t, u)


def test_children_without_property_are_hidden_by_default(frames):
    assert P.member_children(*frames).where("property_id is null").isEmpty()


def test_the_brief_reads_the_commitments_once(spark):
    from caseflow.plans import views as V
    from caseflow.sources.tables import Tables
    from tests.conftest import SF_SMALL
    t = Tables(spark, SF_SMALL)
    brief = P.portfolio_brief(V.properties(t), V.issues(t), V.systems(t), V.commitments(t), V.ts(V.AS_OF))
    plan = brief._jdf.queryExecution().optimizedPlan().toString()
    # of the brief's tables only the commitments read the orders
    assert sum("o_orderkey" in line for line in plan.splitlines() if "Relation [" in line) == 1


IDS = ["ab12", "ab1x", "AB12", "Ab12", "abc", "a", "", "0", "00", "0011", "deadbeef", "deadbeef00", "deadbeeg", "prop-1",
       "ab12 ", " ab12", "ñandú", "ffff", "FFFF", "fff", "٣٤", None, "ab12"]


def _brief(spark):
    when = "timestamp_ntz'2024-01-0{} 00:00:00'"
    props = spark.createDataFrame([("t1", "p1", "n1", "active"), ("t2", "ab12", None, None), ("t1", "p2", "n\n2", "active")],
                                  "tenant_id string, id string, name string, status string")
    rows = [(t, i, p) for i in IDS for t in ("t1", "t2") for p in ("p1", "ab12", "gone", None)]
    base = spark.createDataFrame(rows, "tenant_id string, id string, property_id string")
    issues = base.selectExpr("*", "'low' AS priority", "if(id = 'ffff', null, 'closed') AS status",
                             f"{when.format(1)} AS due_at")
    systems = base.selectExpr("*", "'critical' AS condition", "if(id = '', null, 'gate\n') AS system_type")
    commitments = base.selectExpr("*", "'scheduled' AS status", "'task' AS commitment_type",
                                  f"{when.format(2)} AS starts_at", f"{when.format(1)} AS due_at")
    as_of = F.expr(when.format(2))
    return P.portfolio_brief(props, issues, systems, commitments, as_of), rows


def test_the_brief_keeps_every_id_and_sorts_mixed_ones_as_text(spark):
    brief, rows = _brief(spark)
    got = [tuple(r) for r in brief.collect()]
    known = {("t1", "p1"), ("t2", "ab12"), ("t1", "p2")}
    day = [r.next_at for r in brief.where("section = 'commitment'").select("next_at").distinct().collect()]
    early = [r.next_at for r in brief.where("section = 'issue'").select("next_at").distinct().collect()]
    assert len(day) == len(early) == 1 and early < day
    want = [("t1", "property", "p1", "p1", "active", "n1", None, True), ("t1", "property", "p2", "p2", "active", "n\n2", None, True),
            ("t2", "property", "ab12", "ab12", None, None, None, True)]
    for t, i, p in rows:
        if (t, p) in known:
            want.append((t, "issue", i, p, None if i == "ffff" else "closed", "low", early[0], None if i == "ffff" else False))
            want.append((t, "system", i, p, "critical", None if i == "" else "gate\n", None, True))
        if (t, p) in known or p is None:
            want.append((t, "commitment", i, p, "scheduled", "task", day[0], True))
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    keys = [(t, s, b"" if i is None else b"\1" + i.encode()) for t, s, i, *_ in got]
    assert keys == sorted(keys)


def test_the_brief_is_dealt_out_without_sorting_and_with_packed_ids(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "600")
    try:
        brief, _ = _brief(spark)
        plan = brief._jdf.queryExecution().executedPlan().toString()
        line = next(x for x in plan.splitlines() if "Exchange rangepartitioning" in x)
        # above spark.shuffle.sort.bypassMergeThreshold every map task sorts and spills its lines
        assert int(re.search(r", (\d+)\), ", line).group(1)) <= 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    lines = spark.createDataFrame([("0123456789abcdef" * 2,), ("0123456789ABCDEF" * 2,)], "item_id string").selectExpr(
        "*", "'t' AS tenant_id", "1 AS section", "'p' AS property_id", "'s' AS state", "'d' AS detail",
        "CAST(NULL AS TIMESTAMP_NTZ) AS next_at", "true AS counts_in_totals")
    packed = P._packed(lines)
    assert [(r.code and len(r.code), r.plain and len(r.plain)) for r in packed.collect()] == [(16, None), (None, 32)]


@pytest.mark.parametrize("few", [1000, 0])
def test_the_brief_leaves_the_children_where_they_are_for_few_properties(spark, monkeypatch, few):
    want = sorted(map(str, _brief(spark)[0].collect()))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # as with tables above it
    try:
        monkeypatch.setattr(P, "FEW_PROPERTIES", few)
        brief, _ = _brief(spark)
        plan = brief._jdf.queryExecution().executedPlan().toString()
        left = plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin")
        assert (left == 0) == (few == 1000)
        assert sorted(map(str, brief.collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
