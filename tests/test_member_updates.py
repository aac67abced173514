"""Member updates in order, against a plain fold."""

import random

from caseflow.operators import access as AC
from caseflow.schemas import INVITABLE_ROLES, PERMISSIONS

M = "id string, tenant_id string, user_id string, role string, permissions array<string>, status string"
U = ("update_no long, tenant_id string, user_id string, actor_user_id string, role string, permissions array<string>, "
     "status string")


def _fold(members, updates):
    state = {(t, u): (r, p, s) for _, t, u, r, p, s in members}
    errors = {}
    for no, t, user, actor, role, perms, status in sorted(updates, key=lambda u: u[0]):
        a, g = state.get((t, actor)), state.get((t, user))
        if a is None or a[2] != "active" or not (a[0] == "platform_owner" or "members.manage" in a[1]):
            errors[t, no] = "member_management_forbidden"
        elif (role not in INVITABLE_ROLES or perms is None or not set(perms) <= set(PERMISSIONS)
              or status not in ("active", "suspended")):
            errors[t, no] = "invalid_member_update"
        elif g is None:
            errors[t, no] = "membership_not_found"
        elif g[0] == "platform_owner" and a[0] != "platform_owner":
            errors[t, no] = "platform_owner_protected"
        else:
            errors[t, no], state[t, user] = None, (role, perms, status)
    return errors, state


def _check(spark, members, updates):
    d, after = AC.apply_member_updates(spark.createDataFrame(members, M), spark.createDataFrame(updates, U))
    errors, state = _fold(members, updates)
    assert {(r.tenant_id, r.update_no): r.error for r in d.collect()} == errors
    assert {(r.tenant_id, r.user_id): (r.role, r.permissions, r.status) for r in after.collect()} == state
    return errors


def test_actor_demoted_in_mid_batch_and_a_chain_of_five(spark):
    manage, view = ["members.manage"], ["cases.view"]
    members = [(f"t__{u}", "t", u, r, p, "active") for u, r, p in (
        ("owner", "platform_owner", []), ("admin", "administrator", manage), *((f"c{i}", "customer", view) for i in range(6)))]
    updates = [(1, "t", "c0", "admin", "collaborator", manage, "active")]
    updates += [(i + 2, "t", f"c{i + 1}", f"c{i}", "collaborator", manage, "active") for i in range(5)]
    updates += [(10, "t", "admin", "c5", "collaborator", view, "active"), (11, "t", "c0", "admin", "customer", view, "active"),
                (12, "t", "owner", "c5", "customer", view, "active"), (13, "t", "owner", "owner", "customer", view, "active"),
                (14, "t", "owner", "c5", "collaborator", view, "active"), (15, "t", "nobody", "c5", "customer", view, "active"),
                (16, "t", "c1", "c5", "platform_owner", manage, "active"), (17, "t", "c1", "c5", "customer", ["no.such"], "active")]
    errors = _check(spark, members, updates)
    assert [errors["t", n] for n in (6, 10, 11, 12, 13, 14, 16)] == [
        None, None, "member_management_forbidden", "platform_owner_protected", None, None, "invalid_member_update"]


def test_random_batches_equal_the_fold(spark):
    rng = random.Random(11)
    users = [f"u{i}" for i in range(7)]
    members = [(f"{t}__{u}", t, u, rng.choice(["platform_owner", "administrator", "customer"]),
                rng.choice([["members.manage"], ["cases.view"], []]), rng.choice(["active", "active", "suspended"]))
               for t in ("a", "b") for u in users[:6]]
    updates = [(no, rng.choice("ab"), rng.choice(users), rng.choice(users), rng.choice([*INVITABLE_ROLES, "platform_owner"]),
                rng.choice([["members.manage"], ["members.manage"], [], None]), rng.choice(["active", "active", "suspended", "gone"]))
               for no in range(60)]
    _check(spark, members, updates)


def test_no_updates(spark):
    members = [("t__a", "t", "a", "customer", [], "active")]
    assert _check(spark, members, []) == {}


def test_members_who_never_act_are_judged_once(spark, monkeypatch):
    """Their updates change nobody's rights, so no round carries them along."""
    manage, view = ["members.manage"], ["cases.view"]
    members = [("t__admin", "t", "admin", "administrator", manage, "active"), ("t__own", "t", "own", "platform_owner", [], "active")]
    members += [(f"t__{u}", "t", u, "customer", view, "active") for u in ("c0", "c1", "c2", *(f"leaf{i}" for i in range(9)))]
    updates = [(1, "t", "c0", "admin", "collaborator", manage, "active"), (2, "t", "c1", "c0", "collaborator", manage, "active"),
               (3, "t", "c2", "c1", "collaborator", manage, "active"), (4, "t", "admin", "c2", "customer", view, "active"),
               (20, "t", "own", "c2", "customer", view, "active"), (21, "t", "own", "own", "customer", view, "active")]
    updates += [(5 + i, "t", f"leaf{i}", ("admin", "c2", "own")[i % 3], "collaborator", view, "active") for i in range(9)]
    seen, stored = [], AC.stored

    def counted(df, name):
        out = stored(df, name)
        if name == "member-decisions":
            seen.append(out.where("user_id like 'leaf%'").count())
        return out
    monkeypatch.setattr(AC, "stored", counted)
    errors = _check(spark, members, updates)
    assert [errors["t", n] for n in (4, 5, 6, 20, 21)] == [
        None, "member_management_forbidden", None, "platform_owner_protected", None]
    assert sum(seen) == 9 and len(seen) > 3
