"""Connected components and duplicate groups across kinds of keys, against a
plain search."""

import random

from pyspark.sql import functions as F

from caseflow.operators.components import components
from caseflow.operators.metrics import contact_groups


def plain(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    out = {}
    for x in sorted(near):
        todo = [] if x in out else [x]
        while todo:
            y = todo.pop()
            if y not in out:
                out[y] = x
                todo += near[y]
    return out


def test_components(spark):
    rnd = random.Random(3)
    order = rnd.sample(range(1000, 1200), 200)
    pairs = list(zip(order, order[1:]))                                      # a long chain in any order
    pairs += [(2000, 2000 + i) for i in range(1, 300)] + [(2299, 2500), (2499, 2500)]   # a hub, and a tail
    pairs += [(rnd.randint(0, 99), rnd.randint(0, 99)) for _ in range(60)]
    pairs = [(a, b) for a, b in pairs if a != b]
    df = spark.createDataFrame(pairs + pairs[:20] + [(7000, 7000), (None, 5), (2000, None)], "x long, y long")
    assert {r.id: r.component for r in components(df, "x", "y").collect()} == plain(pairs)
    assert components(df.limit(0), "x", "y").isEmpty()


def test_groups_across_kinds(spark):
    rows = [("a", "t", "099-1", "A@x.ec"), ("b", "t", "0991", "b@x.ec"), ("c", "t", "", "c@x.ec"), ("d", "u", None, "C@X.EC"),
            ("e", "t", "5", None), ("f", "t", "", "")]
    contacts = spark.createDataFrame(rows, "id string, tenant_id string, phone string, email string")
    ids = spark.createDataFrame([("b", "17-1"), ("c", "171"), ("e", "-"), ("f", ""), ("zz", "171"), ("d", None)],
                                "id string, identifier string")
    got = {(r.id, r.tenant_id, r.group_id, r.group_size) for r in contact_groups(contacts, ids).collect()}
    assert got == {("a", "t", "a", 4), ("b", "t", "a", 4), ("c", "t", "a", 4), ("d", "u", "a", 4)}
    assert contact_groups(contacts, ids.limit(0)).where(F.col("group_size") != 2).isEmpty()
