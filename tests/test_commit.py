"""Cases and audit rows of a batch appear together or not at all."""

import os
import tempfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from caseflow.functions.validate import audit_event_rules, errors
from caseflow.operators import commit as CM
from caseflow.plans import views as V
from caseflow.sources.tables import Tables
from tests.conftest import SF_SMALL

ACTIONS = ("case_id string, action_no long, action string, quote_amount_usd decimal(18,2), actor_user_id string, "
           "requested_at timestamp_ntz, note string")
AT = datetime(2026, 1, 2, 3)


@pytest.fixture(scope="module")
def cases(spark):
    return V.cases(Tables(spark, SF_SMALL)).limit(3).cache()


def _store(spark):
    return CM.create_store(spark, os.path.join(tempfile.mkdtemp(prefix="cf-store-"), "s"))


def _actions(spark, rows):
    return spark.createDataFrame([(c, n, a, None, "user-1", AT, note) for c, n, a, note in rows], ACTIONS)


def test_write_back_audit_rows_and_repeats(spark, cases):
    base = _store(spark)
    one, two = sorted(r.id for r in cases.collect())[:2]
    number = {r.id: r.customer_identifier for r in cases.collect()}
    identity = spark.createDataFrame([(number[one], "ruc", True, "LEGAL S.A."), (number[two], None, False, "")],
                                     "identifier string, identifier_type string, locally_valid boolean, legal_name string")
    batch = _actions(spark, [(one, 1, "complete_intake", "hola"), (one, 2, "validate_identity", " "), (one, 3, "approve_quote", None),
                             (two, 1, "complete_intake", None), (two, 2, "validate_identity", None), ("no-case", 1, "complete_intake", None)])
    assert CM.commit_batch(spark, base, 7, cases, batch, identity)
    assert not CM.commit_batch(spark, base, 7, cases, batch, identity)
    got = {r.id: r for r in CM.stored_cases(spark, base, cases).collect()}
    assert (got[one].customer_name, got[one].current_stage, got[one].identity_validation.verified_at) == ("LEGAL S.A.", "discovery", AT)
    assert got[two].current_stage == "identity" and got[two].identity_validation is None and len(got) == 3
    events = CM.read_table(spark, base, "events")
    assert events.withColumn("e", errors(audit_event_rules())).where(F.size("e") > 0).count() == 0
    title = {r.id: r.title for r in cases.collect()}
    assert sorted((r.case_id, r.input_summary, r.result) for r in events.collect()) == sorted([
        (one, "hola", "Expediente actualizado a open."), (one, title[one], "Expediente actualizado a open."),
        (two, title[two], "Expediente actualizado a open.")])
    # the same actions under a new number add nothing, though the rejected one would fit by now
    later = batch.unionByName(_actions(spark, [(one, 4, "complete_discovery", None)]))
    assert CM.commit_batch(spark, base, 8, cases, later, identity)
    assert CM.read_table(spark, base, "events").where("batch = 8").count() == 1
    assert CM.read_table(spark, base, "judged").groupBy("case_id", "action_no").count().where("count > 1").count() == 0


def test_a_batch_that_fails_half_way_is_not_there(spark, cases, monkeypatch):
    base = _store(spark)
    one = cases.first().id
    identity = spark.createDataFrame([], "identifier string, identifier_type string, locally_valid boolean")
    batch = _actions(spark, [(one, 1, "complete_intake", None)])

    def broken(*_):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(CM, "write_back", broken)
        with pytest.raises(RuntimeError):
            CM.commit_batch(spark, base, 0, cases, batch, identity)
    assert CM.read_table(spark, base, "events").isEmpty() and CM.read_table(spark, base, "judged").isEmpty()
    assert CM.commit_batch(spark, base, 0, cases, batch, identity)
    assert CM.read_table(spark, base, "events").count() == 1
    assert {r.id: r.current_stage for r in CM.stored_cases(spark, base, cases).collect()}[one] == "identity"


def test_stored_cases_carry_only_the_columns_asked_for(spark, cases):
    base = _store(spark)
    one = cases.first().id
    identity = spark.createDataFrame([], "identifier string, identifier_type string, locally_valid boolean")
    assert CM.commit_batch(spark, base, 0, cases, _actions(spark, [(one, 1, "complete_intake", None)]), identity)
    whole = CM.stored_cases(spark, base, cases)
    for columns in (["id", "title"], ["id", "current_stage", "billing_prepared"]):
        some = CM.stored_cases(spark, base, cases, columns)
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.select(*columns).collect()))
        plan = some._jdf.queryExecution().optimizedPlan().toString()
        assert "description" not in plan.split("InMemoryRelation")[0]
