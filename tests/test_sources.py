from pyspark.sql import functions as F

from caseflow import schemas as K
from caseflow.operators.access import latest_per_key
from caseflow.sources import io as IO


def test_csv_escaping(spark):
    df = spark.createDataFrame([("a", 'say "hi", ok'), ("b", "line1\nline2"), ("c", "plain")], "id string, v string")
    out = {r["id"]: r["f"] for r in df.select("id", IO.csv_field(F.col("v"), df.schema["v"].dataType).alias("f"))
           .collect()}
    assert out["a"] == '"say ""hi"", ok"'
    assert out["b"] == '"line1\nline2"'
    assert out["c"] == "plain"


def test_envelope_roundtrip_keeps_nulls(spark):
    df = spark.createDataFrame([("x1", None, 5)], "id string, assigned_to string, unit_count long")
    env = IO.encode_envelope(df, ["id"]).first()
    assert '"assignedTo":null' in env["payload"] and '"unitCount":5' in env["payload"]
    schema = df.schema
    good, bad = IO.decode_payload(IO.encode_envelope(df, ["id"]).withColumnRenamed("id", "k"), schema, keep=["k"])
    assert good.first()["unit_count"] == 5 and bad.count() == 0


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v long")
    inc = spark.createDataFrame([("b", 20), ("c", 3)], "id string, v long")
    once = IO.upsert(base, inc, ["id"])
    twice = IO.upsert(once, inc, ["id"])
    assert sorted(map(tuple, twice.collect())) == [("a", 1), ("b", 20), ("c", 3)]


def test_latest_per_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z")], "k string, ts int, v string")
    assert latest_per_key(df, ["k"], [F.col("ts")]).first()["v"] == "y"


def test_camel_names():
    assert IO.camel("estimated_value_usd") == "estimatedValueUsd"
    assert IO.snake("estimatedValueUsd") == "estimated_value_usd"
    assert IO.camel_schema(K.ENTITY_SCHEMAS["contact"]).fieldNames()[3] == "environment"
