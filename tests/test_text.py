from caseflow.functions import text as TX
from caseflow.operators import text as OT
from pyspark.sql import functions as F


def run(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(fn(F.col("t"))).collect()]


def test_redact_order_and_tags(spark):
    got = run(spark, [
        "Escriba a ana.demo@Example.COM o llame al 0991234567",
        "RUC 0190000001001 queda",
        "id 1710034065 y fin",
        "ñ1710034065",
    ], lambda c: TX.redact(c, None))
    assert got[0] == "Escriba a [REDACTED_EMAIL] o llame al [REDACTED_PHONE]"
    # the phone rule runs first and has no left boundary
    assert got[1] == "RUC 019[REDACTED_PHONE] queda"
    # a cedula starting with 1 is an id
    assert got[2] == "id [REDACTED_ID] y fin"
    # ASCII word boundary: a non-ASCII letter before the digits is a boundary
    assert got[3] == "ñ[REDACTED_ID]"


def test_redact_strict_tags_long_ids_first(spark):
    got = run(spark, ["RUC 0190000001001 queda"], lambda c: TX.redact(c, None, strict=True))
    assert got[0] == "RUC [REDACTED_ID] queda"


def test_redact_truncates(spark):
    got = run(spark, ["x" * 900], lambda c: TX.redact(c))
    assert len(got[0]) == 500


def test_format_helpers(spark):
    df = spark.createDataFrame([(0.915, 19680.4, "ana  maria lopez", "fire_safety")],
                               "c double, v double, n string, k string")
    r = df.select(TX.percent(F.col("c")), TX.whole_dollars(F.col("v")), TX.initials(F.col("n")),
                  TX.humanize(F.col("k"))).first()
    assert tuple(r) == ("92%", "$19.680", "AM", "fire safety")


def test_js_trim_strips_unicode_spaces(spark):
    got = run(spark, [" \t hola 　"], TX.js_trim)
    assert got == ["hola"]


def test_js_trim_takes_ends_only_and_runs_no_pattern(spark):
    spaces = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
    # U+0085 ends a line for Java's $ but is no space of the service
    texts = [f"{spaces}a{spaces}b{spaces}", spaces, "", None, "abc \u0085", "\u200b x", "\x1c y "]
    assert run(spark, texts, TX.js_trim) == [f"a{spaces}b", "", "", None, "abc \u0085", "\u200b x", "\x1c y"]
    from caseflow.functions import validate as VA
    df = spark.createDataFrame([(" x ", None)], "title string, owner_user_id string").withColumns(
        {"property_id": F.lit(None).cast("string"), "commitment_type": F.lit("task"), "notes": F.lit("n")})
    rules = VA.commitment_create_rules()
    assert [r.errors for r in VA.validate(df, rules).collect()] == [["title"]]
    assert "regexp_replace" not in VA.validate(df, rules)._jdf.queryExecution().analyzed().toString()


def test_parse_model_output(spark):
    good = '```json\n{"summary":"s","intent":"i","urgency":"low","service_family":"f","missing_information":[],' \
           '"next_best_action":"n","draft_reply":"d","requires_human_approval":true,"confidence":0.5}\n```'
    bad_conf = good.replace("0.5", "1.5")
    df = spark.createDataFrame([("a", good), ("b", bad_conf), ("c", "{not json")], "id string, raw string")
    out = {r["id"]: r for r in OT.parse_model_output(df, "raw", keep=["id"]).collect()}
    assert out["a"]["valid"] and out["a"]["urgency"] == "low"
    assert list(out["b"]["errors"]) == ["confidence"]
    assert "unparseable" in list(out["c"]["errors"])
