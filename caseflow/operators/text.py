"""Text jobs over whole message tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow import schemas as K
from caseflow.functions import text as TX
from caseflow.functions.validate import case_analysis_errors


def redact_messages(messages: DataFrame, strict: bool = False) -> DataFrame:
    """Redact every message: the whole redacted text, the bounded summary the
    audit log stores, the redacted length and whether anything changed."""
    full = TX.redact(F.col("text"), max_len=None, strict=strict)
    m = messages.select("message_id", "source", "text", full.alias("redacted"))
    return m.select(
        "message_id", "source", "redacted",
        F.substring("redacted", 1, K.REDACT_MAX_LEN).alias("summary"),
        F.length("redacted").cast("bigint").alias("redacted_length"),
        (F.col("redacted") != F.col("text")).alias("changed"),
    )


def redaction_report(messages: DataFrame) -> DataFrame:
    """Messages and matches per pattern, per source (partial aggregation)."""
    red = messages.select("source", "text", TX.redact(F.col("text"), max_len=None).alias("red"))
    e, p, i = TX.redaction_counts(F.col("text"), F.col("red"))
    m = red.select("source", e.alias("e"), p.alias("p"), i.alias("i"))
    return m.groupBy("source").agg(
        F.count("*").alias("messages"),
        F.count_if((F.col("e") + F.col("p") + F.col("i")) > 0).alias("messages_changed"),
        F.sum("e").cast("bigint").alias("email_matches"),
        F.sum("p").cast("bigint").alias("phone_matches"),
        F.sum("i").cast("bigint").alias("id_matches"),
    )


def parse_model_output(df: DataFrame, col: str, keep: list[str] | None = None) -> DataFrame:
    """Strip a ```json fence, parse into the declared analysis struct and
    validate it; rows that do not parse or break a rule carry the errors."""
    keep = keep or []
    cleaned = TX.strip_json_fence(F.col(col))
    from pyspark.sql import types as T
    schema = T.StructType(list(K.CASE_ANALYSIS.fields) + [T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(cleaned, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = df.select(*keep, parsed.alias("analysis"))
    unparseable = F.col("analysis").isNull() | F.col("analysis._corrupt").isNotNull()
    errs = F.when(unparseable, F.array(F.lit("unparseable"))).otherwise(
        F.array_compact(case_analysis_errors(F.col("analysis"))))
    out = out.select(*keep, "analysis", errs.alias("errors"))
    return out.select(*keep, F.col("analysis.urgency").alias("urgency"),
                      F.col("analysis.service_family").alias("service_family"),
                      F.col("analysis.confidence").alias("confidence"),
                      "errors", (F.size("errors") == 0).alias("valid"))
