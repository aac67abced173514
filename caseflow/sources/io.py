"""Sources and sinks (S1-S7): typed reads with validation, JSON envelopes,
the contacts CSV export, CSV readers with declared schemas, keyed upserts.

Nothing here infers a schema: every read names its StructType.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow import schemas as K
from caseflow.functions.validate import Rule, errors
from caseflow.session import scratch_path


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(p[:1].upper() + p[1:] for p in rest)


def snake(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def camel_schema(schema: T.StructType) -> T.StructType:
    """The same schema with camelCase field names (the envelope format)."""
    def conv(dt):
        if isinstance(dt, T.StructType):
            return T.StructType([T.StructField(camel(f.name), conv(f.dataType), True) for f in dt.fields])
        if isinstance(dt, T.ArrayType):
            return T.ArrayType(conv(dt.elementType), True)
        return dt
    return conv(schema)


def read_entity(spark: SparkSession, path: str, schema: T.StructType, rules: list[Rule] | None = None,
                fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """List a collection as typed rows (S1): declared schema, then the rule
    set; returns (good rows, quarantine with ``errors``)."""
    df = spark.read.schema(schema).format(fmt).load(path)
    if not rules:
        return df, df.limit(0).withColumn("errors", F.array().cast("array<string>"))
    v = df.withColumn("errors", errors(rules))
    return v.where(F.size("errors") == 0).drop("errors"), v.where(F.size("errors") > 0)


def decode_payload(df: DataFrame, schema: T.StructType, payload_col: str = "payload",
                   keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Drop rows without a payload, parse the camelCase JSON record into the
    snake_case schema (S2).  Unknown keys are dropped; a record that does not
    parse or carries a wrongly typed field goes to quarantine."""
    keep = keep or []
    cs = camel_schema(schema).add("_corrupt", T.StringType())
    d = df.where(F.col(payload_col).isNotNull() & (F.length(F.trim(F.col(payload_col))) > 0))
    parsed = F.from_json(F.col(payload_col), cs, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    p = d.select(*keep, payload_col, parsed.alias("_r"))
    bad = F.col("_r").isNull() | F.col("_r._corrupt").isNotNull()
    good = p.where(~bad).select(*keep, *[F.col(f"_r.{camel(f.name)}").alias(f.name) for f in schema.fields])
    quarantine = p.where(bad).select(*keep, payload_col, F.lit("invalid_payload").alias("error"))
    return good, quarantine


def encode_envelope(df: DataFrame, index_cols: list[str]) -> DataFrame:
    """Index columns plus the whole record as camelCase JSON that keeps
    nulls, like the document store's writer (S3)."""
    def rename(c, dt):
        if isinstance(dt, T.StructType):
            return F.struct(*[rename(c.getField(f.name), f.dataType).alias(camel(f.name)) for f in dt.fields])
        return c
    rec = F.struct(*[rename(F.col(f.name), f.dataType).alias(camel(f.name)) for f in df.schema.fields])
    return df.select(*index_cols, F.to_json(rec, {"ignoreNullFields": "false"}).alias("payload"))


# --------------------------------------------------------------------------- CSV export


def csv_field(col, dt) -> F.Column:
    """String form of one value, quoted only when it holds a quote, comma,
    CR or LF (quotes doubled)."""
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        s = F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    elif isinstance(dt, T.BooleanType):
        s = F.when(col, F.lit("true")).otherwise(F.lit("false"))
    else:
        s = col.cast("string")
    s = F.coalesce(s, F.lit(""))
    return F.when(s.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))) \
        .otherwise(s)


def contacts_csv_lines(contacts: DataFrame) -> DataFrame:
    """The CSV as (line_no, line): line 0 is the header, data lines follow in
    id order.  Sorting is a global range-partitioned sort; no single task
    holds the file."""
    types = {f.name: f.dataType for f in contacts.schema.fields}
    line = F.concat_ws(",", *[csv_field(F.col(c), types[c]) for c in K.CONTACT_CSV_COLUMNS])
    header = contacts.sparkSession.createDataFrame([(0, "", ",".join(K.CONTACT_CSV_COLUMNS))],
                                                   "line_no long, id string, line string")
    body = contacts.select(F.lit(1).cast("long").alias("line_no"), "id", line.alias("line"))
    return header.unionByName(body).orderBy("line_no", "id").select("line_no", "id", "line")


def export_contacts_csv(contacts: DataFrame, path: str) -> str:
    """Write the CSV as ordered text parts with CRLF line ends (part files
    concatenate, in name order, to the file).  The text writer ends the last
    line with CRLF too; the service's export has no final line break."""
    contacts_csv_lines(contacts).select("line").write.mode("overwrite").option("lineSep", "\r\n").text(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV with a declared schema (S5 evidence manifest, S6 P&L and
    transaction register)."""
    return spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)


# --------------------------------------------------------------------------- upsert


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str]) -> DataFrame:
    """Keyed upsert, last write wins (S7): incoming rows replace stored ones
    with the same key; repeating the same incoming batch changes nothing.
    Within a batch the row with the highest ``arrival`` wins when present."""
    from caseflow.operators.access import latest_per_key
    e = existing.withColumn("_gen", F.lit(0))
    i = incoming.withColumn("_gen", F.lit(1))
    order_cols = [F.col("_gen")] + ([F.col("arrival")] if "arrival" in incoming.columns else [])
    u = e.unionByName(i, allowMissingColumns=True)
    return latest_per_key(u, key, order_cols).drop("_gen")


def write_version(df: DataFrame, base: str) -> str:
    """Write a new immutable version folder; readers take the newest one
    (a swap without renaming files in place)."""
    path = f"{base.rstrip('/')}/v={uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return path


def landing_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to a fresh folder of the shared checkpoint folder and read back:
    cuts the lineage of iterative jobs."""
    path = landing_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
