"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.session import scratch_path

#: The white space that separates words: blank and 0x09-0x0D.  Spelled out
#: once for Java regular expressions and once as a plain string.
WS_CLASS = r"[\x20\x09-\x0D]"
WS_CHARS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: rows of whole texts that a Python function gets at a time
TEXT_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to a fresh table in the shared checkpoint folder and read
    it back: lineage is cut, and a lost executor costs no recomputation.

    ``batch_rows`` is the number of rows that Python functions in ``df`` get
    at a time; whole texts are long, so few rows keep executors' memory low.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(_BATCH)
    try:
        if batch_rows:
            spark.conf.set(_BATCH, str(batch_rows))
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z, every other character as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null gives an
    empty array."""
    text = F.coalesce(text, F.lit(""))
    return F.filter(F.split(text, WS_CLASS + "+"), lambda w: w != "")


def sized(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted
    first; pass narrow rows only, from a written table), else as it is, so
    that a larger side is joined by shuffle."""
    return F.broadcast(df) if df.count() <= rows else df
