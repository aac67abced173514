"""Streaming forms agree with their batch counterparts."""

import os
import tempfile

from pyspark.sql import functions as F

from caseflow.plans import views as V
from caseflow.sources.tables import Tables
from caseflow.streaming import streams as S
from tests.conftest import SF_SMALL


def _landing(spark):
    t = Tables(spark, SF_SMALL)
    a = V.audit_events(t)
    path = tempfile.mkdtemp(prefix="cf-land-")
    a.repartition(3).write.mode("overwrite").parquet(os.path.join(path, "in"))
    return a, os.path.join(path, "in"), path


def test_stream_health_windows_counts_match_batch(spark):
    a, src, base = _landing(spark)
    stream = spark.readStream.schema(a.schema).parquet(src)
    out = S.stream_health_windows(stream, delay="0 seconds")
    q = (out.writeStream.outputMode("append").format("memory").queryName("hw_test")
         .option("checkpointLocation", os.path.join(base, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.sql("SELECT sum(events) AS n FROM hw_test").first()["n"]
    # append mode emits a window once the watermark passes it: all but the last one
    per = (a.groupBy(F.window(F.col("timestamp").cast("timestamp"), "5 minutes").alias("w")).count()
           .orderBy("w.start").collect())
    batch = sum(r["count"] for r in per[:-1])
    assert got == batch and got > 0


def test_stream_events_loses_nothing_and_admits_nothing_twice(spark):
    """Late and repeated deliveries over several rounds with restarts."""
    base = tempfile.mkdtemp(prefix="cf-rounds-")
    src, sink, ck = (os.path.join(base, n) for n in ("in", "sink", "ck"))
    rounds = [[("a", "2026-01-01 12:00:00"), ("a", "2026-01-01 11:00:00")], [("b", "2026-01-01 20:00:00")],
              [("late", "2026-01-01 13:00:00"), ("older", "2020-01-01 00:00:00")], [("a", "2026-01-01 23:59:00")], []]
    for rows in rounds:
        df = spark.createDataFrame(rows, "event_id string, at string").select(
            "event_id", F.col("at").cast("timestamp_ntz").alias("timestamp"))
        df.write.mode("append").parquet(src)
        out = S.stream_events(spark, src, df.schema, sink, ck)
    got = sorted((r.event_id, str(r.timestamp)) for r in out.collect())
    assert got == [("a", "2026-01-01 11:00:00"), ("b", "2026-01-01 20:00:00"), ("late", "2026-01-01 13:00:00"),
                   ("older", "2020-01-01 00:00:00")]
