"""Structured Streaming forms of the audit ingest and its rates (T8-T10); the
case replay (T7) is in ``case_state``.

* ``stream_events``: exactly-once audit ingest without a watermark: late and
  repeated deliveries are told by the event id alone.
* ``stream_request_rate`` / ``stream_health_windows``: windowed aggregates
  with a watermark, append mode.

Sinks are parquet folders under the shared checkpoint folder; checkpoints
sit next to them, so a restarted query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow import schemas as K


def stream_events(spark: SparkSession, events_dir: str, schema: T.StructType, sink_dir: str,
                  checkpoint_dir: str) -> DataFrame:
    """Exactly-once audit ingest (T8): every event id once, however late it
    arrives, how often, and with which timestamp; the first delivery stays, and
    within one delivery the earliest timestamp (ties: the smallest row hash).

    No watermark, so nothing is too late.  Each micro-batch is reduced to one
    row per id, anti-joined with the ids of the earlier batches and written to
    a folder of its own batch number: a retried batch replaces its folder and
    does not see itself."""
    columns = [f.name for f in schema.fields]
    stored = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])

    def sink(batch: DataFrame, batch_id: int):
        s = batch.sparkSession
        fresh = batch.groupBy("event_id").agg(F.min_by(
            F.struct(*columns), F.struct(F.col("timestamp"), F.xxhash64(*columns))).alias("e")).select("e.*")
        if batch_id > 0:
            known = s.read.schema(stored).parquet(sink_dir).where(F.col("batch") < batch_id).select("event_id")
            fresh = fresh.join(known, "event_id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{sink_dir}/batch={batch_id}")

    q = (spark.readStream.schema(schema).parquet(events_dir).writeStream.foreachBatch(sink)
         .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stored).parquet(sink_dir).drop("batch")


def stream_request_rate(events: DataFrame, limit: int = K.REQUEST_LIMIT_PER_MINUTE, window: str = "1 minute",
                        delay: str = "2 minutes", client: str = "agent_id") -> DataFrame:
    """Streaming T9: clients above ``limit`` events per aligned window."""
    e = events.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", delay)
    g = e.groupBy(F.window("event_time", window).alias("w"), client).agg(F.count("*").alias("events"))
    return g.where(F.col("events") > limit)


def stream_health_windows(events: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Streaming T10: error share and approximate latency per window."""
    e = events.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", delay)
    return e.groupBy(F.window("event_time", window).alias("w")).agg(
        F.count("*").alias("events"),
        (F.count_if(F.col("status") == "failed") / F.count("*")).alias("error_share"),
        F.percentile_approx("duration_ms", 0.5).alias("p50_ms"))
