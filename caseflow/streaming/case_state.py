"""Streaming case replay (T7): the guarded case fold as keyed state that
takes actions in any order.

Per case the state holds the fold up to the last sealed action (``base``) and
the fold of everything received; the actions received are kept as a log.  A
micro-batch folds the unsealed actions of the cases it touches again from their
base with the batch replay, all in native Spark: the result is that of the batch
replay whatever the order of arrival, and a long log of one case is cut into
chunks there.  Equal deliveries of a number count once; a number delivered with
different contents is left out of the fold.

A case is sealed when nothing has arrived for ``hold``: its fold becomes its
base and its log is not read again.  An action that arrives later still, with a
sealed number, is given out as ``late`` and changes nothing.  Time is the
arrival time of the micro-batches, so that nothing is dropped on the way in.

State and log are parquet folders by micro-batch number next to the sink.  A
batch reads the folders of earlier batches only and overwrites its own, so a
retried batch replaces itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow import schemas as K
from caseflow.functions import literals as L
from caseflow.operators.access import latest_per_key
from caseflow.operators.lifecycle import case_step, fold_case
from caseflow.operators.replay import replay

_FOLD = ("current_stage string, status string, quote_approval string, quote_amount_usd decimal(18,2), "
         "billing_prepared boolean, accepted_actions long, rejected_actions long")
FOLD = [c.split()[0] for c in _FOLD.split(", ")]
OUT = f"case_id string, {_FOLD}, last_action_no long, late_action_no long"
# what a later batch needs of a case: the fold to start from, the last sealed number, the batch its unsealed log begins in
STATE = f"{OUT}, base struct<{_FOLD}>, sealed_no long, since long, arrived timestamp, batch long"
ACTION = "case_id string, action_no long, action string, id_ok boolean, quote_amount_usd decimal(18,2), arrived timestamp, batch long"
_NEW = ("intake", "open", "not_requested", None, False, 0, 0)


def _judge(spark: SparkSession, batch_id: int, sink_dir: str, hold: Column) -> None:
    """Fold the logged actions of one micro-batch and write its states."""
    def load(name: str, schema: str, base: str = f"{sink_dir}-state") -> DataFrame:
        return spark.read.schema(schema).parquet(f"{base}/{name}" if name else base)

    log = load("log", ACTION).where(F.col("batch") <= batch_id)
    new = log.where(F.col("batch") == batch_id)
    touched = new.groupBy("case_id").agg(F.max("arrived").alias("_arrived"), F.max("action_no").alias("_max_no"))
    start = load("start", f"case_id string, {_FOLD}").select("case_id", F.struct(*FOLD).alias("_start"))
    if batch_id > 0:
        earlier = load("", STATE, sink_dir).where((F.col("batch") < batch_id) & F.col("late_action_no").isNull())
        newest = earlier.agg(F.max("arrived")).first()[0]
        was = latest_per_key(earlier.select("case_id", "batch", F.struct(*FOLD).alias("head"), "last_action_no", "base",
                                            "sealed_no", "since", "arrived"), ["case_id"], [F.col("batch")]).drop("batch")
        touched = touched.join(was, "case_id", "left")
        seal = F.coalesce(F.col("arrived") + hold < F.lit(newest), F.lit(False))
    else:
        seal = F.lit(False)
        for f in T.StructType.fromDDL("head string, base string, last_action_no long, sealed_no long, since long"):
            touched = touched.withColumn(f.name, F.lit(None).cast(
                T.StructType.fromDDL(_FOLD) if f.name in ("head", "base") else f.dataType))
    fresh = F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(_NEW, T.StructType.fromDDL(_FOLD))))
    touched = touched.join(start, "case_id", "left").select(
        "case_id", F.col("_arrived").alias("arrived"), F.greatest("last_action_no", "_max_no").alias("last_action_no"),
        F.when(seal, F.col("head")).otherwise(F.coalesce("base", "_start", fresh)).alias("base"),
        F.when(seal, F.col("last_action_no")).otherwise(F.col("sealed_no")).alias("sealed_no"),
        F.when(seal, F.lit(None)).otherwise(F.col("since")).alias("since"))
    path = f"{sink_dir}-state/touched/batch={batch_id}"
    touched = touched.withColumn("since", F.coalesce("since", F.lit(batch_id)).cast("long"))
    touched.write.mode("overwrite").parquet(path)
    touched = spark.read.schema(touched.schema).parquet(path)

    late = F.coalesce(F.col("action_no") <= F.col("sealed_no"), F.lit(False))
    s0 = L.index_of(F.col("base.current_stage"), K.CASE_STAGES) * 2 + F.col("base.billing_prepared").cast("int")
    unsealed = log.join(touched.select("case_id", "base", "sealed_no", "since"), "case_id").where(
        (F.col("batch") >= F.col("since")) & ~late)
    judged = replay(unsealed.select("case_id", "action_no", "action", "quote_amount_usd", "id_ok",
                                    L.index_of(F.col("action"), K.CASE_ACTIONS).alias("code"),
                                    F.col("quote_amount_usd").isNotNull().alias("has_amount"), s0.alias("s0")),
                    "case_id", "action_no", ["action", "quote_amount_usd", "code", "id_ok", "has_amount"], None,
                    n_states=2 * len(K.CASE_STAGES), step=case_step)
    folded = touched.join(fold_case(judged), "case_id", "left")
    states = folded.select(
        "case_id", F.coalesce("_stage", "base.current_stage").alias("current_stage"),
        F.coalesce("_status", "base.status").alias("status"),
        F.coalesce("_approval", "base.quote_approval").alias("quote_approval"),
        F.coalesce("_amount", "base.quote_amount_usd").alias("quote_amount_usd"),
        (F.col("base.billing_prepared") | F.coalesce("_billing", F.lit(False))).alias("billing_prepared"),
        *((F.col(f"base.{c}") + F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in FOLD[-2:]),
        "last_action_no", F.lit(None).cast("long").alias("late_action_no"), "base", "sealed_no", "since", "arrived")
    states.write.mode("overwrite").parquet(f"{sink_dir}/batch={batch_id}")
    again = new.join(touched.select("case_id", "sealed_no"), "case_id").where(late).select(
        "case_id", F.col("action_no").alias("late_action_no"))
    if not again.isEmpty():
        states = spark.read.schema(states.schema).parquet(f"{sink_dir}/batch={batch_id}").drop("late_action_no")
        states.join(again, "case_id").write.mode("append").parquet(f"{sink_dir}/batch={batch_id}")


def stream_cases(spark: SparkSession, actions_dir: str, actions_schema: T.StructType, sink_dir: str, checkpoint_dir: str,
                 cases: DataFrame, hold: str = "7 days", max_files_per_trigger: int = 8) -> tuple[DataFrame, DataFrame]:
    """Replay the actions of a landing folder ``(case_id, action_no, action,
    id_ok, quote_amount_usd)`` until all files are read; returns (latest state
    of every case that has an action, late actions).

    ``cases`` are the stored cases, the states from which folding starts (read
    in the first run of a checkpoint only).  Every micro-batch overwrites a sink
    folder of its own number, so a retried batch replaces itself.  ``hold`` is
    an interval of days, hours, minutes or seconds."""
    src = (spark.readStream.schema(actions_schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(actions_dir)
           .select("case_id", F.col("action_no").cast("long").alias("action_no"), "action",
                   F.coalesce("id_ok", F.lit(False)).alias("id_ok"),
                   F.col("quote_amount_usd").cast("decimal(18,2)").alias("quote_amount_usd"),
                   F.current_timestamp().alias("arrived")))

    def sink(batch: DataFrame, batch_id: int):
        if batch_id == 0:
            start = cases.select("case_id", "current_stage", "status", "quote_approval", "quote_amount_usd",
                                 F.coalesce("billing_prepared", F.lit(False)).alias("billing_prepared"),
                                 F.lit(0).alias("accepted_actions"), F.lit(0).alias("rejected_actions"))
            start.select(*(F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(f"case_id string, {_FOLD}"))) \
                .write.mode("overwrite").parquet(f"{sink_dir}-state/start")
        batch.write.mode("overwrite").parquet(f"{sink_dir}-state/log/batch={batch_id}")
        _judge(spark, batch_id, sink_dir, F.expr(f"INTERVAL {hold}"))

    q = (src.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.schema(f"{OUT}, batch long").parquet(sink_dir)
    states = latest_per_key(out.where("late_action_no is null").drop("late_action_no"), ["case_id"], [F.col("batch")]).drop("batch")
    return states, out.where("late_action_no is not null").select("case_id", F.col("late_action_no").alias("action_no"), "batch")
