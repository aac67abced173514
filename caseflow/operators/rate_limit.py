"""Request limits as the service counts them (T9): a client's window opens with
its first request and lasts ``window_ms``; the first request at or after its
end opens the next one.  Requests beyond the limit in a window are refused, but
count.

Which requests open windows depends on all earlier ones of the client, yet no
client is walked in order.  A request that comes a whole window or more after
the one before it opens a window in any case.  From every other request a
pointer leads to the first request a window later, and the openers reached from
the certain ones are marked by pointer doubling: round k follows 2^k pointers
at once, so a client that never pauses takes as many rounds as its number of
windows has binary digits.

Requests are counted per client and millisecond first.  All joins and windows
are on (client, time bucket of one window), so a group holds at most
``window_ms`` rows, however busy a client is and for however long.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow import schemas as K
from caseflow.operators.audit import micros_between
from caseflow.session import scratch_path

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back."""
    path = scratch_path(df.sparkSession, f"rate-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _millis(time: Column) -> Column:
    return F.floor(micros_between(F.expr(_EPOCH), time.cast("timestamp_ntz")) / 1000).cast("bigint")


def _certain(nodes: DataFrame, ends: DataFrame, window_ms: int) -> DataFrame:
    """Requests (c, t) with none in the ``window_ms`` before them."""
    in_bucket = F.lag("t").over(Window.partitionBy("c", "b").orderBy("t"))
    # earlier than the bucket before is a whole window ago or more
    before = ends.select("c", (F.col("b") + 1).alias("b"), "tail")
    prev = nodes.select("c", "b", "t", in_bucket.alias("p")).join(before, ["c", "b"], "left")
    gap = F.col("t") - F.coalesce("p", "tail")
    return prev.where(gap.isNull() | (gap >= window_ms)).select("c", "t")


def _pointers(nodes: DataFrame, ends: DataFrame, window_ms: int) -> DataFrame:
    """(c, t, u): the first request ``u`` at or after ``t + window_ms``, where
    it lies in one of the next two buckets.  A later one has a whole window
    without requests before it and is certain."""
    hits = nodes.select("c", "b", F.col("t").alias("at"), F.col("t").alias("u"), F.lit(None).cast("bigint").alias("t"))
    asks = nodes.select("c", (F.col("b") + 1).alias("b"), (F.col("t") + window_ms).alias("at"),
                        F.lit(None).cast("bigint").alias("u"), "t")
    # backwards in time, requests before questions of the same time: the last request seen answers
    seen = Window.partitionBy("c", "b").orderBy(F.desc("at"), F.col("t").isNotNull()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    answered = hits.unionByName(asks).withColumn("u", F.last("u", ignorenulls=True).over(seen)).where("t is not null")
    after = ends.select("c", (F.col("b") - 1).alias("b"), "head")
    return answered.join(after, ["c", "b"], "left").select("c", "t", F.coalesce("u", "head").alias("u")).where("u is not null")


def limit_windows(events: DataFrame, limit: int = K.REQUEST_LIMIT_PER_MINUTE, window_ms: int = 60_000,
                  client: str = "agent_id", time: str = "timestamp") -> DataFrame:
    """Windows with more than ``limit`` requests: window_start, the client's
    column, events (all requests in the window) and refused (those beyond the
    limit).

    Times count in whole milliseconds.  Rows without a client or a time are in
    no window; an empty table gives an empty result."""
    t = _millis(F.col(time))
    nodes = (events.select(F.col(client).alias("c"), t.alias("t")).where("c is not null and t is not null")
             .groupBy("c", "t").agg(F.count(F.lit(1)).alias("n")))
    nodes = _saved(nodes.withColumn("b", F.floor(F.col("t") / window_ms).cast("bigint")), "requests")
    ends = nodes.groupBy("c", "b").agg(F.min("t").alias("head"), F.max("t").alias("tail"))
    opens = _saved(_certain(nodes, ends, window_ms), "opens-0")
    # pointers to certain openers say nothing new and would only lengthen the chains
    jumps = _pointers(nodes, ends, window_ms).join(opens.select("c", F.col("t").alias("u")), ["c", "u"], "left_anti")
    jumps, k = _saved(jumps.select("c", "t", "u"), "jumps-0"), 0
    while not jumps.isEmpty():
        k += 1
        reached = opens.join(jumps, ["c", "t"]).select("c", F.col("u").alias("t"))
        opens = _saved(opens.unionByName(reached).distinct(), f"opens-{k}")
        second = jumps.select("c", F.col("t").alias("u"), F.col("u").alias("v"))
        jumps = _saved(jumps.join(second, ["c", "u"]).select("c", "t", F.col("v").alias("u")), f"jumps-{k}")
    return _counted(nodes, opens, limit, window_ms, client)


def _counted(nodes: DataFrame, opens: DataFrame, limit: int, window_ms: int, client: str) -> DataFrame:
    """Requests per window: a request's window is the latest opened at or
    before it, in its own bucket or the one before."""
    marks = opens.select("c", "t", F.col("t").alias("s"))
    run = Window.partitionBy("c", "b").orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = nodes.join(marks, ["c", "t"], "left").select("c", "b", "n", F.max("s").over(run).alias("s"))
    before = (opens.groupBy("c", (F.floor(F.col("t") / window_ms) + 1).cast("bigint").alias("b"))
              .agg(F.max("t").alias("carried")))
    counted = (own.join(before, ["c", "b"], "left").groupBy("c", F.coalesce("s", "carried").alias("s"))
               .agg(F.sum("n").alias("events")).where(F.col("events") > limit))
    start = F.expr(_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("s") / F.lit(1000).cast("decimal(4,0)"))
                                                .cast("decimal(18,6)"))
    return counted.select(start.cast("timestamp_ntz").alias("window_start"), F.col("c").alias(client), "events",
                          (F.col("events") - limit).alias("refused"))
