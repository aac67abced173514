"""Connected components of a graph too large for one task, by alternating star
rounds: large stars hang every greater neighbour of a node on its smallest
one, small stars do the same with the smaller neighbours.  Long chains halve,
so rounds grow with the logarithm of a chain's length.

A round is a ``min`` aggregate and a join on the node; no list of neighbours is
ever collected, and a node with very many edges is a skewed join key that AQE
can split.  Each round is written to the shared checkpoint folder, which cuts
the lineage and lets lost executors' work be read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.session import scratch_path


def _saved(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, f"components-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _state(edges: DataFrame):
    """Number of edges and two sums of their hashes: equal for equal tables."""
    h = F.xxhash64("u", "v")
    return edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(20,0)")),
                     F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every end of an edge; component is the smallest id
    that can be reached.  Edges with a null end and loops join nothing; more
    than ``max_rounds`` rounds raise an error."""
    pair = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = _saved(pair.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # of the edges (u, v) with u > v, both ends are known: v's greater neighbour u goes to v's smallest one
        large = now.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v")).distinct()
        large = _saved(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = _saved(hung.unionByName(least.withColumnRenamed("m", "v")).distinct(), "small")
        before, state = state, _state(now)
        if state == before:
            # stars: every node but the smallest hangs on the smallest
            roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
