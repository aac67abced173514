"""Exact, skew-proof replay of a small state machine over keyed action logs.

The guard logic of a case (or workflow) depends only on a handful of states,
so each action is a function ``state -> (next state, error code)`` and
folding a log is function composition, which is associative.  The replay
therefore never needs one key's whole history in one place:

1. actions are cut into chunks of at most ``chunk_size`` consecutive
   sequence numbers per key (``seq // chunk_size``);
2. each chunk is folded from *every* possible start state, giving a small
   transition table (``n_states`` integers) per chunk;
3. tables are composed level by level: ``fan`` neighbouring chunks to a block,
   ``fan`` neighbouring blocks to a larger one, and so on until the tables of
   the key with the widest span of chunks fit into one group;
4. the key's initial state is handed down the levels, block by block, until
   every chunk has its true start state;
5. each chunk is folded once more from its start state and exploded into one
   output row per action with the state before and after it and the error.

The number of levels is the logarithm of that span (none where every key has
one chunk: then the chunks are not joined with start states either), and no group holds more than ``chunk_size`` actions or ``fan`` tables, however dense
or sparse the numbers are and however many actions one key has.  The chunks are
written to the shared checkpoint folder once, since every level reads them;
keys with a single chunk need no level.  Everything is native higher-order SQL
functions (``aggregate`` / ``transform``), no Python worker.

Sequence numbers identify an action of its key.  Equal rows of one number are
one action delivered again and count once.  A number whose rows differ is
ambiguous: all its rows are left out of the fold and returned by
``duplicate_actions``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.sources.io import stored

Step = Callable[[Column, Column], tuple[Column, Column]]

FAN = 16_384


def _part(number: Column, size: int) -> Column:
    """``number // size``, exact for every 64-bit number."""
    number = number.cast("bigint")
    return F.call_function("div", number - F.pmod(number, F.lit(size).cast("bigint")), F.lit(size).cast("bigint"))


def row_hash(df: DataFrame) -> Column:
    """64-bit hash of a whole row; tells a null from no column."""
    return F.xxhash64(*(x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())))


def duplicate_actions(actions: DataFrame, key: str, seq: str) -> DataFrame:
    """The quarantine: actions whose (key, seq) occurs on rows that differ."""
    again = (actions.withColumn("_row", row_hash(actions)).groupBy(key, seq)
             .agg(F.count(F.lit(1)).alias("occurrences"), F.min("_row").alias("_low"), F.max("_row").alias("_high"))
             .where("_low <> _high").drop("_low", "_high"))
    return actions.join(again, [key, seq])


def _emit_fold(step: Step, start_col: Column) -> Column:
    ev_type = "array<struct<i:int,b:int,a:int,e:int>>"
    init = F.struct(start_col.alias("s"), F.lit(0).alias("i"), F.array().cast(ev_type).alias("out"))

    def emit(acc, x):
        n, e = step(acc["s"], x)
        return F.struct(
            n.alias("s"), (acc["i"] + 1).alias("i"),
            F.concat(acc["out"], F.array(F.struct(acc["i"].alias("i"), acc["s"].alias("b"), n.alias("a"),
                                                  e.alias("e")))).alias("out"))

    return F.aggregate(F.col("_acts"), init, emit)["out"]


def _start_states() -> Column:
    """The start state of every member of ``_fns`` (sorted), from ``s0`` on."""
    init = F.struct(F.col("s0").alias("cur"), F.array().cast("array<struct<c:bigint,s:int>>").alias("out"))
    return F.aggregate("_fns", init, lambda acc, m: F.struct(
        F.element_at(m["fn"], acc["cur"] + 1).alias("cur"),
        F.concat(acc["out"], F.array(F.struct(m["c"].alias("c"), acc["cur"].alias("s")))).alias("out")))["out"]


def _emit(chunks: DataFrame, key: str, seq: str, fields: list[str], step: Step) -> DataFrame:
    """Fold each chunk from ``s0``, one row per action."""
    folded = chunks.select(key, "_acts", _emit_fold(step, F.col("s0")).alias("_ev"))
    rows = folded.select(key, F.arrays_zip(F.col("_acts").alias("act"), F.col("_ev").alias("ev")).alias("z")) \
        .select(key, F.explode("z").alias("z"))
    return rows.select(
        key, F.col("z.act.seq").alias(seq), *[F.col(f"z.act.{f}").alias(f) for f in fields],
        F.col("z.ev.b").alias("s_before"), F.col("z.ev.a").alias("s_after"), F.col("z.ev.e").alias("err"))


def long_keys(actions: DataFrame, key: str, chunk_size: int = 512) -> DataFrame:
    """Keys with more than ``chunk_size`` rows: at most one per ``chunk_size`` rows."""
    return actions.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > chunk_size).select(key)


def replay(actions: DataFrame, key: str, seq: str, fields: list[str], start: DataFrame | None,
           n_states: int, step: Step, chunk_size: int = 512, fan: int = FAN, long: DataFrame | None = None,
           known: DataFrame | None = None) -> DataFrame:
    """Fold ``actions`` per ``key`` in ``seq`` order.

    actions: key, seq (integer, not null) and ``fields`` read by ``step``;
             all columns count when rows of one (key, seq) are compared;
             with ``start=None`` an ``s0`` column on every action row gives the
             key's initial state
    start:   key, ``s0`` (initial state, 0..n_states-1); keys without actions
             are ignored, actions without a start row use state 0
    step:    (state int Column, action struct Column) -> (next state, error int;
             0 = accepted)
    long:    ``long_keys`` of the actions; the other keys then make one chunk
             each, also where their numbers lie far apart
    known:   key, seq of actions that are left out
    returns: key, seq, fields..., ``s_before``, ``s_after``, ``err``
    """
    extra = ["s0"] if start is None else []
    rec = F.struct(F.col(seq).alias("seq"), *[F.col(f) for f in fields])
    # Explicit (key, chunk) distribution: an upstream partitioning on the key
    # alone would otherwise be reused and keep a hot key in one task.  The
    # duplicate test groups by (key, chunk, seq) on the same distribution.
    chunk = _part(F.col(seq), chunk_size)
    given = actions.select(F.col(key), F.col(seq), rec.alias("_rec"), row_hash(actions).alias("_row"), *extra)
    if known is not None:
        given = given.unionByName(known.select(key, seq, F.lit(True).alias("_known")), allowMissingColumns=True)
    if long is not None:
        # no more than one key per chunk_size rows, so that it can be sent to every task
        given = given.join(F.broadcast(long.select(key, F.lit(True).alias("_long"))), key, "left")
        chunk = F.when(F.col("_long"), chunk).otherwise(F.lit(0).cast("bigint"))
    a = (given.withColumn("_chunk", chunk).repartition(key, "_chunk").groupBy(key, "_chunk", seq)
         .agg(F.min("_row").alias("_low"), F.max("_row").alias("_high"), F.first("_rec", ignorenulls=True).alias("_rec"),
              *([] if known is None else [F.max("_known").alias("_known")]), *[F.max(c).alias(c) for c in extra])
         .where("_low = _high" if known is None else "_low = _high AND _known IS NULL"))
    chunks = a.groupBy(key, "_chunk").agg(F.array_sort(F.collect_list("_rec")).alias("_acts"),
                                          *[F.max(c).alias(c) for c in extra])

    def nxt(s, x):
        return step(s, x)[0]

    # the input is read and cut once; everything below reads the written chunks
    chunks = stored(chunks, "replay-chunks")
    if start is None:
        ends = chunks.agg(F.min("_chunk"), F.max("_chunk")).first()
        if ends[0] == ends[1]:           # one chunk per key, which has its start state with it
            return _emit(chunks.withColumn("s0", F.coalesce("s0", F.lit(0)).cast("int")), key, seq, fields, step)
    several = chunks.groupBy(key).agg(F.min("_chunk").alias("_low"), F.max("_chunk").alias("_high"), *[
        F.max(c).alias(c) for c in extra])
    if start is not None:
        several = several.join(start.select(key, "s0"), key, "left")
    several = several.withColumn("s0", F.coalesce("s0", F.lit(0)).cast("int"))
    # a key with one chunk knows its start state, the others go through the levels
    single = several.where("_low = _high").select(key, F.col("_low").alias("_chunk"), "s0")
    several_span = several.agg(F.max(F.col("_high") - F.col("_low"))).first()[0] or 0
    several = several.where("_low < _high").select(key, "s0")

    every = F.sequence(F.lit(0), F.lit(n_states - 1))
    # 2. transition table of every chunk
    table = F.transform(every, lambda s0: F.aggregate(F.col("_acts"), s0, nxt))
    level = (chunks.drop(*extra).join(several.select(key), key, "left_semi")
             .select(key, F.col("_chunk").alias("_id"), table.alias("_fn")))

    # 3. compose, fan tables at a time, until the widest key fits into one group
    blocks = []
    width = several_span + 1
    while several_span:
        top = width <= fan
        block = F.lit(0).cast("bigint") if top else _part(F.col("_id"), fan)
        group = level.withColumn("_block", block).groupBy(key, "_block").agg(
            F.array_sort(F.collect_list(F.struct(F.col("_id").alias("c"), F.col("_fn").alias("fn")))).alias("_fns"))
        blocks.append(group)
        if top:
            break
        composed = F.transform(every, lambda s0: F.aggregate("_fns", s0, lambda s, m: F.element_at(m["fn"], s + 1)))
        level = group.select(key, F.col("_block").alias("_id"), composed.alias("_fn"))
        width = width // fan + 2

    # 4. hand the start state down
    starts = single.withColumnRenamed("_chunk", "_block")
    if blocks:
        last = blocks.pop().join(several, key)
        while True:
            handed = last.select(key, F.explode(_start_states()).alias("x")).select(
                key, F.col("x.c").alias("_block"), F.col("x.s").alias("s0"))
            if not blocks:
                break
            last = blocks.pop().join(handed, [key, "_block"])
        starts = starts.unionByName(handed)

    # 5. fold each chunk from its true start state, emit one row per action
    j = chunks.drop(*extra).join(starts.withColumnRenamed("_block", "_chunk"), [key, "_chunk"])
    return _emit(j, key, seq, fields, step)
