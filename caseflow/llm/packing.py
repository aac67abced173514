"""Bulk-synchronous best-fit packing of tokenised documents.

Documents become pieces of at most ``capacity`` tokens; the pieces are packed
into as few sequences of that capacity as best-fit decreasing needs.

Piece lengths and gaps are whole numbers up to the capacity, so pieces sorted
by length and sequences sorted by gap fall into at most ``capacity`` runs of
equals.  One round takes the next shorter run of pieces and matches all of it
at once: a successor sweep finds the smallest gap that holds the length, ranks
within the run say which piece goes to which of the equal gaps (a gap takes as
many as fit; pieces beyond its run sweep on to the next larger gap, or open
new sequences), and the gaps are updated before the next round.  What a round
needs to know of the data are run lengths only.  They are counted in Spark;
the sweeps work on that table of at most ``capacity`` numbers, whatever the
corpus size, and give one row per matched stretch of ranks.  Ranking the
pieces and joining them to the stretches is distributed again.

Token ids are those of the ``tokenizers`` file ``byte_bpe_50k.json``.  They are
computed with tiktoken from the same vocabulary as ranks, which gives the same
ids (the tests compare both) at a fifth of the CPU time.
"""

from __future__ import annotations

import base64
import bisect
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseflow.llm.common import written

CAPACITY, END = 1024, 2
VOCABULARY = "byte_bpe_50k.tiktoken"
_SPECIAL, _SPECIAL_ID = "<|endoftext|>", 50256
_CUT = 1 << 16
_EDGE = re.compile(r"\S(?=\s)")

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY):
    """The vocabulary of that name (or at that path) as a tiktoken encoding,
    once per Python worker."""
    import public_tokenizers
    import tiktoken
    path = vocabulary if os.path.isabs(vocabulary) else public_tokenizers.path(vocabulary)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={_SPECIAL: _SPECIAL_ID})


def token_ids(text: str, vocabulary: str = VOCABULARY) -> np.ndarray:
    """Ids of a whole text.  Long texts are encoded in stretches that begin at
    the first blank after a non-blank: the vocabulary's pre-tokeniser always
    splits there, so the ids are those of the whole."""
    enc = encoder(vocabulary)
    if len(text) <= _CUT:
        return np.array(enc.encode(text, allowed_special="all"), dtype="<u4")
    parts, at = [], 0
    while at < len(text):
        edge = _EDGE.search(text, at + _CUT)
        end = edge.end() if edge else len(text)
        parts.append(np.array(enc.encode(text[at:end], allowed_special="all"), dtype="<u4"))
        at = end
    return np.concatenate(parts)


def piece_bounds(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: only the first may be shorter."""
    first = n if n <= capacity else (n % capacity or capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _pieces(capacity: int, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(token_ids(text.as_py() or "", vocabulary), np.uint32(END)).astype("<u4")
                for k, (start, length) in enumerate(piece_bounds(len(ids), capacity)):
                    for column, value in zip(out, (doc_id, k, start, length,
                                                   zlib.crc32(ids[start:start + length].tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()),
                                                strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing on run lengths ``{length: pieces}``.

    Returns stretches ``(length, first rank, end rank, pieces per sequence,
    first sequence, offset)``: the pieces of that length with these ranks go,
    so many to each, into consecutive sequences from that offset on.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}         # gap -> runs (first sequence, number)
    order: list[int] = []                               # the gaps in use, sorted
    out, sequences = [], 0

    def put(gap, first, number):
        if gap and number:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, end = 0, counts[length]
        while rank < end:
            at = bisect.bisect_left(order, length)
            if at < len(order):                         # the smallest gap that fits
                gap = order[at]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[at]
            else:
                gap = capacity
                first, number = sequences, -(-(end - rank) // (gap // length))
                sequences += number
            each = gap // length
            whole, part = divmod(end - rank, each)
            if whole >= number:
                whole, part = number, 0
            if whole:
                out.append((length, rank, rank + whole * each, each, first, capacity - gap))
                put(gap - each * length, first, whole)
                rank += whole * each
            if part:
                out.append((length, rank, rank + part, part, first + whole, capacity - gap))
                put(gap - part * length, first + whole, 1)
                rank += part
            used = whole + (part > 0)
            put(gap, first + used, number - used)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` with their places: doc_id, piece,
    start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece holding the end id; a null doc_id is
    packed like any other; repeated rows are packed each; an empty table gives
    no sequence.  Other columns are ignored.  A sequence's pieces lie gapless
    from offset 0.
    """
    spark = docs.sparkSession
    pieces = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                     .mapInArrow(_pieces(capacity, vocabulary), PIECES), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = max(32, sum(counts.values()) // 100_000)    # so that one common length is ranked in many tasks
    slotted = pieces.withColumn("slot", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(slots)).cast("int"))
    before = (slotted.groupBy("length", "slot").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("slot")) - F.col("n")).drop("n"))
    own = F.row_number().over(W.partitionBy("length", "slot").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = (slotted.withColumn("own", own).join(before, ["length", "slot"])
              .withColumn("rank", F.col("own") + F.col("before")))
    # at most capacity runs of gaps meet capacity runs of pieces: a bound that
    # does not depend on the data
    plan = spark.createDataFrame(best_fit(counts, capacity), "l long, a long, b long, each long, first long, at long")
    return (ranked.join(F.broadcast(plan), (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("a"))
                        & (F.col("rank") < F.col("b")))
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    (F.col("first") + F.floor((F.col("rank") - F.col("a")) / F.col("each"))).alias("sequence_id"),
                    (F.col("at") + (F.col("rank") - F.col("a")) % F.col("each") * F.col("length")).alias("offset")))
