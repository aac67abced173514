"""MinHash near-duplicate detection with SuperMinHash signatures.

SuperMinHash (Ertl 2017): every element of a set draws, step by step, the next
slot of its own pseudo-random permutation of the m signature slots and a
uniform number; at step j the slot is offered ``j + uniform``.  The slots of
one element are thereby correlated (each is hit once), which lowers the
variance against independent minima.  A value offered at step j is at least j,
so a set is finished after the first step at which all its slots are below
``j + 1``: the early stop.  Here the steps run in the outer loop and all
elements of a chunk of documents in numpy vectors, with the same result as
element by element.

The job (everything distributed, nothing per document on the driver):

1. One pass over the texts: set size, a 128-bit fingerprint of the shingle
   set, and the band hashes of the signature.  Documents with equal sets form
   a class; only classes go on, so a copied text counts once whatever its
   number of copies.
2. Classes that share a band bucket with another class are candidates; their
   full shingle sets are computed once and written.
3. Star round: in each bucket the member that shares most buckets with others
   is the centre; every member is verified against it on full sets (a linear
   number of pairs), and links are joined by distributed union-find.
4. Rest round, exact: buckets that still hold several components verify the
   pairs across components.  A member's shingles that no other member of such
   buckets has bound the intersection it can reach, so hopeless members and
   pairs are discarded by an exact test before any pair is verified.

With m = 128, 32 bands of 4 rows, a pair at similarity 0.85 misses every band
with probability (1 - 0.85^4)^32 < 6e-11.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.llm import shingles as S
from caseflow.llm.common import TEXT_ROWS, sized, written

SLOTS, ROWS = 128, 4
#: elements drawn for at a time
ELEMENTS = 1 << 16

_SEED, _STEP = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E3779B97F4A7C15)


def superminhash(hashes: np.ndarray, counts: np.ndarray, m: int = SLOTS) -> np.ndarray:
    """Signatures (documents x m, float64) of sets given as concatenated
    element hashes and element counts; an empty set has infinity everywhere."""
    docs = len(counts)
    out = np.full(docs * m, np.inf)
    if not len(hashes):
        return out.reshape(docs, m)
    rows = np.repeat(np.arange(docs), counts)
    for first in range(0, len(hashes), ELEMENTS):        # a long text's permutations are never there all at once
        _offer(out, rows[first:first + ELEMENTS], hashes[first:first + ELEMENTS], m)
    return out.reshape(docs, m)


def _offer(out: np.ndarray, row: np.ndarray, hashes: np.ndarray, m: int) -> None:
    """Lower the slots ``out`` (flat) by what the elements of ``row`` draw."""
    state = S.mix(hashes ^ _SEED)
    low, high = int(row[0]), int(row[-1]) + 1
    own = out[low * m:high * m]
    row = row - low
    perm = np.tile(np.arange(m, dtype=np.uint16 if m > 256 else np.uint8), (len(hashes), 1))
    for j in range(m):
        state = S.mix(state + _STEP)
        unit = (state >> np.uint64(12)).astype(np.float64) * 2.0 ** -52
        pick = (S.mix(state ^ _SEED) >> np.uint64(40)).astype(np.int64)
        k = j + pick % (m - j)
        at = np.arange(len(state))
        slot = perm[at, k].astype(np.int64)
        perm[at, k] = perm[:, j]
        np.minimum.at(own, row * m + slot, unit + j)
        done = own.reshape(-1, m).max(axis=1) <= j + 1
        go = ~done[row]
        if not go.any():
            break
        if go.sum() < 0.8 * len(go):
            row, state, perm = row[go], state[go], perm[go]


def band_hashes(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit hash per band of ``rows`` slots, different for every band."""
    bits = signatures.view(np.uint64)
    docs, m = bits.shape
    out = np.empty((docs, m // rows), dtype=np.uint64)
    for b in range(m // rows):
        h = np.full(docs, b + 1, dtype=np.uint64)
        for r in range(rows):
            h = S.mix(h * _STEP + bits[:, b * rows + r])
        out[:, b] = h
    return out


def _fold(hashes: np.ndarray, counts: np.ndarray, salt: int) -> np.ndarray:
    """Order-free 64-bit fingerprint of each set."""
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(S.mix(hashes ^ np.uint64(salt)), out=sums[1:])
    ends = np.cumsum(counts)
    return S.mix(sums[ends] - sums[ends - counts])


def _fingerprints(k: int, m: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(2)
            for at, n, data, offsets in S.chunks(batch.column(1)):
                hashes, counts = S.shingle_sets(data, offsets, k)
                bands = band_hashes(superminhash(hashes, counts, m), rows)
                flat = pa.array(bands.reshape(-1).view(np.int64))
                per = np.where(counts > 0, bands.shape[1], 0)
                flat = flat if (per > 0).all() else pa.array(bands[counts > 0].reshape(-1).view(np.int64))
                ends = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, n), keys.slice(at, n), pa.array(counts),
                     pa.array(_fold(hashes, counts, 0x51ED270B).view(np.int64)),
                     pa.array(_fold(hashes, counts, 0x7F4A7C15).view(np.int64)),
                     pa.ListArray.from_arrays(pa.array(ends), flat)],
                    names=["doc_id", "text_key", "n_shingles", "f1", "f2", "bands"])
    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for at, n, data, offsets in S.chunks(batch.column(1)):
                hashes, counts = S.shingle_sets(data, offsets, k)
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, n), pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes.view(np.int64)))],
                    names=["class_id", "shingles"])
    return run


def union_find(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of ``links(u, v)`` as ``(node, component)``, the
    component being its smallest node: alternating large-star and small-star
    contraction (Kiveris et al. 2014), the distributed form of union-find with
    path compression.  Every round is two aggregations and joins; each writes
    its edges to the shared folder, so lineage stays short.  Nodes without a
    link do not appear."""
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .where("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")),
                                                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
                                                      ).alias("e")).select("e.*").where("u <> v").distinct()
        edges = written(small, "edges")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("union_find did not converge")
    return (edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    left = sets.select(F.col("class_id").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("class_id").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return (pairs.join(left, "u").join(right, "v")
            .where(100 * both >= percent * (F.size("a") + F.size("b") - both)).select("u", "v"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, m: int = SLOTS, rows: int = ROWS) -> DataFrame:
    """Near-duplicate components of ``docs(doc_id, text)``.

    Two documents are linked when ``100 * |A & B| >= percent * |A | B|`` on
    their sets of distinct ``k``-word shingles.  Returns one row per input row:
    ``doc_id, n_shingles, component_id, kept``; ``component_id`` is the
    smallest doc_id of the component, ``kept`` marks the rows that carry it.

    Nulls and empty texts have no shingles and are linked with nothing (their
    component is their own id).  A null doc_id takes part with its text and is
    kept only where its whole component has no id.  Repeated rows are copies
    of each other.  Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sigs = written(texts.withColumn("text_key", _text_key()).mapInArrow(
        _fingerprints(k, m, rows),
        "doc_id long, text_key long, n_shingles long, f1 long, f2 long, bands array<long>")
        .withColumn("row", F.monotonically_increasing_id()), "signatures", TEXT_ROWS)
    key = ["n_shingles", "f1", "f2"]
    # a class is known by a row number: one doc_id may stand on several texts
    classes = (sigs.where("n_shingles > 0").groupBy(*key)
               .agg(F.min("row").alias("class_id"), F.min("doc_id").alias("least"),
                    F.min(F.struct("doc_id", "text_key")).alias("text"), F.any_value("bands").alias("bands")))
    classes = written(classes, "classes")
    bands = classes.select("class_id", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    bands = written(bands.join(shared, "bucket"), "buckets")

    # full sets of the candidate classes, once
    wanted = classes.join(bands.select("class_id").distinct(), "class_id", "left_semi").select(
        "class_id", F.col("text.doc_id").alias("d"), F.col("text.text_key").alias("x"))
    sets = written(texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (_text_key() == F.col("x")))
                   .select("class_id", "text").dropDuplicates(["class_id"])
                   .mapInArrow(_sets(k), "class_id long, shingles array<long>"), "sets", TEXT_ROWS)

    score = bands.groupBy("class_id").agg(F.sum("c").alias("score"))
    rank = F.struct("score", (-F.col("class_id")).alias("r"))
    centre = (bands.join(score, "class_id").groupBy("bucket")
              .agg(F.max_by("class_id", rank).alias("centre"), F.max_by("n", rank).alias("centre_n")))
    close = 100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n")
    tried = written(bands.join(centre, "bucket").where(close & (F.col("class_id") != F.col("centre")))
                    .select(F.least("class_id", "centre").alias("u"), F.greatest("class_id", "centre").alias("v"))
                    .distinct(), "star")
    links = written(_verified(tried, sets, percent), "links")
    parts = union_find(links)

    members = bands.select("class_id", "bucket", "n").join(
        parts.withColumnRenamed("node", "class_id"), "class_id", "left").select(
        "class_id", "bucket", "n", F.coalesce("component", "class_id").alias("part"))
    open_ = members.groupBy("bucket").agg(F.min("part").alias("p"), F.max("part").alias("q")).where("p <> q")
    rest = written(members.join(open_.select("bucket"), "bucket"), "rest")
    rest = _reachable(rest, sets, percent)
    # a pair meets in every band it shares; it is made in the first one only
    rest = rest.join(classes.select("class_id", "bands"), "class_id")
    a, b = (rest.select("bucket", *(F.col(c).alias(f"{c}_{s}") for c in ("class_id", "n", "part", "common", "bands")))
            for s in "ab")
    need = percent * (F.col("n_a") + F.col("n_b"))
    meet = F.zip_with("bands_a", "bands_b", lambda x, y: F.when(x == y, x))
    first = F.get(F.filter(meet, lambda x: x.isNotNull()), F.lit(0))
    pairs = (a.join(b, (a.bucket == b.bucket) & (F.col("class_id_a") < F.col("class_id_b"))
                    & (F.col("part_a") != F.col("part_b"))
                    & ((100 + percent) * F.least("common_a", "common_b") >= need) & (first == a.bucket))
             .select(F.col("class_id_a").alias("u"), F.col("class_id_b").alias("v")).distinct()
             .join(tried, ["u", "v"], "left_anti"))
    more = _verified(written(pairs, "rest_pairs"), sets, percent)
    parts = union_find(links.unionByName(more))

    linked = classes.select(*key, "class_id", "least").join(parts.withColumnRenamed("node", "class_id"), "class_id", "left")
    linked = linked.withColumn("component", F.coalesce("component", "class_id"))
    ids = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    named = linked.join(ids, "component").select(*key, "component_id")
    out = (sigs.drop("bands", "row").join(named, key, "left")
           .withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))))
    return out.select("doc_id", "n_shingles", "component_id",
                      F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_key")


def _text_key():
    """64-bit hash of the text as it is (null as empty): tells rows with the
    same doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _reachable(rest: DataFrame, sets: DataFrame, percent: int, rounds: int = 2) -> DataFrame:
    """Members of open buckets that can still have a partner.  ``common`` counts
    a member's shingles that some other member has: no intersection exceeds it,
    so a member needs a partner no larger than ``(100 + percent) / percent *
    common - n``; a bucket without one lets it go.  Exact, and repeated, since
    each round lowers the counts."""
    for _ in range(rounds):
        ids = rest.select("class_id").distinct()
        each = sets.join(ids, "class_id", "left_semi").select("class_id", F.explode("shingles").alias("h"))
        often = each.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("class_id").alias("only")).where("c = 1")
        alone = often.groupBy(F.col("only").alias("class_id")).agg(F.count(F.lit(1)).alias("alone"))
        rest = rest.drop("common").join(alone, "class_id", "left").select(
            "class_id", "bucket", "n", "part", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"))
        most = ((100 + percent) * F.col("common") - percent * F.col("n"))      # percent * largest partner
        rest = rest.where(most >= percent * F.col("common"))
        edge = rest.groupBy("bucket").agg(F.min("n").alias("least"), F.max(most).alias("most"),
                                          F.min("part").alias("p"), F.max("part").alias("q"))
        rest = written(rest.join(edge, "bucket").where((most >= percent * F.col("least"))
                                                       & (F.col("most") >= percent * F.col("n")) & (F.col("p") != F.col("q")))
                       .select("class_id", "bucket", "n", "part", "common"), "rest")
    return rest


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with all columns and one row per near-duplicate component: the
    row of its smallest doc_id.  Rows without shingles all stay; of repeated
    rows (equal doc_id and text) one stays.  No text is shuffled unless a row
    is repeated."""
    found = near_duplicates(docs, k, percent)
    key = [F.col("doc_id").alias("_d"), F.col("text_key").alias("_x")]
    gone = written(found.where(~F.col("kept")).select(*key).distinct(), "gone")
    twice = written(found.where("kept and n_shingles > 0").groupBy(*key).agg(F.count(F.lit(1)).alias("c"))
                    .where("c > 1").drop("c"), "twice")
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)),
                       F.col("doc_id").cast("long").alias("_id"), _text_key().alias("_text"))
    same = F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_text") == F.col("_x"))
    left = rows.join(sized(gone), same, "left_anti")
    if not twice.isEmpty():
        one = left.join(sized(twice), same, "left_semi").dropDuplicates(["_id", "_text"])
        left = left.join(sized(twice), same, "left_anti").unionByName(one)
    return left.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
