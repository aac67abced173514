"""Near-copy components by a prefix-tree join of n-gram sets.

Sets of distinct ``k``-word shingles are joined at Jaccard similarity
``percent`` / 100, exactly.  In a global order of the shingles by frequency a
set is a sequence.  The join stores sequences in a trie, most frequent first,
so that near copies share long paths.  A set probes the trie from the root: the
overlap with a path is counted once for all sets below it, and a subtree is
left when the overlap so far and what both sides have left cannot reach what
the similarity demands of the sizes below (the remaining-length bound), or when
all its sets belong to the probing set's component already.  A link that joins
two components is given out, any other would say nothing new.

Which sets meet in a trie:

1. Equal sets are one class, known by size and 128 bits of hash.
2. By hash order, of a set's first ``n - ceil(t n) + l(n)`` shingles at least
   ``l`` of the smallest admissible partner occur among some other set's first
   ones if it has a partner at all; most sets end here.
3. Shingles are counted over the sets left.  A shingle of one set only is no
   part of any intersection, and a set with fewer than ``ceil(t n)`` others has
   no partner.  Peeling such sets off makes more shingles unique; it is done
   ``PEELS`` times.
4. Two similar sets share one of their ``n - ceil(t n) + 1`` rarest shingles.
   Sets with such a shingle in common are a group; shingles with the same
   sets are one group (128 bits of hash again).
5. First each set joins in its largest group only, then groups that still hold
   several components are joined in full: what lies outside the largest
   component is stored, everything probes.

A group of many shingles in all is dealt to blocks of ``BLOCK``: stored blocks
meet probing blocks, each pair in a task of its own, and in the first round
every block also gets the same few sets, so that blocks grow together.  Nothing
is dropped, and no task holds more than two blocks or a pair of sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm import shingles as S
from caseflow.llm.common import TEXT_ROWS, sized, written
from caseflow.llm.superminhash import union_find

K, PERCENT, PEELS = 4, 85, 3
#: shingles of a block, sets that all blocks of a group share in the first round
BLOCK, SHARED = 1 << 19, 64
_FEW = 500_000


def _fold(hashes: np.ndarray, counts: np.ndarray, salt: int) -> np.ndarray:
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(S.mix(hashes + np.uint64(salt)), out=sums[1:])
    ends = np.cumsum(counts)
    return S.mix(sums[ends] - sums[ends - counts]).view(np.int64)


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _firsts(k: int, percent: int):
    """doc_id, two hashes of the text, n, two hashes of the set, its first
    shingles by hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows, data, offsets in S.chunks(batch.column(3)):
                hashes, n = S.shingle_sets(data, offsets, k)
                first = n - -(-percent * n // 100) + np.where(n > 0, np.maximum(1, n // 10), 0)
                first = np.minimum(first, n)
                spot = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n)
                values = hashes.view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(at, rows) for c in range(3)), pa.array(n), pa.array(_fold(hashes, n, 0x2B992DDF)),
                     pa.array(_fold(hashes, n, 0x6C8E9CF5)), _lists(first, values[spot < np.repeat(first, n)])],
                    names=["doc_id", "t1", "t2", "n", "f1", "f2", "first"])
    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows, data, offsets in S.chunks(batch.column(1)):
                hashes, n = S.shingle_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, rows), pa.array(n), _lists(n, hashes.view(np.int64))], names=["cls", "n", "hashes"])
    return run


class Trie:
    """Compressed trie over ascending integer sequences.  Node ``v`` covers the
    sorted sequences ``low[v]`` to ``high[v]`` and their places ``start[v]`` to
    ``end[v]``."""

    def __init__(self, sequences: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sequences)), key=lambda i: sequences[i].astype(">u4").tobytes())
        self.order, self.seqs = order, [sequences[i] for i in order]
        self.sizes = sizes[order]
        lengths = np.array([len(s) for s in self.seqs])
        same = np.zeros(len(order), dtype=np.int64)           # places shared with the sequence before
        for i in range(1, len(order)):
            a, b = self.seqs[i - 1], self.seqs[i]
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            same[i] = int(differ.argmax()) if differ.any() else m
        self.nodes = []                                       # low, high, start, end, longest, least, most, children
        todo = [(0, len(order), 0, None)]
        while todo:
            low, high, start, up = todo.pop()
            end = int(lengths[low]) if high - low == 1 else int(same[low + 1:high].min())
            node = (low, high, start, end, int(lengths[low:high].max()), int(self.sizes[low:high].min()),
                    int(self.sizes[low:high].max()), [])
            if up is not None:
                self.nodes[up][7].append(len(self.nodes))
            if high - low > 1:
                cuts = [low, *(low + 1 + np.flatnonzero(same[low + 1:high] == end)).tolist(), high]
                todo += [(a, b, end, len(self.nodes)) for a, b in zip(cuts, cuts[1:], strict=False)]
            self.nodes.append(node)

    def probe(self, sequence: np.ndarray, size: int, mark: np.ndarray, part: np.ndarray, mine: int, percent: int) -> Iterator[int]:
        """Places (in ``order``) of the stored sets outside component ``mine``
        (``part`` has the components) that are similar to a set of ``size``
        elements, of which ``sequence`` can be shared; ``mark`` is true for those.
        ``part`` may change between two results."""
        least, most = -(-percent * size // 100), 100 * size // percent
        todo = [(0, 0)]
        while todo:
            v, overlap = todo.pop()
            low, high, start, end, longest, small, large, kids = self.nodes[v]
            if large < least or small > most or not (part[low:high] != mine).any():
                continue
            seq = self.seqs[low]
            overlap += int(mark[seq[start:end]].sum())
            left = len(sequence) - int(np.searchsorted(sequence, seq[end - 1], side="right")) if end else len(sequence)
            need = percent * (size + max(small, least))
            if (100 + percent) * (overlap + min(left, longest - end)) < need:
                continue
            if kids:
                todo += [(kid, overlap) for kid in kids]
            else:
                yield low


def join_group(hashes: list[np.ndarray], counts: list[np.ndarray], sizes: np.ndarray, parts: np.ndarray,
               stored: np.ndarray, probing: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs (probing, stored) of similar sets that join all components of the
    group.  ``hashes`` has each set's shareable shingles, rarest first,
    ``counts`` their frequencies, ``sizes`` the sizes of the whole sets."""
    flat, often = np.concatenate(hashes), np.concatenate(counts)
    known, first, place = np.unique(flat, return_index=True, return_inverse=True)
    rank = np.empty(len(known), dtype=np.int64)
    rank[np.lexsort((known, often[first]))[::-1]] = np.arange(len(known))
    ends = np.cumsum([len(h) for h in hashes])
    sequences = [rank[place[e - len(h):e]][::-1] for e, h in zip(ends, hashes, strict=True)]
    held = np.flatnonzero(stored)
    trie = Trie([sequences[i] for i in held], sizes[held])
    member = [int(held[i]) for i in trie.order]
    part, label = parts[member], parts.copy()
    mark = np.zeros(len(known), dtype=bool)
    out = []
    if len(np.unique(parts)) == 1:
        return out
    for q in np.flatnonzero(probing).tolist():
        mark[sequences[q]] = True
        for low in trie.probe(sequences[q], int(sizes[q]), mark, part, label[q], percent):
            if part[low] != label[q]:
                out.append((q, member[low]))
                gone, mine = part[low], label[q]
                part[part == gone] = mine
                label[label == gone] = mine
        mark[sequences[q]] = False
    return out


def _groups(percent: int):
    """Join every task (g, i, j); its rows follow each other."""
    def join(rows: pa.Table) -> tuple[list, list]:
        held = [(c.values.to_numpy(), np.asarray(c.offsets)) for c in (
            rows[n].combine_chunks() for n in ("hashes", "counts"))]
        hashes, counts = ([v[a:b] for a, b in zip(o, o[1:], strict=False)] for v, o in held)
        cls = rows["cls"].to_numpy()
        pairs = join_group(hashes, counts, rows["n"].to_numpy(), rows["part"].to_numpy().copy(),
                           rows["stored"].to_numpy(), rows["probing"].to_numpy(), percent)
        return [cls[a] for a, _ in pairs], [cls[b] for _, b in pairs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait, key = [], None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = [0, *(1 + np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0))).tolist(), batch.num_rows]
            us, vs = [], []
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                now = tuple(keys[:, a].tolist())
                if now != key and wait:
                    u, v = join(pa.Table.from_batches(wait))
                    us, vs, wait = us + u, vs + v, []
                key = now
                wait.append(batch.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
        if wait:
            u, v = join(pa.Table.from_batches(wait))
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
    return run


def _need(n: Column, percent: int) -> Column:
    return F.ceil(n * percent / 100 - 1e-9).cast("long")


def _joined(tasks: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """Links (u, v) of the tasks ``(g, i, j, cls, part, stored, probing)``."""
    rows = tasks.join(sets.select("cls", "n", "hashes", "counts"), "cls")
    rows = rows.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j").select(
        "g", "i", "j", "cls", "n", "part", "stored", "probing", "hashes", "counts")
    return written(rows.mapInArrow(_groups(percent), "u long, v long"), name, TEXT_ROWS)


def _blocks(weight: Column) -> Column:
    return F.ceil(weight / BLOCK).cast("long")


def _first_round(posts: DataFrame) -> DataFrame:
    """Every set in its largest group."""
    pick = posts.groupBy("cls").agg(F.max_by("g", F.struct("m", "g")).alias("g"), F.max("size").alias("size"))
    groups = pick.groupBy("g").agg(F.count(F.lit(1)).alias("m"), _blocks(F.sum("size")).alias("k")).where("m > 1")
    everywhere = (F.col("k") > 1) & (F.pmod(F.xxhash64("cls", F.lit(7)), F.ceil(F.col("m") / SHARED)) == 0)
    block = F.when(everywhere, F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("cls"), F.col("k"))))
    return pick.join(groups, "g").select(
        "g", F.explode(block).alias("i"), F.lit(0).cast("long").alias("j"), "cls", F.col("cls").alias("part"),
        F.lit(True).alias("stored"), F.lit(True).alias("probing"))


def _second_round(posts: DataFrame, parts: DataFrame) -> DataFrame:
    """Groups with several components: the sets outside the largest one are
    stored, all probe."""
    posts = written(posts.join(parts.select(F.col("node").alias("cls"), "component"), "cls", "left")
                    .select("g", "cls", "size", F.coalesce("component", "cls").alias("part")), "placed")
    each = posts.groupBy("g", "part").agg(F.sum("size").alias("weight"), F.count(F.lit(1)).alias("sets"))
    groups = each.groupBy("g").agg(
        F.count(F.lit(1)).alias("parts"), F.max_by("part", F.struct("sets", "part")).alias("main"),
        F.sum("weight").alias("weight"), F.max_by("weight", F.struct("sets", "part")).alias("main_weight"))
    groups = groups.where("parts > 1").select(
        "g", "main", _blocks(F.col("weight")).alias("k"), _blocks(F.col("weight") - F.col("main_weight")).alias("kept"))
    rows = posts.join(groups, "g")

    def dealt(salt, k):
        return F.array(F.pmod(F.xxhash64("cls", F.lit(salt)), k))

    def spread(k):
        return F.sequence(F.lit(0).cast("long"), k - 1)
    kept, k = F.col("kept"), F.col("k")
    stored = rows.where(F.col("part") != F.col("main")).select(
        "g", "cls", "part", F.explode(dealt(1, kept)).alias("i"), "k", F.lit(True).alias("stored")).select(
        "g", "cls", "part", "i", F.explode(spread(k)).alias("j"), "stored")
    probing = rows.select("g", "cls", "part", F.explode(spread(kept)).alias("i"), "k").select(
        "g", "cls", "part", "i", F.explode(dealt(2, k)).alias("j"), F.lit(False).alias("stored"))
    both = stored.unionByName(probing)
    return both.groupBy("g", "i", "j", "cls", "part").agg(
        F.max("stored").alias("stored"), (F.min("stored") == F.lit(False)).alias("probing"))


def components(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """Components of ``docs(doc_id, text)`` under ``100 * |A & B| >= percent *
    |A | B|`` on the sets of distinct ``k``-word shingles: doc_id, n_shingles,
    component_id (the least doc_id reachable), one row per input row.

    A-Z are lower-cased; words are runs outside blank and 0x09-0x0D; a text of
    fewer than ``k`` words is one shingle.  Null and empty texts have none and
    are linked with nothing: their component is their own id.  Repeated rows,
    and rows of one doc_id with different texts, each count; a null doc_id takes
    part with its text and is no component's id unless it has no other.  Texts
    are taken whole; an empty table gives an empty result; other columns are
    ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    docs = written(texts.mapInArrow(
        _firsts(k, percent), "doc_id long, t1 long, t2 long, n long, f1 long, f2 long, first array<long>")
        .withColumn("row", F.monotonically_increasing_id()), "firsts", TEXT_ROWS)
    classes = written(docs.where("n > 0").groupBy("n", "f1", "f2").agg(
        F.min("row").alias("cls"), F.min(F.struct("t1", "t2")).alias("t"), F.min("doc_id").alias("least"),
        F.count(F.lit(1)).alias("copies")), "classes")

    # step 2: classes with enough of their first shingles in other classes
    firsts = (docs.join(sized(classes.select(F.col("cls").alias("row")), _FEW), "row", "left_semi")
              .select(F.col("row").alias("cls"), "n", F.explode("first").alias("h")))
    common = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    enough = F.greatest(F.lit(1), F.floor(_need(F.col("n"), percent) / 10))
    some = written(firsts.join(common, "h").groupBy("cls", "n").agg(F.count(F.lit(1)).alias("hits"))
                   .where(F.col("hits") >= enough).join(classes.select("cls", "t.*"), "cls").select("cls", "t1", "t2"), "some")

    # step 3: shareable shingles of the classes left, rarest first
    sets = written(texts.join(sized(some, _FEW), ["t1", "t2"]).dropDuplicates(["cls"]).select("cls", "text")
                   .mapInArrow(_sets(k), "cls long, n long, hashes array<long>"), "sets", TEXT_ROWS)
    for _ in range(PEELS):
        each = sets.select("cls", "n", F.explode("hashes").alias("h"))
        often = each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        sets = (each.join(often, "h").groupBy("cls", "n")
                .agg(F.sort_array(F.collect_list(F.struct(F.col("c").cast("int").alias("c"), "h"))).alias("t"))
                .where(100 * F.size("t") >= percent * F.col("n"))
                .select("cls", "n", F.col("t.h").alias("hashes"), F.col("t.c").alias("counts")))
        sets = written(sets, "shared")

    # step 4: groups
    size = F.size("hashes").cast("long")
    rare = (F.col("n") - _need(F.col("n"), percent) + 1 - (F.col("n") - size)).cast("int")
    posts = sets.select("cls", size.alias("size"), F.explode(F.slice("hashes", F.lit(1), rare)).alias("g"))
    same = [F.bit_xor(F.xxhash64("cls")).alias("x1"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("x2")]
    groups = (posts.groupBy("g").agg(F.count(F.lit(1)).alias("m"), *same).where("m > 1")
              .groupBy("m", "x1", "x2").agg(F.min("g").alias("g")).select("g", "m"))
    posts = written(posts.join(groups, "g"), "groups")

    # step 5
    links = _joined(_first_round(posts), sets, percent, "links")
    more = _joined(_second_round(posts, union_find(links)), sets, percent, "more")
    parts = union_find(links.unionByName(more)).select(F.col("node").alias("cls"), F.col("component").alias("part"))

    # classes that are alone with a single row keep that row's id
    least = classes.join(parts, "cls").groupBy("part").agg(F.min("least").alias("low"))
    linked = classes.join(parts, "cls").join(least, "part").select("n", "f1", "f2", F.col("low").alias("component_id"))
    alone = classes.where("copies > 1").join(parts, "cls", "left_anti").select("n", "f1", "f2", F.col("least").alias("component_id"))
    known = written(linked.unionByName(alone), "known")
    return (docs.select("doc_id", "n", "f1", "f2").join(sized(known), ["n", "f1", "f2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")))
