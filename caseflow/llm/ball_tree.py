"""Exact ranked lexical search with sparse ball trees.

A document is a sparse vector of integer term contributions, an item a sparse
vector of its terms' counts; the score is their inner product.  Documents are
dealt to blocks, and each block is a ball tree: a node holds the centroid of
its documents, the radius around it, and two children split along the line
between far-apart documents.  For an item ``q`` no document below a node scores
more than ``q . centroid + |q| * radius``; the largest contribution of each term
below the node gives a second bound, and the smaller of the two counts.  Bounds
are computed in doubles and rounded up by more than the arithmetic can err.
Nodes are visited best bound first until the bound falls below the item's k-th
best score so far, which is carried from block to block; leaves are scored in
64-bit integers.  So the ranking is exact, ties included.

The job: one pass turns texts into vectors over the terms that occur in items
(others add nothing to any score) and counts all terms; document frequencies
and totals are aggregated over all documents; a second pass, over the vectors,
builds and searches the trees task by task and gives each task's k best per
item, which are ranked again by item, salted first.  Items go in blocks of a
bounded number of terms; only their terms and the document frequencies of
these reach the driver.  Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseflow.llm import shingles as S
from caseflow.llm.common import TEXT_ROWS, written

TOP = 20
#: terms of an item block, documents and entries of a tree, documents of a leaf
ITEM_TERMS, TREE_DOCS, TREE_ENTRIES, LEAF = 1 << 18, 2048, 1 << 18, 32
_DENSE = 1 << 21                                     # numbers of a dense matrix
_SALTS = 64

_SPLIT = np.ones(256, dtype=bool)
_SPLIT[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _per_row(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys (>= 0, else skipped) of each row, ascending: their number per
    row, the keys, how often each occurs."""
    row = np.repeat(np.arange(len(counts)), counts)
    on = keys >= 0
    row, keys = row[on], keys[on]
    order = np.lexsort((keys, row))
    row, keys = row[order], keys[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (keys[1:] != keys[:-1])
    at = np.flatnonzero(new)
    return np.bincount(row[at], minlength=len(counts)), keys[at], np.diff(np.append(at, len(row)))


def _lists(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                                    pa.array(values.astype(np.int64)))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, n, data, offsets in S.chunks(batch.column(1)):
            hashes, counts = S.word_hashes(data, offsets, _SPLIT)
            values, index = np.unique(hashes, return_inverse=True)
            sizes, keys, times = _per_row(index.astype(np.int64), counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(at, n), _lists(sizes, values.view(np.int64)[keys]), _lists(sizes, times)],
                names=["item_id", "terms", "times"])


def _vectors(vocabulary: np.ndarray):
    """doc_id, n (all its terms), cols (places in the vocabulary), tfs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, data, offsets in S.chunks(batch.column(1)):
                hashes, counts = S.word_hashes(data, offsets, _SPLIT)
                place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                sizes, cols, tfs = _per_row(np.where(vocabulary[place] == hashes, place, -1), counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(counts), _lists(sizes, cols), _lists(sizes, tfs)],
                    names=["doc_id", "n", "cols", "tfs"])
    return run


class BallTree:
    """A tree over sparse rows (``starts``, ``cols``, ``vals``; every row has
    entries, columns are 0 to ``width``-1).  ``order`` holds the rows as leaves
    hold them, node ``k`` those from ``low[k]`` to ``high[k]``."""

    def __init__(self, starts: np.ndarray, cols: np.ndarray, vals: np.ndarray, width: int, leaf: int = LEAF):
        docs = len(starts) - 1
        leaf = max(leaf, -(-2 * docs * width // _DENSE))     # fewer nodes where vectors are wide
        real = vals.astype(np.float64)
        size = np.diff(starts)
        square = np.add.reduceat(real * real, starts[:-1])
        self.order = np.arange(docs)
        self.low, self.high, self.kids, centres, tops, self.radius = [0], [docs], [], [], [], []
        k = 0
        while k < len(self.low):
            a, b = self.low[k], self.high[k]
            rows = self.order[a:b]
            at = _spans(starts[rows], size[rows])
            ends = np.cumsum(size[rows]) - size[rows]
            c, v = cols[at], real[at]
            centre = np.bincount(c, weights=v, minlength=width) / (b - a)
            top = np.zeros(width)
            np.maximum.at(top, c, v)
            away = square[rows] - 2 * np.add.reduceat(v * centre[c], ends) + centre @ centre
            slack = 1e-10 * (square[rows].max() + centre @ centre)
            self.radius.append(math.sqrt(max(away.max(), 0.0) + slack))
            centres.append(centre)
            tops.append(top)
            if b - a <= leaf:
                self.kids.append(None)
            else:
                far = int(away.argmax())
                line = self._dense(starts, cols, real, rows[far], width)
                apart = square[rows] - 2 * np.add.reduceat(v * line[c], ends)
                line = line - self._dense(starts, cols, real, rows[int(apart.argmax())], width)
                half = (b - a) // 2
                self.order[a:b] = rows[np.argpartition(np.add.reduceat(v * line[c], ends), half)]
                self.kids.append((len(self.low), len(self.low) + 1))
                self.low += [a, a + half]
                self.high += [a + half, b]
            k += 1
        self.centres, self.tops, self.radius = np.array(centres), np.array(tops), np.array(self.radius)
        at = _spans(starts[self.order], size[self.order])
        self.cols, self.vals = cols[at], vals[at]
        self.starts = np.concatenate([[0], np.cumsum(size[self.order])])

    @staticmethod
    def _dense(starts, cols, vals, row, width):
        out = np.zeros(width)
        out[cols[starts[row]:starts[row + 1]]] = vals[starts[row]:starts[row + 1]]
        return out

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds (items x nodes) for items x columns."""
        norm = np.sqrt((q * q).sum(axis=1))
        ball = q @ self.centres.T + norm[:, None] * self.radius[None, :]
        return np.minimum(ball, q @ self.tops.T) * (1 + 1e-9) + 1

    def scores(self, q: np.ndarray, node: int) -> np.ndarray:
        """Exact scores of the rows of a node, in the order of ``order``."""
        a, b = self.low[node], self.high[node]
        s, e = self.starts[a], self.starts[b]
        return np.add.reduceat(self.vals[s:e] * q[self.cols[s:e]], self.starts[a:b] - s)

    def search(self, q: np.ndarray, bound: np.ndarray, best: Best) -> int:
        """Best-first search for one item (int64 counts); number of leaves scored."""
        todo, leaves = [(-bound[0], 0)], 0
        while todo and -todo[0][0] >= best.least():
            _, node = heapq.heappop(todo)
            if self.kids[node] is None:
                leaves += 1
                scores = self.scores(q, node)
                for i in np.flatnonzero(scores >= best.least()):
                    best.add(int(scores[i]), int(self.order[self.low[node] + i]))
            else:
                for kid in self.kids[node]:
                    heapq.heappush(todo, (-bound[kid], kid))
        return leaves


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of runs of ``sizes`` from ``starts``, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Best:
    """The k best (score, document) so far; ties go to the smaller id, rows
    without one come last."""

    def __init__(self, k: int):
        self.k, self.heap, self.ids = k, [], []

    def least(self) -> int:
        return max(1, self.heap[0][0]) if len(self.heap) == self.k else 1

    def add(self, score: int, row: int):
        doc = self.ids[row]
        entry = (score, -(1 << 63) - 1 if doc is None else -doc, doc is None)
        if len(self.heap) < self.k:
            heapq.heappush(self.heap, entry)
        else:
            heapq.heappushpop(self.heap, entry)


def _search(items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """Trees over the vectors of a task, searched for all items of a block
    (places in the vocabulary and counts); its k best documents of each."""
    def tree_of(docs):
        n, cols, tfs = (np.concatenate([d[i] for d in docs]) for i in range(3))
        size = np.concatenate([d[3] for d in docs])
        m = np.repeat(75 + 25 * n * n_docs // n_terms, size)
        vals = weights[cols] * (1_000_000_000 * tfs // (1000 * tfs + 12 * m))
        places, local = np.unique(cols, return_inverse=True)
        return places, BallTree(np.concatenate([[0], np.cumsum(size)]), local, vals, len(places))

    def visit(docs, best):
        places, tree = tree_of(docs)
        ids = [i for d in docs for i in d[4]]
        step = max(1, _DENSE // len(places))
        for first in range(0, len(items), step):
            q = np.zeros((min(step, len(items) - first), len(places)), dtype=np.int64)
            for r, (cols, times) in enumerate(items[first:first + step]):
                at = np.minimum(np.searchsorted(places, cols), len(places) - 1)
                on = places[at] == cols
                q[r, at[on]] = times[on]
            bounds = tree.bounds(q.astype(np.float64))
            for r in range(len(q)):
                best[first + r].ids = ids
                tree.search(q[r], bounds[r], best[first + r])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, docs, entries, rows = [Best(k) for _ in items], [], 0, 0
        for batch in batches:
            ids, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            ends = np.asarray(batch.column(2).offsets, dtype=np.int64)
            cols, tfs = (batch.column(c).values.to_numpy() for c in (2, 3))
            at = 0
            while at < len(ids):
                room = int(np.searchsorted(ends, ends[at] + TREE_ENTRIES - entries, side="right")) - 1
                to = min(len(ids), at + TREE_DOCS - rows, max(room, at + (not docs)))
                if to > at:
                    s, e = ends[at], ends[to]
                    docs.append((n[at:to], cols[s:e], tfs[s:e], np.diff(ends[at:to + 1]), ids[at:to]))
                    entries, rows, at = entries + int(e - s), rows + to - at, to
                if at < len(ids):
                    visit(docs, best)
                    docs, entries, rows = [], 0, 0
        if docs:
            visit(docs, best)
        found = [(i, None if none else -doc, score) for i, b in enumerate(best) for score, doc, none in b.heap]
        if found:
            item, doc, score = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())],
                                             names=["item", "doc_id", "score"])
    return run


def rank(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The ``k`` best documents of ``docs(doc_id, text)`` for every row of
    ``items(item_id, text)``, scores above 0 only: item_id, rank, doc_id, score.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII,
    only A-Z lower-cased.  Null and empty texts have none: such documents count
    nowhere, such items find nothing.  Repeated rows are documents, or items, of
    their own; equal scores go by doc_id, rows without one last.  Very long
    texts are taken whole (a text's own vector is never cut).  An empty table
    gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    text = F.col("text").cast("string").alias("text")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    terms = written(items.select(F.col("item_id").cast("long").alias("item_id"), text).mapInArrow(
        _item_terms, "item_id long, terms array<long>, times array<long>")
        .where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()), "items", TEXT_ROWS)
    total = terms.agg(F.sum(F.size("terms"))).first()[0]
    if not total:
        return spark.createDataFrame([], schema)
    blocks, out, sums = -(-total // ITEM_TERMS), None, None
    for b in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).toArrow().sort_by("item")
        if not rows.num_rows:
            continue
        held = [np.array(t, dtype=np.int64).view(np.uint64) for t in rows["terms"].to_pylist()]
        vocabulary = np.unique(np.concatenate(held))
        block = [(np.searchsorted(vocabulary, t), np.array(c, dtype=np.int64)) for t, c in
                 zip(held, rows["times"].to_pylist(), strict=True)]
        block = [(t[o], c[o]) for t, c in block for o in (np.argsort(t),)]
        vectors = written(texts.mapInArrow(_vectors(vocabulary), "doc_id long, n long, cols array<long>, tfs array<long>"),
                          "vectors", TEXT_ROWS)
        if sums is None:
            sums = vectors.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
        n_docs, n_terms = sums
        if not n_docs:
            break
        df = np.zeros(len(vocabulary), dtype=np.int64)
        seen = vectors.select(F.explode("cols").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("df")).toArrow()
        df[seen["c"].to_numpy()] = seen["df"].to_numpy()
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
        found = written(vectors.where(F.size("cols") > 0).mapInArrow(
            _search(block, weights, n_docs, n_terms, k), "item long, doc_id long, score long"), "found")
        names = spark.createDataFrame(list(enumerate(rows["item_id"].to_pylist())), "item long, item_id long")
        order = [F.col("score").desc(), F.asc_nulls_last("doc_id")]
        some = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)))
        some = some.withColumn("rank", F.row_number().over(W.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
        some = some.withColumn("rank", F.row_number().over(W.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        some = some.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")     # at most ITEM_TERMS rows
        out = some if out is None else out.unionByName(some)
    return spark.createDataFrame([], schema) if out is None else out


ORACLE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
d AS (SELECT r, doc_id, t, len(t) AS n FROM t WHERE len(t) > 0),
s AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM d),
i AS (SELECT row_number() OVER () AS i, item_id, unnest(regexp_extract_all(
             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
q AS (SELECT i, item_id, term, count(*) AS times FROM i GROUP BY ALL),
f AS (SELECT r, doc_id, n, term, count(*) AS tf
      FROM (SELECT r, doc_id, n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM f, s GROUP BY term),
x AS (SELECT r, doc_id, f.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nt))) AS x
      FROM f JOIN w ON f.term = w.term, s),
z AS (SELECT i, item_id, r, doc_id, sum(times * x)::BIGINT AS score FROM q JOIN x ON q.term = x.term GROUP BY ALL)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id, r))::INT AS rank FROM z WHERE score > 0)
WHERE rank <= 20
"""
