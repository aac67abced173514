"""Benchmark decontamination: size-partitioned MinHash containment search, in
DataFrame operations only.

An item is contained in a document when at least ``threshold`` of the item's
distinct 5-word shingles occur in it.  Containment is asymmetric, and a
document's size says nothing about it, so one signature length for all items
does not work.  Items are partitioned by set size into classes
[1, 2), [2, 4), [4, 8), ...; an item of ``q`` shingles in a class with lower
edge ``e`` gets the MinHash sketch of its ``q - ceil(t q) + r`` smallest
shingles, with ``r = max(1, e / 8)``.  A document that contains the item has
at least ``r`` of them: at most ``q - ceil(t q)`` of the item's shingles are
missing.  The search therefore loses nothing.  The order under which the
smallest are taken is (number of items with the shingle, hash), so that text
shared by many items does not fill the sketches.

Documents stream past the sketch table; those with enough sketch hits are
candidates, and only their shingles are compared with the full item sets.
Words are maximal runs outside blank and 0x09-0x0D, lower-cased.  An item of
fewer than 5 words is its whole word sequence, looked for as such; an item
without words is contained in nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caseflow.llm.common import sized, words, written

K, THRESHOLD = 5, 0.8


def _grams(w: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` words."""
    n = F.size(w) - (length - 1)
    return F.when(n >= 1, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(w, i, length))))


def _items(benchmark: DataFrame, k: int, threshold: float) -> DataFrame:
    """item_id, item_key, g, q, need (shingles that must match), in_sketch, r."""
    w = F.col("w")
    items = (benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                              words(F.lower(F.col("text").cast("string"))).alias("w"))
             .where(F.size(w) > 0)
             .select("item_id", F.size(w).alias("nw"), F.xxhash64(w).alias("item_key"),
                     F.array_distinct(F.when(F.size(w) < k, F.array(F.xxhash64(w))).otherwise(_grams(w, k))).alias("s"))
             .dropDuplicates(["item_id", "item_key"]))
    q = F.col("q")
    grams = items.select("item_id", "item_key", "nw", F.size("s").alias("q"), F.explode("s").alias("g"))
    common = grams.groupBy("g").agg(F.count(F.lit(1)).alias("items"))
    # one benchmark item's shingles are a group as long as its own text
    place = F.row_number().over(W.partitionBy("item_id", "item_key").orderBy("items", "g"))
    need = F.ceil(F.lit(threshold) * q - 1e-9).cast("int")
    r = F.greatest(F.lit(1), F.floor(F.pow(F.lit(2.0), F.floor(F.log2(q.cast("double")))) / 8)).cast("int")
    return (grams.join(common, "g").withColumn("place", place).withColumn("need", need)
            .withColumn("r", F.least(r, F.col("need")))
            .withColumn("in_sketch", F.col("place") <= q - F.col("need") + F.col("r"))
            .select("item_id", "item_key", "nw", "q", "need", "r", "g", "in_sketch"))


def contaminated(docs: DataFrame, benchmark: DataFrame, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (document, item): doc_id, item_id, n_item, n_common, containment.

    One row per distinct pair of (doc_id, text) and (item_id, text).  Null and
    empty documents or items match nothing; a null doc_id or item_id is
    reported as null; repeated rows are reported once; an empty table on
    either side gives no rows.  Other columns are ignored.
    """
    return _pairs(docs, benchmark, k, threshold).select(
        "doc_id", "item_id", F.col("q").alias("n_item"), F.col("n_common"), (F.col("n_common") / F.col("q"))
        .alias("containment"))


def _pairs(docs: DataFrame, benchmark: DataFrame, k: int, threshold: float) -> DataFrame:
    items = written(_items(benchmark, k, threshold), "items")
    # the gram lengths in use: k, and those of items shorter than k words
    lengths = sorted({k} | {r.nw for r in items.where(F.col("nw") < k).select("nw").distinct().collect()})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))

    def shingles(d: DataFrame) -> DataFrame:
        d = d.select("doc_id", "key", words(F.lower("text")).alias("w"))
        parts = [F.coalesce(_grams(F.col("w"), n), F.array().cast("array<bigint>")) for n in lengths]
        return d.select("doc_id", "key", F.explode(F.concat(*parts)).alias("g"))

    sketch = items.where("in_sketch").select("g", "item_id", "item_key", "r")
    hits = (shingles(base).join(sized(sketch, 1_000_000), "g")
            .groupBy("doc_id", "key", "item_id", "item_key", "r").agg(F.count_distinct("g").alias("hits"))
            .where("hits >= r").drop("hits", "r"))
    hits = written(hits, "candidates")
    wanted = hits.select("doc_id", "key").distinct().select(F.col("doc_id").alias("d"), F.col("key").alias("x"))
    again = base.join(sized(wanted, 1_000_000), F.col("key").eqNullSafe(F.col("x"))
                      & F.col("doc_id").eqNullSafe(F.col("d")), "left_semi")
    full = sized(items.select("g", F.col("item_id").alias("i"), F.col("item_key").alias("j"), "q", "need"), 1_000_000)
    found = (shingles(again).join(full, "g").groupBy("doc_id", "key", "i", "j", "q", "need")
             .agg(F.count_distinct("g").alias("n_common")).where("n_common >= need"))
    return (found.join(hits, found["doc_id"].eqNullSafe(hits["doc_id"]) & (found["key"] == hits["key"])
                       & found["i"].eqNullSafe(hits["item_id"]) & (found["j"] == hits["item_key"]), "left_semi")
            .select("doc_id", "key", F.col("i").alias("item_id"), "q", "n_common"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = K, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all columns,
    whatever their names.  Null and empty texts contain nothing and stay; a null
    doc_id counts as one; repeated rows stay or go together; long texts are
    searched whole; an empty benchmark leaves all rows."""
    bad = written(_pairs(docs.select("doc_id", "text"), benchmark, k, threshold)
                  .select(F.col("doc_id").alias("_d"), F.col("key").alias("_x")).distinct(), "contaminated")
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)),
                       F.col("doc_id").cast("long").alias("_id"),
                       F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_key"))
    left = rows.join(sized(bad, 1_000_000), (F.col("_key") == F.col("_x")) & F.col("_id").eqNullSafe(F.col("_d")), "left_anti")
    return left.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))


ORACLE_SQL = """
WITH dw AS (SELECT DISTINCT doc_id, md5(coalesce(text, '')) AS k,
                   regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
iw AS (SELECT DISTINCT item_id, md5(coalesce(text, '')) AS k,
              regexp_extract_all(lower(coalesce(text, '')), '[^\\x20\\x09-\\x0D]+') AS w FROM benchmark),
ig AS (SELECT DISTINCT item_id, k, least(len(w), 5) AS n, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM iw WHERE len(w) > 0)),
iq AS (SELECT *, count(*) OVER (PARTITION BY item_id, k) AS q FROM ig),
dg AS (SELECT DISTINCT doc_id, k, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, k, w, n, unnest(range(1, len(w) - n + 2)) AS i
             FROM dw, (SELECT DISTINCT n FROM ig) WHERE len(w) >= n)),
c AS (SELECT doc_id, dg.k, item_id, iq.k AS j, q, count(*) AS n_common
      FROM dg JOIN iq ON dg.n = iq.n AND dg.g = iq.g GROUP BY ALL)
SELECT doc_id, item_id, q::INT AS n_item, n_common, n_common / q AS containment
FROM c WHERE n_common >= ceil(0.8 * q - 1e-9)
"""
