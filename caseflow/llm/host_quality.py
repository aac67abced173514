"""Quality rules with host-level verdicts, in DataFrame operations only.

Base rules judge each text by itself.  Their failures are aggregated per host,
each host's failure rate is shrunk by a beta prior fitted to all hosts, and a
host whose shrunk rate reaches the limit rejects all its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import WS_CHARS, sized, words, written

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
HOST_LIMIT = 0.5


def _characters(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def text_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long)
    and base_failed.  Null texts count as empty.  Works row by row, without a
    shuffle; one row's arrays are as long as its own text."""
    keep = docs.columns
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, WS_CHARS, "") != "")
    df = docs.select("*", t.alias("_t"), words(t).alias("_w"), lines.alias("_l"))
    n = F.size("_w")
    windows = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)),
                                             lambda i: F.xxhash64(F.slice("_w", i, WINDOW))))
    df = df.select(*keep, n.cast("long").alias("n_words"),
                   (F.length("_t") - _characters(F.col("_t"), WS_CHARS)).cast("long").alias("word_chars"),
                   _characters(F.col("_t"), "#*$%&|<>").cast("long").alias("n_symbols"),
                   (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                   windows.alias("_h"))
    # only texts with a repeated window sort their windows; equal ones become
    # neighbours, and the gaps between their start positions give the cover
    df = df.withColumn("_s", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.sort_array(
        F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    s = F.col("_s")
    df = df.withColumn("_p", F.sort_array(F.transform(
        F.filter(s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])),
        lambda x: x["i"])))
    p = F.col("_p")
    cover = F.aggregate(F.transform(p, lambda x, k: F.coalesce(F.least(F.lit(WINDOW), F.get(p, k + 1) - x),
                                                               F.lit(WINDOW))),
                        F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0).cast("long"))).drop("_h", "_s", "_p")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def host_verdicts(rows: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """``rows(host, base_failed)`` to one row per host: documents, failures,
    shrunk rate and rejected.

    The prior is beta with the overall failure rate ``mu`` as mean; its weight
    ``kappa`` comes from the spread of the host rates beyond what chance
    explains (method of moments), so a host with few documents stays near the
    overall rate.  Rows without a host belong to none.
    """
    hosts = (rows.where("host is not null").groupBy("host")
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failures")))
    hosts = written(hosts, "hosts")
    total = hosts.agg(F.sum("n").alias("N"), F.sum("failures").alias("K"), F.count(F.lit(1)).alias("H"),
                      F.sum(F.col("failures") * F.col("failures") / F.col("n")).alias("Q"))
    mu = F.col("K") / F.col("N")
    between = F.greatest(F.col("Q") / F.col("N") - mu * mu - mu * (1 - mu) * F.col("H") / F.col("N"), F.lit(1e-6))
    prior = total.select(F.lit(1).alias("one"), mu.alias("mu"),
                         F.greatest(mu * (1 - mu) / between - 1, F.lit(1.0)).alias("kappa"))
    rate = (F.col("failures") + F.col("mu") * F.col("kappa")) / (F.col("n") + F.col("kappa"))
    return (hosts.withColumn("one", F.lit(1)).join(F.broadcast(prior), "one")      # the prior is one row
            .select("host", "n", "failures", rate.alias("rate"), (rate >= limit).alias("rejected")))


def judge(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """One row per input row: doc_id, the features, base_failed, host_rate and
    kept (false if the base rules or the host's verdict reject it).

    Null texts are empty and fail; rows without a host are judged by the base
    rules alone; repeated rows are judged, and counted, each; an empty table
    gives an empty result.  Other columns are ignored.
    """
    rows = written(text_features(docs.select("doc_id", "text", F.col(host).cast("string").alias("host"))).drop("text"),
                   "features")
    verdicts = written(host_verdicts(rows.select("host", "base_failed"), limit), "verdicts")
    return (rows.join(sized(verdicts.select("host", F.col("rate").alias("host_rate"), "rejected")), "host", "left")
            .withColumn("kept", ~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).drop("rejected"))


def keep_good(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.  Two passes over
    the texts (statistics, then filter): no text is shuffled."""
    rows = text_features(docs.select("text", F.col(host).cast("string").alias("host"))).select("host", "base_failed")
    bad = written(host_verdicts(rows, limit).where("rejected").select(F.col("host").alias("_bad")), "bad_hosts")
    part = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)),
                       F.col("text").alias("text"), F.col(host).cast("string").alias("_host"))
    # the row number keeps the filter above the features: pushed below, it would
    # repeat their expressions many times over
    good = text_features(part).withColumn("_row", F.monotonically_increasing_id())
    good = good.where(~F.col("base_failed") & (F.col("_row") >= 0))
    good = good.join(sized(bad), F.col("_host") == F.col("_bad"), "left_anti")
    return good.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


ORACLE_SQL = """
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM t),
v AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS h
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM v) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM r) GROUP BY doc_id),
f AS (SELECT w.doc_id, source, len(w)::BIGINT AS n_words,
             length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS k FROM b WHERE source IS NOT NULL GROUP BY source),
m AS (SELECT sum(k) / sum(n) AS mu, sum(k * k / n) / sum(n) AS q, count(*) / sum(n) AS e FROM h),
p AS (SELECT mu, greatest(mu * (1 - mu) / greatest(q - mu * mu - mu * (1 - mu) * e, 1e-6) - 1, 1.0) AS kappa FROM m),
x AS (SELECT source, (k + mu * kappa) / (n + kappa) >= 0.5 AS rejected FROM h, p)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(x.rejected, false) AS kept
FROM b LEFT JOIN x ON b.source = x.source
"""
