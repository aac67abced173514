"""URL filter: explicit rules, and for the other urls a verdict per host from
trust and distrust propagated over the link graph.

Hosts are the nodes; every link of a page is an edge from its host to the
host it leads to (relative links stay on the host).  Trust starts at hosts
whose pages the rules allow and follows the links (personalised PageRank);
distrust starts at hosts whose pages the rules block and follows the links
backwards, since who links to bad hosts is suspect, not who is linked by them.
A third rank starts at all hosts alike (by pages) and serves as the measure:
a host is blocked when its distrust exceeds its trust and is at least
``threshold`` times what its share of the web explains.

Ranks are computed by power iteration over the host edge table in Spark; the
table has one row per linked pair of hosts, not per link.  The iteration ends
when the ranks have settled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.common import lower_ascii, sized, written

DAMPING, THRESHOLD = 0.85, 2.0
#: a kind of rank is settled when the changes of a round add up to less; the
#: damping alone gets there in 128 rounds
TOLERANCE, MAX_ROUNDS = 1e-9, 200
ROWS_PER_FILE = 1_000_000

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` up to ``/ ? #``, A-Z lower-cased; path from
    there up to ``? #``.  Null, or no ``://``: both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return lower_ascii(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule (as host + path) and its verdict, else null.  A
    rule fits its host and all subdomains, if the path starts with the rule's.
    Rules are tried longest first, a more specific host before a longer path
    of a wider one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r)):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def link_edges(pages: DataFrame) -> DataFrame:
    """``pages(host, html)`` to ``src, dst, w``: links per pair of hosts.  Links
    are href values; ``scheme://`` and ``//`` ones name a host, ``mailto:`` and
    the like none, all others stay on the page's host.  Counted before the
    shuffle, so a host with very many pages is no large group."""
    refs = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)"), F.lit(1))
    links = pages.where("host <> ''").select("host", F.explode(refs).alias("ref"))
    ref = F.col("ref")
    named = F.when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), host_and_path(ref)[0]
                   ).when(F.startswith(ref, F.lit("//")), host_and_path(F.concat(F.lit("x:"), ref))[0]
                          ).when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit("")).otherwise(F.col("host"))
    return (links.select(F.col("host").alias("src"), named.alias("dst")).where("dst <> ''")
            .groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w")))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE,
             max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Several personalised PageRanks at once, told apart by ``kind``:
    ``nodes(kind, host, seed)`` with non-negative seeds (scaled here to add up
    to 1 per kind; all 0 gives ranks of 0), ``edges(kind, src, dst, w)``.  A
    node without links hands its rank back to the seeds.  Rounds go on until no
    kind's changes add up to ``tolerance``; ``max_rounds`` without that is an
    error.  Returns kind, host, rank.  Each round is written, so a round's plan reads two tables however
    many went before; a node linked by very many is summed before the shuffle.
    Kinds are few by construction, so sums per kind are broadcast."""
    # few rows stay in few files and tasks, however many partitions shuffles have
    parts = 1 + (edges.count() + nodes.count()) // ROWS_PER_FILE
    out = edges.groupBy("kind", "src").agg(F.sum("w").alias("total"))
    shares = written(edges.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("w") / F.col("total"))
                                                             .alias("share")).coalesce(parts), "shares")
    sums = nodes.groupBy("kind").agg(F.sum("seed").alias("sum"))
    has = out.select("kind", F.col("src").alias("host"), F.lit(True).alias("links"))
    start = (nodes.join(F.broadcast(sums), "kind").join(has, ["kind", "host"], "left")
             .select("kind", "host", F.when(F.col("sum") > 0, F.col("seed") / F.col("sum")).otherwise(0.0).alias("seed"),
                     F.coalesce("links", F.lit(False)).alias("links")))
    ranks = written(start.withColumn("rank", F.col("seed")).coalesce(parts), "ranks")
    for _ in range(max_rounds):
        flow = (ranks.select("kind", F.col("host").alias("src"), "rank").join(shares, ["kind", "src"])
                .groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow")))
        stuck = ranks.groupBy("kind").agg(F.sum(F.when(~F.col("links"), F.col("rank")).otherwise(0.0)).alias("stuck"))
        new = F.lit(damping) * F.coalesce("flow", F.lit(0.0)) + F.col("seed") * (1 - damping + damping * F.col("stuck"))
        ranks = written(ranks.join(F.broadcast(stuck), "kind").join(flow, ["kind", "host"], "left").select(
            "kind", "host", "seed", "links", new.alias("rank"), F.abs(new - F.col("rank")).alias("change"))
                        .coalesce(parts), "ranks")
        if ranks.groupBy("kind").agg(F.sum("change").alias("change")).where(F.col("change") >= tolerance).isEmpty():
            break
    else:
        raise RuntimeError(f"ranks did not settle within {max_rounds} rounds")
    return ranks.select("kind", "host", "rank")


def host_verdicts(judged: DataFrame, edges: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE,
                  threshold: float = THRESHOLD) -> DataFrame:
    """``judged(host, verdict)`` (the rules', per page) and link edges to one
    row per host: trust, distrust, base and host_verdict."""
    def kinds(*pairs):
        return F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), *cols) for k, cols in pairs))).alias("x")

    seen = judged.where("host <> ''").groupBy("host").agg(
        F.count(F.lit(1)).cast("double").alias("pages"),
        F.sum(F.when(F.col("verdict") == "allow", 1.0).otherwise(0.0)).alias("good"),
        F.sum(F.when(F.col("verdict") == "block", 1.0).otherwise(0.0)).alias("bad"))
    linked = edges.select(F.col("dst").alias("host")).distinct()
    nodes = seen.join(linked, "host", "full").fillna(0.0).select("host", kinds(
        *((k, [F.col(c).alias("seed")]) for k, c in (("trust", "good"), ("distrust", "bad"), ("base", "pages")))))
    nodes = written(nodes.select("x.kind", "host", "x.seed"), "nodes")
    there = [F.col("src").alias("src"), F.col("dst").alias("dst")]
    back = [F.col("dst").alias("src"), F.col("src").alias("dst")]
    tagged = edges.select("w", kinds(("trust", there), ("distrust", back), ("base", there))).select("x.*", "w")
    ranks = pagerank(nodes, tagged, damping, tolerance)
    ranked = ranks.groupBy("host").agg(*(F.max(F.when(F.col("kind") == k, F.col("rank"))).alias(k)
                                         for k in ("trust", "distrust", "base")))
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= threshold * F.col("base"))
    return ranked.withColumn("host_verdict", F.when(bad, "block").otherwise("allow"))


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, tolerance: float = TOLERANCE,
          threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust, base per row of
    ``pages(page_id, url, html)``.

    Null urls and urls without ``://`` have an empty host and path, fit no rule
    and are allowed; null html has no links; repeated rows count and are judged
    each; an empty table gives an empty result.  Other columns are ignored.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"),
                        F.col("html").cast("string").alias("html"))
    edges = written(link_edges(base), "link_edges")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))
    hosts = host_verdicts(judged.select("host", "verdict"), edges, damping, tolerance, threshold)
    return (judged.join(sized(written(hosts, "host_verdicts")), "host", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("verdict", "host_verdict", F.lit("allow")).alias("verdict"), "trust", "distrust", "base"))
