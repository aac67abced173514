import re
from collections import defaultdict

import pytest

from caseflow.llm import url_trust as U
from caseflow.llm.queries import QUERIES
from tests.conftest import SF_SMALL


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def plain_rank(seeds, edges, damping=U.DAMPING, rounds=400):
    out = defaultdict(float)
    for (a, _), w in edges.items():
        out[a] += w
    rank = dict(seeds)
    for _ in range(rounds):
        new = {h: 0.0 for h in seeds}
        for (a, b), w in edges.items():
            new[b] += damping * rank[a] * w / out[a]
        stuck = sum(r for h, r in rank.items() if h not in out)
        rank = {h: new[h] + seeds[h] * (1 - damping + damping * stuck) for h in seeds}
    return rank


PAGES = [(1, "http://www.example.com/en/a", '<a href="http://other.org/x">o</a><a href="/y">'),
         (2, "http://example.com/en/a?q", '<a class="z" href=\'http://bad.org/\'>'),
         (3, "https://Bad.ORG/en/", '<a href="//x.example.com/en/">b</a><a href="//x.example.com/en/2">b</a>'),
         (4, "http://x.example.com/en/", '<a href="mailto:a@b.c">m</a><a href="http://bad.org">'),
         (5, "http://other.org", None), (6, None, "<a href='/x'>"), (7, "no url", ""), (8, "http://a.net/es/x", "<p>"),
         (9, "ftp://B.com", "<a href=http://lonely.org/>"), (None, "http://other.org/z#f", "")]


def test_verdicts_equal_brute_force(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, rank string")
    edges, pages, good, bad = defaultdict(float), defaultdict(float), defaultdict(float), defaultdict(float)
    for _, url, html in PAGES:
        host, path = plain_parts(url)
        if not host:
            continue
        v = plain_rule(host, path)[1]
        pages[host] += 1
        good[host] += v == "allow"
        bad[host] += v == "block"
        for ref in re.findall(r"<a\s[^>]*?href\s*=\s*[\"']?([^\"'\s>]+)", html or ""):
            to = plain_parts(ref)[0] if "://" in ref else plain_parts("x:" + ref)[0] if ref.startswith("//") else \
                None if re.match(r"[A-Za-z][\w+.-]*:", ref) else host
            if to:
                edges[host, to] += 1
    hosts = set(pages) | {b for _, b in edges}
    norm = lambda x: {h: x[h] / (sum(x.values()) or 1) for h in hosts}
    trust, base = plain_rank(norm(good), edges), plain_rank(norm(pages), edges)
    distrust = plain_rank(norm(bad), {(b, a): w for (a, b), w in edges.items()})
    got = U.judge(df).collect()
    assert len(got) == len(PAGES)
    url_of = {p[0]: p[1] for p in PAGES}
    for r in got:
        host, path = plain_parts(url_of[r.page_id])
        rule, v = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if not host:
            assert r.verdict == "allow" and r.trust is None
            continue
        assert abs(r.trust - trust[host]) < 1e-7 and abs(r.distrust - distrust[host]) < 1e-7
        assert r.verdict == (v or ("block" if distrust[host] > trust[host] and distrust[host] >= 2 * base[host] - 1e-12
                                   else "allow"))
    assert U.judge(df.limit(0)).count() == 0


def test_distrust_runs_down_a_long_chain(spark):
    """Of hosts in a row before a blocked one, the nearer is never better."""
    hosts = [f"h{i}.org" for i in range(20)] + ["bad.net"]
    rows = [(i, f"http://{h}/{'es/' if h == 'bad.net' else ''}", f'<a href="http://{n}/es/">' if n else "")
            for i, (h, n) in enumerate(zip(hosts, [*hosts[1:], None], strict=True))]
    got = {r.page_id: r for r in U.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    verdicts = [got[i].verdict for i in range(20)]
    assert verdicts == sorted(verdicts) and verdicts[-1] == "block"
    back = plain_rank({h: float(h == "bad.net") for h in hosts}, {(b, a): 1.0 for a, b in zip(hosts, hosts[1:], strict=False)})
    assert all(abs(got[i].distrust - back[h]) < 1e-7 for i, h in enumerate(hosts))


def test_a_graph_that_does_not_settle_is_an_error(spark):
    nodes = spark.createDataFrame([("t", "a", 1.0), ("t", "b", 0.0)], "kind string, host string, seed double")
    edges = spark.createDataFrame([("t", "a", "b", 1.0), ("t", "b", "a", 1.0)], "kind string, src string, dst string, w double")
    with pytest.raises(RuntimeError):
        U.pagerank(nodes, edges, max_rounds=3)


def test_rules_on_all_pages(spark):
    url = {r.page_id: r.url for r in spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()}
    got = QUERIES["op5_link_trust"](spark, SF_SMALL).collect()
    assert sorted(r.page_id for r in got) == sorted(url)
    for r in got:
        host, path = plain_parts(url[r.page_id])
        rule, v = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and (v is None or r.verdict == v)
