"""Rules, links and classes of urls against plain versions."""

from __future__ import annotations

import random
import re

import pytest

from barloom.llm.queries import URL_RULES
from barloom.llm.url_filters import judge_urls, links_of

PAGES = "page_id long, url string, html string, host string, key string, `_url` string"
RULES = "host string, path string, action string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], PAGES)


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def own_rule(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), action == "allow", h + p) for h, p, action in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, default=None)


def node(url):
    scheme, rest = url.split("://", 1)
    host = re.match(r"[^/?#]*", rest)[0]
    return scheme.lower() + "://" + parts(url)[0] + rest[len(host) :].split("#")[0]


def brute(rows, rules, redirects=()):
    edges = [(u, t) for _, u, h in rows for t in links_of(u, h)] + [(a, b) for a, b in redirects if a and b and "://" in a and "://" in b]
    near = {}
    for a, b in edges:
        near.setdefault(node(a), set()).add(node(b))
        near.setdefault(node(b), set()).add(node(a))
    out = []
    for i, u, _ in rows:
        own = own_rule(u, rules)
        verdict, via = ("allow" if own[1] else "block", "rule") if own else ("allow", "default")
        if not own and u is not None and "://" in u:
            seen, todo = {node(u)}, [node(u)]
            while todo:
                for n in near.get(todo.pop(), ()):
                    if n not in seen:
                        seen.add(n)
                        todo.append(n)
            others = [r for n in seen if (r := own_rule(n, rules))]
            if others:
                verdict, via = "allow" if any(r[1] for r in others) else "block", "alias"
        out.append((i, *parts(u), own and own[2], verdict, via))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("page_id", "host", "path", "rule", "verdict", "via").collect()), key=str)


def canonical(url):
    return f'<html><head><link rel="canonical" href="{url}"></head><body>x</body></html>'


ROWS = [
    (1, "http://a.example.net/en/1", None),
    (2, "http://a.example.net/de/1", ""),
    (3, "https://WWW.Example.COM/de/1?x=http://b.net/", "<p>"),
    (4, "http://example.com/DE/1", None),
    (5, "http://x.org/fr/2#top", None),
    (6, "http://notexample.net", None),
    (7, "http://net/", None),
    (8, "http://xnet/", None),
    (9, None, canonical("http://b.net/")),
    (10, "", None),
    (11, "no scheme/net/", None),
    (12, "http:///net/", None),
    (13, "http://a.io/1", canonical("http://b.net/1")),
    (14, "http://a.io/1#part", None),
    (15, "HTTP://A.io/1?q", '<META HTTP-EQUIV=Refresh CONTENT="0; URL=/1">'),
    (16, "http://c.io/", '<base href="http://d.io/x/"><link href=y rel="nofollow Canonical">'),
    (17, "http://d.io/x/y", None),
    (18, "http://e.io/", '<!-- <link rel=canonical href="http://b.net/1"> --><script>"<link rel=canonical href=http://b.net/1>"</script>'),
    (19, "http://f.io/", canonical("http://b.net/1").replace("link", "link data-x='>'")),
    (20, "http://g.io/", canonical("http://h.example.net/en/")),
    (21, "http://g.io/", canonical("http://b.net/2")),
    (22, "http://i.io/é/" + "long/" * 3000, canonical("http://[broken")),
    (None, "http://b.net/1", None),
    (23, ".".join("abc" * 2000) + "://" + "a." * 3000 + "net/x", None),
    (24, "a://b.net\n/x\ny?z", None),
    (25, "ftp://b.net://c.org/fr/", None),
] + [(26, "http://hot.io/", None)] * 3
REDIRECTS = [("http://hot.io/", "http://d.io/x/y"), ("http://d.io/x/y", "http://k.example.com/de/"), (None, "http://b.net/1"), ("no scheme", "http://b.net/1")]


@pytest.mark.parametrize("broadcast_rules", [100_000, 0])
def test_urls_like_brute_force(spark, broadcast_rules):
    redirects = spark.createDataFrame(REDIRECTS, "from_url string, to_url string")
    found = judge_urls(frame(spark, ROWS).repartition(3), spark.createDataFrame(URL_RULES, RULES), redirects, broadcast_rules=broadcast_rules)
    want = brute(ROWS, URL_RULES, REDIRECTS)
    assert result(found) == want
    verdicts = {r[0]: r[4:] for r in want}
    assert verdicts[13] == verdicts[14] == verdicts[15] == ("block", "alias")  # a canonical link, a fragment, a refresh
    assert verdicts[16] == verdicts[26] == ("block", "alias")  # by a redirect two steps on
    assert verdicts[18] == ("allow", "default") and verdicts[19] == ("block", "alias")
    assert verdicts[20] == verdicts[21] == ("allow", "alias")  # an allow goes before a block


def test_longest_rule_and_ties(spark):
    rules = [("b.net", "/", "block"), ("net", "/en/x", "block"), ("net", "/en/x", "allow"), ("a.b.net", "", "block"), ("NET", "/q", "allow"), (None, "/", "block"), ("net", None, "block"), ("net", "en", "block"), ("net", "/z", "other"), ("", "/", "block")]
    usable = [(h.lower(), p, a) for h, p, a in rules if h and p is not None and (p == "" or p.startswith("/")) and a != "other"]
    rows = [(i, f"http://{h}{p}", None) for i, (h, p) in enumerate((h, p) for h in ("net", "b.net", "a.b.net", "c.a.b.net", "z") for p in ("", "/", "/en/", "/en/x", "/q", "/z"))]
    for n in (100_000, 0):
        assert result(judge_urls(frame(spark, rows), spark.createDataFrame(rules, RULES), broadcast_rules=n)) == brute(rows, usable)
    none = spark.createDataFrame([], RULES)
    assert result(judge_urls(frame(spark, ROWS), none)) == brute(ROWS, [])
    assert judge_urls(frame(spark, []), spark.createDataFrame(rules, RULES)).count() == 0
    assert result(judge_urls(frame(spark, rows), spark.createDataFrame(rules, RULES), html_col=None)) == brute(rows, usable)


@pytest.mark.parametrize("broadcast_rules", [100_000, 0])
def test_chains_and_hot_classes(spark, broadcast_rules):
    """A chain of 300 redirects, a star of 2,000 aliases around a blocked url, random links, one url in 1,000 rows."""
    r = random.Random(3)
    chain = [(f"http://c{i}.io/", f"http://c{i + 1}.io/") for i in range(300)] + [("http://c300.io/", "http://end.net/")]
    star = [(f"http://s{i}.io/", "http://hub.net/x") for i in range(2000)]
    loose = [(f"http://r{r.randrange(200)}.io/", f"http://r{r.randrange(200)}.{r.choice(['io', 'io', 'io', 'net'])}/") for _ in range(120)]
    redirects = chain + star + loose
    urls = ["http://c0.io/", "http://c150.io/#x", "http://c300.io/"] + [a for a, _ in star] + [f"http://r{k}.io/" for k in range(200)] + ["http://s0.io/"] * 1000
    rows = [(i, u, None) for i, u in enumerate(urls)]
    found = judge_urls(frame(spark, rows), spark.createDataFrame(URL_RULES, RULES), spark.createDataFrame(redirects, "from_url string, to_url string"), broadcast_rules=broadcast_rules)
    reach = {}

    def root(x):
        while reach.get(x, x) != x:
            x = reach[x]
        return x

    for a, b in redirects:
        reach[root(a)] = root(b)
    bad = {root(x) for pair in redirects for x in pair if own_rule(x, URL_RULES)}
    want = {i: "block" if root(u.split("#")[0]) in bad else "allow" for i, u, _ in rows}
    assert {x.page_id: x.verdict for x in found.collect()} == want


def test_links_are_read_in_linear_time():
    for page in ("<!--" * 300_000, "<link a=" * 200_000, "<link a='\"" * 150_000, "<script>" * 200_000, "<" * 1_000_000, "<link " + "a " * 500_000, "<meta http-equiv=refresh content='" + " " * 500_000):
        assert links_of("http://a.io/", page) == []
    assert links_of("http://a.io/", "<link rel=canonical href='b c' >") == ["http://a.io/b c"]
    assert links_of("http://a.io/", '<meta http-equiv="refresh" content="30">') == []
