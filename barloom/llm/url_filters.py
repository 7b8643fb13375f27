"""URL filters: allow and block rules by host and path, carried over to the aliases of a url.

Urls that redirect to each other, or name each other as canonical, are one class: a connected component over those edges, found by rounds of
joins. Where no rule fits a url itself, the decisions that rules made on other members of its class hold for it, so that a
blocked page does not come back under another name. An explicit allow goes before any block that is only passed on.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, split_hot_join
from .near_dedup import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules that are broadcast, of some 100 bytes each; more are joined by key.
BROADCAST_RULES = 100_000

_TAG = re.compile(r"[A-Za-z][A-Za-z0-9]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Elements whose content is text, not markup.
_RAW = {n: re.compile(f"</{n}", re.IGNORECASE) for n in ("script", "style", "textarea", "title", "xmp", "noscript", "iframe")}
_REFRESH = re.compile(r"""\s*[\d.]*\s*[;,]?\s*(?:url\s*=\s*)?["']?([^"'\s]+)""", re.IGNORECASE)


def host_of(url: Column) -> Column:
    """After the first ://, up to /, ? or #; A-Z lower-cased. Empty without a ://."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host, up to ? or #."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def node_of(url: Column) -> Column:
    """What urls of one resource share: scheme and host in lower case, the rest up to #. Null where there is no ://."""
    at = F.instr(url, "://")
    whole = F.regexp_extract(_rest(url), "^[^/?#]*([^#]*)", 1)
    return F.when(at > 0, F.concat(F.translate(F.substring(url, F.lit(1), at + 2), UPPER, LOWER), host_of(url), whole))


def _key(node: Column) -> Column:
    return F.substring(F.sha2(node, 256), 1, 32)


def links_of(url: str | None, page: str | None) -> list[str]:
    """The absolute urls that a page names as canonical or refreshes to. Comments and scripts name nothing; time is linear in the page."""
    if not url or "://" not in url or not page:
        return []
    found, base, at = [], url, 0
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            if end < 0:
                break
            at = end + 3
            continue
        tag = _TAG.match(page, at + 1)
        at += 1
        if not tag:
            continue
        name, at = tag[0].lower(), tag.end()
        if name in _RAW:
            close = _RAW[name].search(page, at)
            if not close:
                break
            at = close.end()
        elif name in ("link", "meta", "base"):
            own: dict[str, str] = {}
            while m := _ATTRIBUTE.match(page, at):
                own.setdefault(m[1].lower(), entities.unescape(next((v for v in m.groups()[1:] if v is not None), "")))
                at = m.end()
            if name == "link" and "canonical" in own.get("rel", "").lower().split():
                found.append(own.get("href", ""))
            elif name == "meta" and own.get("http-equiv", "").strip().lower() == "refresh" and (m := _REFRESH.match(own.get("content", ""))):
                found.append(m[1] if not re.fullmatch(r"[\d.]+[;,]?", m[1]) else "")
            elif name == "base" and base is url and own.get("href"):
                base = _joined(url, own["href"]) or url
    return [full for link in found if link.strip() and (full := _joined(base, link))]


def _joined(base: str, link: str) -> str | None:
    try:
        full = urljoin(base, link.strip())
    except ValueError:  # a broken address
        return None
    return full if "://" in full else None


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = [(u.as_py(), to) for u, h in zip(batch.column(0), batch.column(1)) for to in links_of(u.as_py(), h.as_py())]
        yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.string()) for k in (0, 1)], ["from_url", "to_url"])


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(from_url, to_url): canonical links and refreshes that pages state. Only pages that name either are parsed."""
    named = pages.where(F.col(html_col).rlike("(?i)canonical|refresh") & F.col(url_col).isNotNull())
    return named.select(F.col(url_col).alias("u"), F.col(html_col).alias("h")).mapInArrow(_links, "from_url string, to_url string")


def _prepared(rules: DataFrame) -> DataFrame:
    """(rule, host, path, allow), each rule once; if it both allows and blocks, it allows. Rules with nulls, no host, or a path that no url can have, are dropped."""
    host = F.translate("host", UPPER, LOWER)
    usable = (F.col("host") != "") & F.col("action").isin("allow", "block") & (F.col("path").startswith("/") | (F.col("path") == ""))
    one = rules.where(usable).groupBy(F.concat(host, "path").alias("rule"))
    return one.agg(F.max(host).alias("host"), F.max("path").alias("path"), F.max(F.col("action") == "allow").alias("allow"))


def match_rules(nodes: DataFrame, rules: DataFrame, scratch: Scratch, broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """(key, rule, allow) of the nodes (key, host, path) that a rule fits: the longest one, of equally long ones one that allows.

    A node meets the rules of its host's suffixes only, and of those the ones whose path has the length of a prefix, by equality. Rules past broadcast_rules are
    joined by key, hot suffixes and hot rules apart.
    """
    rules = scratch.write(_prepared(rules), "rules")
    n_rules, labels = rules.agg(F.count("*"), F.max(F.size(F.split("host", "\\.")))).first()
    if not n_rules:
        return nodes.select("key", F.lit("").alias("rule"), F.lit(True).alias("allow")).limit(0)
    hosts = scratch.write(rules.groupBy(F.col("host").alias("suffix")).agg(F.collect_set(F.length("path")).alias("lengths")), "hosts")

    def joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
        if n_rules <= broadcast_rules:
            return left.join(F.broadcast(right), key)
        left = scratch.write(left, "left")
        met = scratch.write(right.join(left.groupBy(key).agg(F.count("*").alias("copies")), key), "met")
        return split_hot_join(left, met, key, "copies", left.count()).drop("copies")

    # Only as many labels as a rule's host has, so that a host of any length has few suffixes.
    parts = F.split("host", "\\.")
    count = F.least(F.size(parts), F.lit(labels))
    suffixes = F.transform(F.sequence(F.lit(1), count), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    at = nodes.select("key", "path", F.explode(suffixes).alias("suffix"))
    at = joined(at, hosts, "suffix").withColumn("length", F.explode("lengths")).where(F.col("length") <= F.length("path"))
    at = at.select("key", F.concat("suffix", F.substring(F.col("path"), F.lit(1), F.col("length"))).alias("rule"))
    fits = joined(at, rules.select("rule", F.length("rule").alias("length"), "allow"), "rule")
    best = F.max(F.struct("length", "allow", "rule"))
    return fits.groupBy("key").agg(best.alias("best")).select("key", "best.rule", "best.allow")


def judge_urls(
    pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", broadcast_rules: int = BROADCAST_RULES
) -> DataFrame:
    """id, host, path, rule, verdict (allow or block) and via (rule, alias or default) of every row of pages.

    rules: (host, path, action). A rule fits its host and all subdomains where the path starts with its path, code point by code point; the longest wins.
    redirects: (from_url, to_url), further edges beside those that the pages state; either end may be no page. A url that no rule fits is allowed if
    a rule allows a member of its class, else blocked if a rule blocks one, else allowed.

    A null url, or one without ://, has an empty host and path, no rule and no class, and is allowed. Urls that differ in the fragment,
    or in the case of scheme or host, are one. Null html states no links; broken html is read as far as it goes. Repeated rows are
    repeated, ties do not matter, an empty table gives an empty one, further columns are not read.

    Hot hosts, urls and classes: rules are broadcast or joined apart by key, urls count once, and the classes' decisions go back to their members in split joins.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("_id"), F.when(url.contains("://"), url).alias("_url"))
    edges = redirects.select("from_url", "to_url") if redirects is not None else None
    if html_col is not None:
        stated = page_links(pages, url_col, html_col)
        edges = stated if edges is None else edges.unionByName(stated)
    linked = decided = None
    if edges is not None:
        pairs = edges.select(node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")).where("a <> b")
        pairs = scratch.write(pairs.distinct(), "pairs")
        linked = None if pairs.isEmpty() else pairs.select(F.col("a").alias("node")).union(pairs.select("b"))

    seen = rows.where("_url is not null").select(node_of(F.col("_url")).alias("node"), F.lit(1).alias("n"))
    if linked is not None:
        seen = seen.unionByName(linked.select("node", F.lit(0).alias("n")))
    nodes = seen.groupBy("node").agg(F.sum("n").alias("copies"))
    nodes = scratch.write(nodes.select(_key(F.col("node")).alias("key"), host_of(F.col("node")).alias("host"), path_of(F.col("node")).alias("path"), "copies"), "nodes")
    ruled = scratch.write(match_rules(nodes, rules, scratch, broadcast_rules), "ruled")
    known = nodes.join(ruled, "key", "left")
    if linked is not None:
        labels = components(pairs.select(_key(F.col("a")).alias("a"), _key(F.col("b")).alias("b")), scratch)
        members = labels.select(F.col("_id").alias("key"), "label")
        classes = members.join(ruled, "key", "left").groupBy("label").agg(F.max("allow").alias("passed"), F.count("*").alias("size"))
        classes = scratch.write(classes.where("passed is not null"), "classes")
        decided = split_hot_join(members, classes, "label", "size", members.count()).select("key", "passed")
        known = known.join(decided, "key", "left")
    else:
        known = known.withColumn("passed", F.lit(None).cast("boolean"))
    known = scratch.write(known.select("key", "copies", "rule", F.coalesce("allow", "passed", F.lit(True)).alias("allow"), F.when(F.col("allow").isNotNull(), "rule").when(F.col("passed").isNotNull(), "alias").otherwise("default").alias("via")), "known")

    keyed = rows.withColumn("key", _key(node_of(F.col("_url"))))
    out = split_hot_join(keyed, known, "key", "copies", pages.count()).select("_id", "_url", "rule", "allow", "via")
    nothing = {"rule": F.lit(None).cast("string"), "allow": F.lit(True), "via": F.lit("default")}
    alone = rows.where("_url is null").withColumns(nothing)
    out = out.unionByName(alone)
    verdict = F.when(F.col("allow"), "allow").otherwise("block")
    return out.select(F.col("_id").alias(id_col), host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"), "rule", verdict.alias("verdict"), "via")
