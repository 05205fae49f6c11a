"""Url rules, and block decisions that follow redirects and canonical links to aliases."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


#: The rules of the registered query.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def parts(url):
    """(host, path) columns: after the first :// up to / ? # or the end, A-Z lowered; then up to ? or #. Else empty."""
    rest = F.expr("if(instr(url, '://') > 0, substring(url, instr(url, '://') + 3), '')") if url == "url" else url
    rest = F.coalesce(rest, F.lit(""))
    return common.ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


#: An attribute's value in a tag: in double quotes, in single quotes, or bare.
_VALUE = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
_TAGS = r"""(?i)<(?:link|meta)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_BASE = r"""(?i)<base\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
#: Character references by name, with the semicolon that the first four may lack.
_NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos;": "'", "sol;": "/", "colon;": ":", "quest;": "?", "num;": "#", "equals;": "=", "period;": "."}


def attribute(tag, name: str):
    """An attribute's value in a tag, as written; empty if there is none."""
    pattern = r"(?i)[\s\"'/]" + name + _VALUE
    return F.concat(*(F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)))


def decoded(value):
    """An attribute's value with references of printable ASCII characters decoded, once, and outer space gone."""

    def put(done, piece):
        by_hex, by_number, by_name = r"^#[xX]0*([2-7][0-9a-fA-F])(?![0-9a-fA-F]);?", r"^#0*(3[2-9]|[4-9][0-9]|1[01][0-9]|12[0-6])(?![0-9]);?", f"^({'|'.join(_NAMED)});?"
        names = F.create_map(*(F.lit(x) for pair in _NAMED.items() for x in pair))
        code = F.when(piece.rlike(by_hex), F.conv(F.regexp_extract(piece, by_hex, 1), 16, 10)).when(piece.rlike(by_number), F.regexp_extract(piece, by_number, 1))
        rest = F.regexp_replace(piece, f"{by_hex}|{by_number}|{by_name}", "")
        mark = F.coalesce(F.char(code.cast("long")), F.try_element_at(names, F.regexp_extract(piece, by_name, 1)))
        return F.concat(done, F.when(mark.isNotNull(), F.concat(mark, rest)).otherwise(F.concat(F.lit("&"), piece)))

    pieces = F.split(value, "&")
    whole = F.when(value.contains("&"), F.aggregate(F.slice(pieces, 2, F.size(pieces)), F.get(pieces, F.lit(0)), put)).otherwise(value)
    return F.regexp_replace(whole, r"^\s+|\s+$|[\t\r\n]", "")


def without_dots(path):
    """A path without its . and .. segments."""
    inner = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(s == ".", kept).otherwise(F.concat(kept, F.array(s))),
    )
    joined = F.array_join(inner, "/")
    ends = F.when(path.rlike(r"/\.\.?$") & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.when(ends.startswith("/"), ends).otherwise(F.concat(F.lit("/"), ends))).otherwise(path)


def resolved(base, link):
    """The url that a link names on a page whose url is base; null for one that names no place, as mailto: does."""
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    site = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, "^(.*/)", 1))
    return (
        F.when((site == "") | link.isNull(), None)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path, link))
        .when((link == "") | link.startswith("#"), base)
        .otherwise(F.concat(site, folder, link))
    )


def node_of(url):
    """The resource that a url names: host, path and query, without scheme (rules see none either) and fragment. A-Z of the host are
    lowered, a default port is dropped, an empty path is /, and a path has no . and .. segments. Nothing else makes two urls one."""
    rest = F.regexp_replace(F.regexp_replace(url, "^[^:/?#]*://", ""), "#.*$", "")
    host = F.regexp_replace(common.ascii_lower(F.regexp_extract(rest, "^[^/?]*", 0)), ":(80|443)?$", "")
    path, query = F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), F.regexp_extract(rest, r"^[^?]*(\?.*)$", 1)
    return F.concat(host, F.when(path == "", "/").otherwise(without_dots(path)), query)


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) between urls that name one resource: canonical links and refresh redirects in the html, resolved as a browser
    does (by a base tag too), and a table (from_url, to_url) of observed redirects. Nothing else is taken for an alias."""
    p = pages.where(F.col("url").contains("://") & F.col("html").isNotNull())
    tagged = p.select("url", F.regexp_extract("html", _BASE, 0).alias("base"), F.explode(F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0))).alias("tag"))
    tag = F.col("tag")
    tagged = tagged.where(F.lower("tag").rlike("canonical|refresh")).select("url", "tag", attribute(F.col("base"), "href").alias("base"), *(attribute(tag, n).alias(n) for n in ("rel", "href", "http-equiv", "content")))
    # stored step by step: html is gone through once, and the optimizer does not nest one step's expressions in the next
    tagged = common.cut(tagged, "tags")
    read = tagged.select("url", "tag", *(decoded(F.col(f"`{n}`")).alias(n.replace("-", "_")) for n in ("base", "rel", "href", "http-equiv", "content")))
    wait = F.regexp_extract("content", r"""(?i)^[\d.\s]*[;,]?\s*url\s*=\s*["']?([^"']*)""", 1)
    target = (
        F.when(tag.rlike("(?i)^<link") & F.lower("rel").rlike(r"(^|\s)canonical(\s|$)"), F.col("href"))
        .when(tag.rlike("(?i)^<meta") & (F.lower("http_equiv") == "refresh"), F.trim(wait))
        .otherwise(F.lit(""))
    )
    linked = common.cut(read.select("url", "base", target.alias("link")), "links").where("link <> ''")
    linked = linked.select("url", "link", F.when(F.col("base") == "", F.col("url")).otherwise(F.coalesce(resolved(F.col("url"), F.col("base")), "url")).alias("base"))
    linked = common.cut(linked.select("url", "base", "link"), "bases").select("url", resolved(F.col("base"), F.col("link")).alias("to"))
    linked = common.cut(linked, "targets").where("to IS NOT NULL")
    edges = linked.select(node_of(F.col("url")).alias("a"), node_of(F.col("to")).alias("b"))
    if redirects is not None:
        hops = redirects.where(F.col("from_url").contains("://")).select("from_url", resolved(F.col("from_url"), F.col("to_url")).alias("to"))
        hops = common.cut(hops, "targets").where("to IS NOT NULL")
        edges = edges.union(hops.select(node_of(F.col("from_url")), node_of(F.col("to"))))
    return common.cut(edges, "edges").where("a <> b")


def with_rule(frame: DataFrame, rules) -> DataFrame:
    """Adds host, path and the struct won: the longest rule whose host is the host or a parent domain of it and whose
    path starts the path; null if none fits. Of equally long rules an allow wins."""
    host, path = parts("url")
    ordered = sorted(rules, key=lambda r: (-len(r.host) - len(r.path), r.verdict != "allow", r.host, r.path))
    won = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in reversed(ordered):
        fits = ((F.col("host") == rule.host) | F.col("host").endswith("." + rule.host)) & F.col("path").startswith(rule.path)
        won = F.when(fits, F.struct(F.lit(rule.host + rule.path).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(won)
    return frame.select("*", host.alias("host"), path.alias("path")).select("*", won.alias("won"))


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, component) for every row of pages (page_id, url, html).

    A url that a rule fits takes the rule's verdict. Any other is blocked if its component of aliases, joined by
    redirects and canonical links, holds a url that a rule blocks and none that a rule allows; else allowed. Urls that
    are only the target of a link or redirect vote as those of pages do. Of equally long rules that fit, an allow wins.
    Null urls and urls without :// have an empty host and path, no rule and no aliases: allow. Null or empty html has no
    links. Repeated rows are judged each; an empty table gives an empty one; other columns are ignored. Urls and html of
    any length are gone through by expressions of linear time. rules is a short list from the caller (it becomes one
    expression); pages, edges and components stay distributed: components come by star contraction, the votes of a
    component are pre-aggregated, and only pages without a rule are joined, by url.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    judged = with_rule(p.select("page_id", "url"), rules).select("*", F.when(F.col("url").contains("://"), node_of(F.col("url"))).alias("node"))
    components = common.cut(common.connected_components(alias_edges(p, redirects)), "aliases")
    if components.isEmpty():
        return judged.select("page_id", "host", "path", F.col("won.rule").alias("rule"), F.coalesce(F.col("won.verdict"), F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("component"))
    judged = common.cut(judged, "judged")
    voters = judged.where("won is not null and node is not null").select("node", F.col("won.verdict").alias("vote")).distinct().join(components, "node")
    targets = with_rule(components.select("node", "component", F.concat(F.lit("://"), "node").alias("url")), rules).where("won is not null")
    votes = (
        voters.select("component", "vote")
        .union(targets.select("component", F.col("won.verdict").alias("vote")))
        .groupBy("component")
        .agg(F.max((F.col("vote") == "block").cast("int")).alias("blocks"), F.max((F.col("vote") == "allow").cast("int")).alias("allows"))
        .where("blocks = 1 and allows = 0")
        .select("component")
    )
    votes = common.cut(votes, "votes")
    blocked = common.cut(components.join(common.small(votes), "component").select("node", "component", F.lit(True).alias("by_alias")), "blocked")
    # pages with a rule, or without a url, have nothing to look up
    open_ones = judged.where("won is null and node is not null").join(common.small(blocked), "node", "left")
    others = judged.where("won is not null or node is null").select("*", F.lit(None).cast("string").alias("component"), F.lit(None).cast("boolean").alias("by_alias"))
    return open_ones.unionByName(others).select(
        "page_id",
        "host",
        "path",
        F.col("won.rule").alias("rule"),
        F.coalesce(F.col("won.verdict"), F.when(F.col("by_alias"), "block"), F.lit("allow")).alias("verdict"),
        "component",
    )


#: judge() of pages by RULES, in DuckDB's SQL. Components are found by a recursive walk, which only small tables bear; links are cut
#: into scheme, host, path and query and put together again. It knows &amp; alone of character references, no base tags, and no .. in links.
ORACLE_SQL = r"""
WITH RECURSIVE cut AS (
    SELECT page_id, url, html, regexp_extract(url, '^([^:/?#]*)://([^/?#]*)([^?#]*)(\?[^#]*)?', ['scheme', 'host', 'path', 'query']) AS u, contains(url, '://') AS whole FROM pages
), p AS (
    SELECT page_id, url, html, whole, u.scheme AS scheme, u.path AS raw_path,
        CASE WHEN whole THEN translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
        CASE WHEN whole THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
        regexp_replace(translate(u.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(80|443)?$', '') AS node_host,
        CASE WHEN u.path = '' THEN '/' ELSE u.path END AS node_path, u.query AS query
    FROM cut
), q AS (SELECT *, CASE WHEN whole THEN node_host || node_path || query END AS node FROM p),
rules(verdict, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
tags AS (
    SELECT node, scheme, node_host, node_path, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS tag FROM q WHERE whole AND html IS NOT NULL
), links AS (
    SELECT node, scheme, node_host, node_path, replace(trim(CASE
        WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(tag, '(?i)\brel\s*=\s*["'']?(?:[^"''>]*\s)?canonical\b') THEN regexp_extract(tag, '(?i)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1) || regexp_extract(tag, '(?i)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2) || regexp_extract(tag, '(?i)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3)
        WHEN regexp_matches(tag, '(?i)^<meta') AND regexp_matches(tag, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''>\s]+)', 1) ELSE '' END), '&amp;', '&') AS link
    FROM tags
), whole_links AS (
    SELECT node, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN 'x:' || link WHEN starts_with(link, '/') THEN 'x://' || node_host || link
        WHEN starts_with(link, '?') THEN 'x://' || node_host || node_path || link ELSE 'x://' || node_host || regexp_extract(node_path, '^(.*/)', 1) || link END AS link
    FROM links WHERE link <> '' AND NOT starts_with(link, '#') AND (contains(link, '://') OR NOT regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:'))
), ends AS (
    SELECT node AS a, regexp_extract(link, '^[^:/?#]*://([^/?#]*)([^?#]*)(\?[^#]*)?', ['host', 'path', 'query']) AS t FROM whole_links
), edges AS (
    SELECT a, regexp_replace(translate(t.host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ':(80|443)?$', '') || CASE WHEN t.path = '' THEN '/' ELSE t.path END || t.query AS b FROM ends
), pairs AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
walk(node, seen) AS (SELECT a, a FROM pairs UNION SELECT w.node, x.b FROM walk w JOIN pairs x ON w.seen = x.a),
component AS (SELECT node, min(seen) AS component FROM walk GROUP BY node),
places AS (
    SELECT page_id, node, host, path FROM q UNION ALL
    SELECT NULL, node, regexp_extract(node, '^[^/?]*'), regexp_extract(node, '^[^/?]*([^?]*)', 1) FROM component
), judged AS (
    SELECT page_id, node, host, path, first(rh || rp ORDER BY length(rh) + length(rp) DESC, verdict) FILTER (fits) AS rule, first(verdict ORDER BY length(rh) + length(rp) DESC, verdict) FILTER (fits) AS verdict
    FROM (SELECT places.*, rules.*, rowid_of, (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) AS fits FROM (SELECT *, row_number() OVER () AS rowid_of FROM places) places CROSS JOIN rules)
    GROUP BY rowid_of, page_id, node, host, path
), blocked AS (
    SELECT component FROM judged JOIN component USING (node) WHERE rule IS NOT NULL GROUP BY component HAVING bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow')
), numbered AS (SELECT *, row_number() OVER () AS n FROM q),
own AS (
    SELECT n, page_id, node, host, path, first(rh || rp ORDER BY length(rh) + length(rp) DESC, verdict) FILTER (fits) AS rule, first(verdict ORDER BY length(rh) + length(rp) DESC, verdict) FILTER (fits) AS verdict
    FROM (SELECT numbered.*, rules.*, (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) AS fits FROM numbered CROSS JOIN rules) GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN b.component IS NOT NULL THEN 'block' END, 'allow') AS verdict, CASE WHEN rule IS NULL THEN b.component END AS component
FROM own LEFT JOIN component c USING (node) LEFT JOIN blocked b ON c.component = b.component
"""
