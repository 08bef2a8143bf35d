"""URL filters: rules by host and path, carried over redirect and canonical links to aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import components
from .words import ascii_lower, table

# (host, path, verdict); a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """The url without its fragment, scheme and host in lower case: what a server can tell apart."""
    origin = F.regexp_extract(url, "^([^/?#]+://[^/?#]*)", 1)
    return F.when(origin != "", F.concat(ascii_lower(origin), F.regexp_extract(url, "^[^/?#]+://[^/?#]*([^#]*)", 1)))


def _attribute(tag: Column, name: str) -> Column:
    found = [F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*{value}", 1)
             for value in ('"([^"]*)"', "'([^']*)'", r"([^\s\"'<>]+)")]
    return F.trim(F.coalesce(*[F.when(x != "", x) for x in found], F.lit("")))


def _resolved(base: Column, link: Column) -> Column:
    """A link against the page's address; null for what names no web address."""
    scheme = F.regexp_extract(base, "^([^:/?#]*)://", 1)
    origin = F.regexp_extract(base, "^([^:/?#]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, "^[^:/?#]*://[^/?#]*(/(?:[^?#]*/)?)", 1)
    folder = F.concat(origin, F.when(path == "", "/").otherwise(path))
    return (F.when((link == "") | link.startswith("#"), F.lit(None).cast("string"))
            .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(origin, link))
            .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
            .otherwise(F.concat(folder, link)))


def page_links(pages: DataFrame) -> DataFrame:
    """(src, dst) addresses: canonical links and refresh redirects found in the pages' own markup."""
    tags = pages.where(F.col("html").rlike("(?i)canonical|refresh")).select(
        address(F.col("url")).alias("src"),
        F.explode(F.regexp_extract_all("html", F.lit(r"(?is)(<(?:link|meta)\b[^<>]*>)"), 1)).alias("tag"))
    rel, kind = F.lower(_attribute(F.col("tag"), "rel")), F.lower(_attribute(F.col("tag"), "http-equiv"))
    target = F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1)
    link = (F.when(F.col("tag").rlike("(?i)^<link") & F.array_contains(F.split(rel, r"\s+"), "canonical"),
                   _attribute(F.col("tag"), "href"))
            .when(F.col("tag").rlike("(?i)^<meta") & (kind == "refresh"), F.trim(target)))
    tags = materialize(tags.select("src", link.alias("link")), "tags")
    found = tags.select("src", address(_resolved(F.col("src"), F.col("link"))).alias("dst"))
    return found.where("src is not null and dst is not null and src <> dst").distinct()


def matched(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) of the places (host, path) that a rule fits; the longest rule wins.

    Only as many trailing labels of a host are tried as the longest rule has, so a place meets a
    bounded number of hosts, and the rules meet them in an equi join, however many rules there are.
    """
    depth = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    labels = F.split("host", r"\.")
    tails = F.array(*[F.when(F.size(labels) >= k, F.array_join(F.slice(labels, -k, k), ".")) for k in range(1, depth + 1)])
    places = places.select("host", "path").distinct()
    tried = places.select("host", "path", F.explode(tails).alias("_tail")).where("_tail is not null")
    rules = rules.select(F.col("host").alias("_tail"), F.col("path").alias("_path"),
                         F.concat("host", "path").alias("rule"), "verdict")
    fit = tried.join(rules, "_tail").where(F.col("path").startswith(F.col("_path")))
    best = F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best")
    return fit.groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def judged(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page.

    The rule that fits a url decides. A url without a rule is blocked if a rule blocks one of its
    aliases, unless a rule allows one of them: an explicit allow comes first. Aliases are the
    connected components of ``links`` (src, dst), by default the canonical links and refresh
    redirects of the pages. A url that is null or has no ``://`` has no host, no rule and no alias
    and is allowed. Repeated pages get equal rows.
    """
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", address(F.col("url")).alias("_at"), host.alias("host"), path.alias("path"))
    if links is None:
        links = page_links(pages)
    links = materialize(links.select("src", "dst"), "links")
    ends = links.select(F.col("src").alias("_at")).union(links.select("dst")).distinct()
    host, path = host_and_path(F.col("_at"))
    ends = ends.select("_at", host.alias("host"), path.alias("path"))
    ruled = materialize(matched(base.select("host", "path").union(ends.select("host", "path")), rules), "ruled")
    spread = decisions(links, ends.join(ruled, ["host", "path"], "left"))
    rows = base.join(ruled, ["host", "path"], "left").join(spread, "_at", "left")
    verdict = F.coalesce("verdict", F.when(F.col("_blocked"), "block"), F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def decisions(links: DataFrame, ends: DataFrame) -> DataFrame:
    """(_at, _blocked) for every end of a link: does its component hold a blocked and no allowed address?"""
    parts = components(links).select(F.col("vertex").alias("_at"), "root")
    marked = parts.join(ends.select("_at", "verdict"), "_at", "left")
    has = marked.groupBy("root").agg(
        F.coalesce(F.bool_or(F.col("verdict") == "block"), F.lit(False)).alias("_b"),
        F.coalesce(F.bool_or(F.col("verdict") == "allow"), F.lit(False)).alias("_a"))
    return parts.join(has, "root").select("_at", (F.col("_b") & ~F.col("_a")).alias("_blocked"))


def rule_table(spark, rules=RULES) -> DataFrame:
    return table(spark, list(rules), "host string,path string,verdict string")


# The rules and the tag patterns are those above, spelled out.
JUDGED_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, regexp_extract(url, '^([^/?#]+://[^/?#]*)', 1) AS origin,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
q AS (
  SELECT page_id, html,
    CASE WHEN origin <> '' THEN translate(origin, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      || regexp_extract(url, '^[^/?#]+://[^/?#]*([^#]*)', 1) END AS addr,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM p),
rules(h, d, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
r AS (
  SELECT page_id, html, addr, host, path,
    (SELECT arg_max(h || d, length(h || d)) FROM rules
     WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, d)) AS rule
  FROM q),
j AS (SELECT r.*, v FROM r LEFT JOIN rules ON rule = h || d),
tags AS (
  SELECT addr, unnest(regexp_extract_all(html, '(?is)(<link\b[^<>]*>)', 1)) AS tag FROM q WHERE addr IS NOT NULL),
links AS (
  SELECT DISTINCT addr AS a, regexp_extract(tag, '(?is)\shref\s*=\s*"([^"#]*)', 1) AS b FROM tags
  WHERE regexp_matches(tag, '(?is)\srel\s*=\s*"canonical"')),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT reach.a, e.b FROM reach JOIN both_ways e ON reach.b = e.a),
spread AS (
  SELECT reach.a, bool_or(j.v = 'block') AND NOT coalesce(bool_or(j.v = 'allow'), false) AS blocked
  FROM reach JOIN j ON reach.b = j.addr GROUP BY reach.a)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN blocked THEN 'block' END, 'allow') AS verdict
FROM j LEFT JOIN spread ON addr = a
"""
