"""URL rules with redirect equivalence.

A rule is a host, a path prefix and a verdict; the longest rule that fits a url decides it. Pages that redirect to one
another or name one another as canonical are aliases. They form connected components, and a block decided by a rule
for one url of a component reaches every alias that no rule decides. A rule's own verdict comes first: an explicit
allow is never overridden by a block that reaches it through an alias.
"""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from churnspark.llm.common import arrow_rows, components
from churnspark.session import materialize

# The rules of the url query, as (host, path, verdict).
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
_LINK = re.compile(r"<(?:link|meta)\b[^>]*>", re.I)
_ATTRIBUTE = re.compile(r"""([a-z-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_REFRESH = re.compile(r"""^[\s\d.]*[;,]\s*url\s*=\s*['"]?\s*([^'"]+?)\s*['"]?\s*$""", re.I)


def host_of(url):
    """After the first '://' up to '/', '?', '#' or the end, A-Z in lower case; null or no '://': empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url):
    """What follows the host up to '?', '#' or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def targets(url: str | None, html: str | None) -> list[str]:
    """Absolute urls that a page redirects to (meta refresh) or names as canonical."""
    out = []
    for tag in _LINK.findall(html or ""):
        at = {k.lower(): unescape(v.strip("\"'")) for k, v in reversed(_ATTRIBUTE.findall(tag))}
        if "canonical" in at.get("rel", "").lower().split() and at.get("href"):
            out.append(at["href"])
        elif at.get("http-equiv", "").lower() == "refresh" and (m := _REFRESH.match(at.get("content", ""))):
            out.append(m[1])
    made = []
    for target in out:
        try:
            made.append(urljoin(url or "", target.strip()))
        except ValueError:
            continue  # not a url
    return [t for t in made if "://" in t]


def aliases(pages: DataFrame) -> DataFrame:
    """(url, target) of redirects and canonical links in the pages' html; only pages that hold such a tag reach Python."""
    linked = pages.where(F.col("url").contains("://") & F.col("html").rlike("(?i)<(link|meta)[^>]*(canonical|refresh)")).select("url", "html")
    schema = pa.schema([("url", pa.string()), ("target", pa.string())])

    def rows(batches):
        for batch in batches:
            for url, html in zip(batch.column(0).to_pylist(), batch.column(1)):
                for target in targets(url, html.as_py()):
                    yield url, target

    return linked.mapInArrow(arrow_rows(schema, rows), "url string, target string")


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (host, path) of ``urls`` that a rule fits, with the rule and its verdict.

    The host's suffixes at its dots meet the rules' hosts in an equi-join, so the rule table may have any size. The
    longest rule (host and path together) wins, the longer host among equals, then block before allow.
    """
    keys = urls.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = keys.withColumn("rule_host", F.explode(suffixes)).join(rules, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("rule_verdict"))
    best = F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), rank)
    return found.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", F.col("best.verdict").alias("rule_verdict"))


def rule_table(spark, rules) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict ('allow' or 'block').

    ``rules`` is a sequence of (host, path, verdict) or a DataFrame rule_host, rule_path, rule_verdict. ``redirects``
    (two url columns) adds edges to those read from the html. Two urls are one node if host, path and query agree. A
    null or malformed url has empty host and path, no rule, no alias, and is allowed. Repeated rows stay; an empty
    table gives no rows.
    """
    spark = pages.sparkSession
    rules = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    own = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html")
    )
    edges = aliases(own)
    if redirects is not None:
        edges = edges.union(redirects.select(*[F.col(f"`{c}`").cast("string") for c in redirects.columns[:2]]))

    def node(c):
        url = F.col(c)
        return F.concat(host_of(url), path_of(url), F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^?#]*(\?[^#]*)", 1))

    def place(c):
        return F.struct(host_of(F.col(c)).alias("host"), path_of(F.col(c)).alias("path"), node(c).alias("node"))

    # Written, as it is read three times and the pages' html should be read once.
    edges = materialize(edges.select(place("url").alias("a"), place("target").alias("b")).where("a.host <> '' and b.host <> ''"), "redirects")
    joined = components(edges.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")))
    # Urls that are only named by others can be blocked by a rule too, so all ends of edges are judged.
    ends = edges.select("a.*").union(edges.select("b.*")).distinct()
    blocked = (
        ends.join(ruled(ends, rules), ["host", "path"]).where("rule_verdict = 'block'").join(joined, "node").select("component").distinct()
    )
    tainted = joined.join(blocked, "component").select("node").distinct().withColumn("tainted", F.lit(True))
    urls = own.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node("url").alias("node"))
    verdict = F.coalesce("rule_verdict", F.when(F.col("tainted"), "block"), F.lit("allow"))
    return (
        urls.join(ruled(urls, rules), ["host", "path"], "left")
        .join(tainted, "node", "left")
        .select("page_id", "host", "path", "rule", verdict.alias("verdict"))
    )


# The check: rules by suffix comparison, aliases by a recursive walk over edges read with the same patterns.
CHECK_SQL = r"""
WITH RECURSIVE rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), own AS (
  SELECT page_id, url, html, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
         regexp_extract(coalesce(url, ''), '^[^?#]*(\?[^#]*)', 1, 's') AS query
  FROM pages
), tags AS (
  SELECT host || path || query AS u, unnest(regexp_extract_all(html, '<(?:link|meta)\b[^>]*>', 0, 'i')) AS tag FROM own WHERE host <> ''
), found AS (
  SELECT u, CASE WHEN regexp_matches(tag, 'rel\s*=\s*["'']?canonical', 'i') THEN regexp_extract(tag, 'href\s*=\s*["'']([^"'']*)["'']', 1, 'i')
                 WHEN regexp_matches(tag, 'http-equiv\s*=\s*["'']?refresh', 'i') THEN regexp_extract(tag, 'url\s*=\s*([^"'' >]*)', 1, 'i') END AS target FROM tags
), edges AS (
  SELECT u, translate(regexp_extract(target, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(target, '^.*?://[^/?#]*([^?#]*)', 1, 's')
         || regexp_extract(target, '^[^?#]*(\?[^#]*)', 1, 's') AS v
  FROM found WHERE target LIKE '%://%'
), both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(a, b) AS (SELECT u, u FROM both_ways UNION SELECT r.a, e.v FROM reach r JOIN both_ways e ON r.b = e.u),
nodes AS (SELECT DISTINCT u AS node, split_part(u, '/', 1) AS host, regexp_extract(u, '^[^/?]*([^?]*)', 1) AS path FROM both_ways),
fits AS (
  SELECT p.host, p.path, arg_max(struct_pack(rule := rule_host || rule_path, verdict := rule_verdict), length(rule_host) + length(rule_path)) AS best
  FROM (SELECT host, path FROM own UNION SELECT host, path FROM nodes) p JOIN rules r
    ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)
  GROUP BY p.host, p.path
), tainted AS (
  SELECT DISTINCT r.b AS node FROM reach r JOIN nodes n ON r.a = n.node JOIN fits f ON f.host = n.host AND f.path = n.path WHERE f.best.verdict = 'block'
)
SELECT o.page_id, o.host, o.path, f.best.rule AS rule,
       coalesce(f.best.verdict, CASE WHEN t.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM own o LEFT JOIN fits f ON f.host = o.host AND f.path = o.path AND o.host <> ''
LEFT JOIN tainted t ON t.node = o.host || o.path || o.query
"""
