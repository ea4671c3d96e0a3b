"""URL rules, spread over redirect-equivalent addresses. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .store import keep

#: (action, host, path) of the contract.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?\s*canonical\b)[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?\s*refresh\b)[^>]*?\bcontent\s*=\s*(?:\"\s*[\d.]*\s*[;,]\s*url\s*=\s*'?([^\"']*)|'\s*[\d.]*\s*[;,]\s*url\s*=\s*\"?([^\"']*))"


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty if there is no ``://``."""
    return F.coalesce(F.regexp_extract(_after(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """What names a page in the graph: host, path and query, without scheme and fragment."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.concat(host_of(url), F.when(path_of(url) == "", F.lit("/")).otherwise(path_of(url)), query)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``rules`` as a table whose size Spark knows."""
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if not rules:
        return spark.sql("select '' action, '' rule_host, '' rule_path where false")
    return spark.sql("select * from values " + ", ".join(f"({', '.join(map(quoted, r))})" for r in rules) + " as t(action, rule_host, rule_path)")


def matched(urls: DataFrame, rules: DataFrame, by: list[str]) -> DataFrame:
    """``urls`` (columns ``by``, host, path) with rule and action of the longest rule that fits, both null if none.

    A rule fits its host and all subdomains if the path starts with the rule's. Ties go to allow, then to the longer
    host. Hosts are cut into their suffixes once per distinct host and path, so a hot host costs one row a path. The
    rules join by host suffix; Spark broadcasts them only where their measured size is below its threshold.
    """
    each = urls.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = each.select("host", "path", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host").where(F.expr("startswith(path, rule_path)"))
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), (F.col("action") == "allow").alias("a"), F.length("rule_host").alias("h"), F.concat("rule_host", "rule_path").alias("rule"), F.col("action"))
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return urls.join(best, ["host", "path"], "left").select(*by, "host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))


def _undotted(path: Column) -> Column:
    """``path`` without its ``.`` and ``..`` segments; none climbs over the root."""
    parts = F.split(path, "/", -1)
    up = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == ".", a).when(x == "..", up(a)).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b): keys of each page and of the addresses that its canonical links and its refresh redirects name."""
    some = pages.where("url is not null").where(F.lower("html").rlike("canonical|refresh"))
    found = [F.regexp_extract_all("html", F.lit(p), F.lit(g)) for p, n in ((_LINK, 3), (_REFRESH, 2)) for g in range(1, n + 1)]
    named = some.select("url", F.explode(F.array_distinct(F.concat(*found))).alias("to")).where("to <> ''").distinct()
    parts = named.select("url", F.trim(F.regexp_replace("to", "&amp;", "&")).alias("to"), F.regexp_extract("url", r"(?s)^([^:/?#]*):", 1).alias("scheme"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parts = keep(parts, "named")
    root, to = F.concat("scheme", F.lit("://"), "host"), F.col("to")
    rest, own = F.regexp_extract(to, r"(?s)^[^?#]*(.*)", 1), F.regexp_extract(to, r"(?s)^([^?#]*)", 1)
    whole = (
        F.when(to.contains("://"), to)
        .when(to.startswith("//"), F.concat("scheme", F.lit(":"), to))
        .when(to.startswith("/"), F.concat(root, _undotted(own), rest))
        .when((to == "") | to.startswith("#"), None)
        .when(to.startswith("?"), F.concat(root, "path", to))
        .otherwise(F.concat(root, _undotted(F.concat(F.when(F.col("path") == "", "/").otherwise(F.regexp_replace("path", r"[^/]*$", "")), own)), rest))
    )
    ends = keep(parts.select("url", whole.alias("to")).where("to is not null"), "linked")
    return ends.select(key_of(F.col("url")).alias("a"), key_of(F.col("to")).alias("b")).where("a <> b").distinct()


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of ``pages`` (page_id, url, html).

    verdict is that of the longest rule that fits the url. Without one it is the method's: the connected component of
    the url over canonical links, refresh redirects and the optional ``redirects`` (from_url, to_url). An address in
    it that a rule allows makes it allow; else one that a rule blocks makes it block; else it is allow. Addresses
    that are only linked to, not in ``pages``, count too.

    Null urls and urls without ``://`` have empty host and path, no rule, and verdict allow; null html has no links;
    repeated rows each have a row; other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col("page_id"), F.col("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    edges = link_edges(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.union(redirects.select(key_of(F.col("from_url")), key_of(F.col("to_url"))).where("from_url is not null and to_url is not null"))
    edges = keep(edges, "links")
    marked = matched(rows, rules, ["page_id", "url"])
    if edges.isEmpty():
        return marked.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"))
    roots = keep(components(edges, "a", "b", "links"), "aliases")
    names = roots.select("node", "root", F.regexp_extract("node", r"(?s)^([^/]*)", 1).alias("host"), F.regexp_extract("node", r"(?s)^[^/]*([^?]*)", 1).alias("path"))
    ruled = matched(names, rules, ["node", "root"]).where("action is not null")
    decided = ruled.groupBy("root").agg(F.min("action").alias("spread"))  # allow sorts before block
    spread = roots.join(decided, "root").select(F.col("node").alias("key"), "spread")
    out = marked.withColumn("key", key_of(F.col("url"))).join(spread, "key", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", "spread", F.lit("allow")).alias("verdict"))


#: The same on pages alone, for DuckDB: rules by prefix and suffix, then reachability over the links found in html.
ORACLE_SQL = r"""
with recursive rules(action, rh, rp) as (values ('allow','com','/'),('block','example.com','/en/'),('allow','www.example.com','/en/'),('block','net','/es/'),('block','net','/fr/')),
cut as (select page_id, url, html, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
named as (select page_id, url, html, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path, regexp_extract(url, '^[^?#]*(\?[^#]*)', 1) as query from cut),
keyed as (select *, host || case when path = '' then '/' else path end || query as k from named),
linked as (select k as a, unnest(regexp_extract_all(html, '<link rel="canonical" href="([^"]*)"', 1) || regexp_extract_all(html, '<meta http-equiv="refresh" content="[0-9]*; *url=([^"]*)"', 1)) as t from keyed),
edges as (select a, translate(regexp_extract(t, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(t, '://[^/?#]*([^#]*)', 1) as b from linked where strpos(t, '://') > 0),
both_ways as (select a, b from edges union select b, a from edges),
reach(a, b) as (select a, a from both_ways union select r.a, e.b from reach r join both_ways e on e.a = r.b),
nodes as (select distinct b as k, regexp_extract(b, '^([^/]*)', 1) as host, regexp_extract(b, '^[^/]*([^?]*)', 1) as path from reach),
node_rule as (select n.k, arg_max(action, (length(rh) + length(rp)) * 2 + (action = 'allow')::int) as action from nodes n join rules on (n.host = rh or n.host like '%.' || rh) and starts_with(n.path, rp) group by n.k),
spread as (select r.a as k, min(action) as action from reach r join node_rule n on n.k = r.b group by r.a),
page_key as (select distinct host, path from keyed),
page_rule as (select p.host, p.path, arg_max(rh || rp, length(rh) + length(rp)) as rule, arg_max(action, length(rh) + length(rp)) as action
  from page_key p join rules on (p.host = rh or p.host like '%.' || rh) and starts_with(p.path, rp) group by p.host, p.path)
select y.page_id, y.host, y.path, p.rule, coalesce(p.action, s.action, 'allow') as verdict
from keyed y left join page_rule p on p.host = y.host and p.path = y.path left join spread s on s.k = y.k
"""
