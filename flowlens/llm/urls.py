"""URL rules with redirect equivalence.

Rules name a host and a path; they reach a url through the suffixes of its host, and the longest fitting rule decides.
Urls that pages declare to be the same (canonical link, refresh, og:url) form components; a blocked url blocks its aliases
unless one of the component is explicitly allowed, and a url's own rule always goes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import LOWER, UPPER, Scratch, let, lower_ascii, unused
from flowlens.llm.components import connected_components

#: The rules of the query: (rule, verdict); a rule is a host followed by the start of a path.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]

#: Most ruled hosts that are broadcast; beyond it the planner joins them.
MAX_BROADCAST = 100_000

_LINK = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = (r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["'][^"'>]*?url\s*=\s*"""
            r"""([^"'\s>]+)""")
#: References to an ampersand in an attribute.
_AMPERSAND = "(?i)&(?:amp|#38|#x26);"
_OG = r"""(?is)<meta\b(?=[^>]*\bproperty\s*=\s*["']?og:url\b)[^>]*\bcontent\s*=\s*["']?([^"'\s>]+)"""


def rules_table(spark, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """``rule, verdict, rule_host, rule_path``."""
    schema = T.StructType([T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return with_rule_parts(spark.createDataFrame(RULES if rules is None else rules, schema))


def with_rule_parts(rules: DataFrame) -> DataFrame:
    host = F.substring_index("rule", "/", 1)
    return rules.select("rule", "verdict", lower_ascii(host).alias("rule_host"),
                        F.substring(F.col("rule"), F.char_length(host) + 1, F.char_length("rule")).alias("rule_path"))


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.char_length(url)))


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.element_at(F.split(_rest(url), "[/?#]", 2), 1), F.lit("")))


def path_of(url: Column) -> Column:
    def cut(rest):
        start = F.char_length(F.element_at(F.split(rest, "[/?#]", 2), 1))
        return F.element_at(F.split(F.substring(rest, start + 1, F.char_length(rest)), "[?#]", 2), 1)

    return F.coalesce(let(_rest(url), cut), F.lit(""))


def _key(url: Column) -> Column:
    """Node of the alias graph: host, path and query; scheme and fragment don't tell urls apart."""
    rest = F.element_at(F.split(_rest(url), "#", 2), 1)
    return F.concat(host_of(url), F.substring(rest, F.char_length(host_of(url)) + 1, F.char_length(rest)))


def longest_rule(urls: DataFrame, rules: DataFrame, scratch: Scratch) -> DataFrame:
    """``urls(host, path, ...)`` with ``rule`` and ``rule_verdict`` of the longest fitting rule, or null.

    Only distinct hosts are taken apart into suffixes; each then has its own rules in an array. Of rules of one length
    (equal rules with two verdicts) an allow goes first. Columns of ``urls`` pass as they are, but for ``rule`` and
    ``rule_verdict``, which are replaced; repeated rows, null hosts (no rule) and empty tables need no care.
    """
    own_rules, own_best = unused(urls, "__rules"), unused(urls, "__best")
    parts = F.split("host", r"\.")
    suffixes = F.transform(parts, lambda _, i: F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))
    hosts = urls.select("host").where(F.col("host") != "").distinct().select("host", F.explode(suffixes).alias("suffix"))
    fits = (hosts.join(rules, F.col("suffix") == F.col("rule_host")).groupBy("host")
            .agg(F.collect_set(F.struct(F.char_length("rule").alias("size"), "verdict", "rule", "rule_path"))
                 .alias(own_rules)))
    own = F.filter(own_rules, lambda r: F.col("path").startswith(r["rule_path"]))
    order = F.transform(own, lambda r: F.struct(-r["size"], r["verdict"], r["rule"]))
    best = F.array_min(order)
    # The ruled hosts are few beside the pages; counted, they are sent along, so a host with a third of the pages is no key.
    fits = scratch.keep(fits, "ruled-hosts")
    if fits.count() <= MAX_BROADCAST:
        fits = F.broadcast(fits)
    return (urls.join(fits, "host", "left").withColumn(own_best, best)
            .withColumn("rule", F.col(f"{own_best}.rule")).withColumn("rule_verdict", F.col(f"{own_best}.verdict"))
            .drop(own_rules, own_best))


def alias_edges(pages: DataFrame) -> DataFrame:
    """``url, target`` from every canonical link, refresh and og:url of a page.

    References to ``&`` in targets are decoded; relative targets are resolved against the host and folder of the page.
    """
    found = [F.regexp_extract_all("html", F.lit(pattern), F.lit(1)) for pattern in (_LINK, _REFRESH, _OG)]
    cheap = F.col("html").rlike(r"(?i)canonical|http-equiv|og:url")
    rows = (pages.where(F.col("url").isNotNull() & cheap)
            .select("url", F.explode(F.concat(*found)).alias("target")).where("target <> ''")
            .withColumn("target", F.regexp_replace("target", _AMPERSAND, "&")))
    scheme = F.substring_index("url", "://", 1)
    absolute = (F.when(F.instr("target", "://") > 0, F.col("target"))
                .when(F.col("target").startswith("//"), F.concat(scheme, F.lit(":"), F.col("target")))
                .when(F.col("target").startswith("/"), F.concat(scheme, F.lit("://"), host_of(F.col("url")), "target"))
                .otherwise(F.concat(scheme, F.lit("://"), host_of(F.col("url")),
                                    F.regexp_replace(path_of(F.col("url")), "[^/]*$", ""), "target")))
    return rows.select("url", absolute.alias("target"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None,
          scratch: Scratch | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per page.

    ``redirects(url, target)`` adds edges known from elsewhere. A null url, or one without ``://``, has empty host and
    path, no rule and no aliases, and is allowed. Repeated rows give a row each; null html declares nothing; other columns
    are not read.
    """
    scratch = scratch or Scratch(pages.sparkSession)
    edges = alias_edges(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select("url", "target"))
    edges = scratch.keep(edges.where(_rest(F.col("url")).isNotNull() & _rest(F.col("target")).isNotNull()).distinct(),
                         "alias-edges")
    url, target = F.col("url"), F.col("target")
    members = connected_components(edges.select(_key(url).alias("a"), _key(target).alias("b")), scratch)
    nodes = edges.select(url).unionByName(edges.select(target.alias("url"))).distinct()
    nodes = longest_rule(nodes.select(_key(url).alias("node"), host_of(url).alias("host"), path_of(url).alias("path")),
                         rules, scratch)
    said = nodes.join(members, "node").groupBy("component").agg(
        F.min("rule_verdict").alias("said"))  # allow sorts before block
    known = members.join(said, "component").select("node", "said").where("said is not null")
    rows = longest_rule(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"),
                                     _key(url).alias("node")), rules, scratch)
    return rows.join(known, "node", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", "said", F.lit("allow")).alias("verdict"))


def sql(table: str = "pages") -> str:
    """The query in DuckDB SQL; ``table`` may be a subquery."""
    rules = ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in RULES)
    lower = f"'{UPPER}', '{LOWER}'"

    def parts(url):
        rest = f"case when strpos({url}, '://') > 0 then substr({url}, strpos({url}, '://') + 3) end"
        host = f"translate(coalesce(regexp_extract({rest}, '^[^/?#]*'), ''), {lower})"
        return rest, host, rf"coalesce(regexp_extract({rest}, '^[^/?#]*(/[^?#]*)?', 1), '')"

    rest, host, path = parts("url")

    def key(url):
        rest, host, _ = parts(url)
        return f"{host} || regexp_extract({rest}, '^[^/?#]*([^#]*)', 1)"

    def find(expr):
        return expr.replace("'", "''")

    link = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
    link2 = r"""(?is)<link\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)[^>]*\brel\s*=\s*["']?canonical\b"""
    refresh = (r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*\bcontent\s*=\s*["'][^"'>]*?url\s*=\s*"""
               r"""([^"'\s>]+)""")
    refresh2 = (r"""(?is)<meta\b[^>]*\bcontent\s*=\s*["'][^"'>]*?url\s*=\s*([^"'\s>]+)[^>]*\bhttp-equiv\s*=\s*["']?refresh\b""")
    og2 = r"""(?is)<meta\b[^>]*\bcontent\s*=\s*["']?([^"'\s>]+)[^>]*\bproperty\s*=\s*["']?og:url\b"""
    og = r"""(?is)<meta\b[^>]*\bproperty\s*=\s*["']?og:url\b[^>]*\bcontent\s*=\s*["']?([^"'\s>]+)"""
    found = ", ".join(f"regexp_extract_all(html, '{find(p)}', 1)" for p in (link, link2, refresh, refresh2, og, og2))
    base = f"regexp_extract(url, '^(.*?)://', 1) || '://' || {host}"
    return rf"""
with recursive r as (select rule, verdict, split_part(rule, '/', 1) as rh, substr(rule, strpos(rule, '/')) as rp
  from (values {rules}) t(rule, verdict)),
p as (select row_number() over () as n, page_id, url, html, {host} as host, {path} as path from {table}),
e0 as (select url, regexp_replace(unnest(flatten([{found}])), '{_AMPERSAND}', '&', 'g') as target
  from p where strpos(url, '://') > 0 and html is not null),
e as (select distinct url, case when strpos(target, '://') > 0 then target
        when starts_with(target, '//') then regexp_extract(url, '^(.*?)://', 1) || ':' || target
        when starts_with(target, '/') then {base} || target
        else {base} || regexp_replace({path}, '[^/]*$', '') || target end as target from e0 where target <> ''),
k as (select {key('url')} as a, {key('target')} as b from e),
ends as (select a, b from k union select b, a from k),
reach as (select a as node, a as other from ends union select reach.node, ends.b from reach join ends on reach.other = ends.a),
urls as (select url from e union select target from e),
nodes as (select {key('url')} as node, {host} as host, {path} as path from urls),
ruled as (select node, arg_min(verdict, (-length(rule), verdict)) as v from nodes join r
  on (nodes.host = rh or ends_with(nodes.host, '.' || rh)) and starts_with(nodes.path, rp) group by node, host, path),
said as (select reach.node, min(v) as said from reach join ruled on reach.other = ruled.node group by reach.node),
own as (select n, arg_min(rule, (-length(rule), verdict)) as rule, arg_min(verdict, (-length(rule), verdict)) as v
  from p join r on (p.host = rh or ends_with(p.host, '.' || rh)) and starts_with(p.path, rp) group by n)
select page_id, p.host, p.path, own.rule as rule, coalesce(own.v, said.said, 'allow') as verdict
from p left join own using (n) left join said on said.node = {key('p.url')}"""
