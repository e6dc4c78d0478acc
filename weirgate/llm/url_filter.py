"""URL filters with redirect equivalence, in DataFrame expressions only.

Rules name a host (with its subdomains) and a path prefix; of the rules that fit a url the longest wins. A
page no rule fits takes the decision of its aliases: pages are nodes (urls that differ only in scheme, www,
fragment, tracking parameters, a closing slash or .html are one node), canonical links and refresh redirects
are edges, and decisions spread over connected components. An explicit allow in the component takes
precedence over a block; a page's own rule takes precedence over both.

The nodes' decisions are combined before any shuffle, so a hot node or host is one row when it is joined.

Edge cases: a null url, or one without "://", has empty host and path, fits no rule, is nobody's alias and
is allowed. A null html has no links. Repeated rows are judged alike. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirgate.llm.common import materialize
from weirgate.llm.components import components

#: Up to so many rules are written into the plan; more are joined by host.
LITERAL_RULES = 500
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    pattern: str  # host/path

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The form that aliases of a url share; null without a host."""
    host = F.regexp_replace(host_of(url), r"^www\.", "")
    path = F.regexp_replace(path_of(url), r"(/index)?(\.html?)?/*$", "")
    query = F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1)
    query = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|gclid|fbclid)=")), "&")
    return F.when(host != "", F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


def _resolved(link: Column, path: Column) -> Column:
    """A link from the directory of a path, without . and .. steps."""
    own = F.regexp_extract(link, r"^([^?#]*)", 1)
    steps = F.split(F.concat(F.regexp_extract(path, r"^(.*/)", 1), own), "/")
    up = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(x.isin(".", ""), done).otherwise(F.concat(done, F.array(x)))
    walked = F.aggregate(steps, F.array().cast("array<string>"), up)
    return F.concat(F.lit("/"), F.array_join(walked, "/"), F.regexp_extract(link, r"^[^?#]*(.*)$", 1))


def _absolute(link: Column, url: Column) -> Column:
    """A link as a url; one without a leading slash is read from the page's directory, with . and .. resolved."""
    scheme = F.regexp_extract(url, r"^([^/?#]*:)//", 1)
    return F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(scheme, F.lit("//"), host_of(url), link)).when((link != "") & ~link.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|[?#])") & (host_of(url) != ""), F.concat(scheme, F.lit("//"), host_of(url), _resolved(link, path_of(url))))


def link_targets(url: Column, html: Column) -> Column:
    """Urls that a page names as its canonical form or redirects to."""
    tag = F.regexp_extract(html, r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0)
    canonical = F.regexp_extract(tag, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    meta = F.regexp_extract(html, r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=[^>]*>""", 0)
    refresh = F.regexp_extract(meta, r"""(?is)\burl\s*=\s*['"]?([^"'\s>]+)""", 1)
    found = F.filter(F.array(_absolute(canonical, url), _absolute(refresh, url)), lambda x: x.isNotNull() & (x != ""))
    return F.when(html.rlike("(?i)canonical|refresh"), found).otherwise(F.array().cast("array<string>"))


def _fit(rules: Sequence[Rule]) -> Column:
    """The longest rule that fits host and path, as struct(rule, verdict)."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(set(rules), key=lambda r: (len(r.pattern), r.verdict == "allow")):  # the longest is tested first
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.pattern).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _with_rules(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    if len(rules) <= LITERAL_RULES:
        return pages.withColumn("fit", _fit(rules))
    listed = pages.sparkSession.createDataFrame([(r.host, r.path, r.pattern, r.verdict) for r in rules], "rule_host string, rule_path string, rule string, verdict string")
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = pages.select("host").distinct().withColumn("rule_host", F.explode(suffix)).join(listed, "rule_host")
    order = F.struct(F.length("rule"), (F.col("verdict") == "allow").cast("int"))
    paths = pages.select("host", "path").distinct().join(hosts, "host").where("startswith(path, rule_path)")
    best = paths.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("fit"))
    return pages.join(best, ["host", "path"], "left")


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule (of the page itself), verdict, component (smallest alias node, if it has links)."""
    url = F.col("url")
    parsed = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"), F.filter(F.transform(link_targets(url, F.col("html")), node_of), lambda x: x.isNotNull()).alias("links"))
    judged = materialize(_with_rules(parsed, rules), "urls")
    edges = judged.where("size(links) > 0 AND node IS NOT NULL").select(F.col("node").alias("src"), F.explode("links").alias("dst"))
    linked = materialize(components(edges), "url-components")
    own = judged.where("node IS NOT NULL AND fit IS NOT NULL").groupBy("node").agg(F.max(F.col("fit.verdict") == "block").alias("block"), F.max(F.col("fit.verdict") == "allow").alias("allow"))
    decided = own.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")).groupBy("component").agg(F.max("block").alias("block"), F.max("allow").alias("allow"))
    spread = linked.select("node", "component").unionAll(own.select("node", F.col("node").alias("component")).join(linked.select("node"), "node", "left_anti"))
    of_node = spread.join(decided, "component", "left").select("node", "component", F.when(F.col("allow"), F.lit("allow")).when(F.col("block"), F.lit("block")).alias("alias_verdict"))
    # pages without a host have no node and no alias: they need no join
    bare = judged.where("node IS NULL").withColumns({"component": F.lit(None).cast("string"), "alias_verdict": F.lit(None).cast("string")})
    known = judged.where("node IS NOT NULL").join(of_node, "node", "left").unionByName(bare)
    verdict = F.coalesce("fit.verdict", "alias_verdict", F.lit("allow")).alias("verdict")
    return known.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict, "component")
