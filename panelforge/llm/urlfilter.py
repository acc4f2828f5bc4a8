"""Allow and block rules on URLs, carried over to aliases by redirect equivalence.

A URL is judged by the longest rule that fits it. URLs that no rule fits take
over a block from their aliases: redirect and canonical-link edges join URLs
into components (distributed large-star/small-star), and a component with a
blocked member is blocked, except for members that a rule allows explicitly.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import LOWER, UPPER
from panelforge.llm.components import connected_components, skew_join

#: So many rules are tried one by one in an expression; more are found by hash joins.
MOST_RULES = 100
#: Query parameters that don't change the page.
TRACKING = r"(?i)^(utm_[a-z]+|ref|fbclid|gclid)="


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does. Of rules as long as one another the greatest text wins, of two verdicts on one text ``allow``."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text, r.host, r.verdict == "allow")):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def rule_table(rules: DataFrame) -> DataFrame:
    """host, path, verdict without repetitions; of two verdicts on a host and path, ``allow``. Rules with a null are none."""
    return rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))


def joined_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, _r (as ``best_rule``) of every distinct host and path of ``urls`` that a rule fits.

    A host is looked up by each of its domains, which gives the lengths of the
    paths that these have rules for; the path's beginnings of those lengths are
    then looked up. Any number of rules: both joins are by hash, and Spark can
    split a domain that many hosts share.
    """
    table = rule_table(rules)
    lengths = table.groupBy("host").agg(F.collect_set(F.char_length("path")).alias("_lengths"))
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = urls.select("host", "path").distinct().select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.explode(domains).alias("host"))
    known = skew_join(each, lengths, "host")
    begun = known.select("_host", "_path", "host", F.explode(F.filter("_lengths", lambda n: n <= F.char_length("_path"))).alias("_n"))
    begun = begun.select("_host", "_path", F.struct("host", F.substring(F.col("_path"), F.lit(1), F.col("_n")).alias("path")).alias("_key"))
    found = skew_join(begun, table.select(F.struct("host", "path").alias("_key"), "verdict"), "_key")
    text = F.concat("_key.host", "_key.path")
    order = F.struct(F.char_length(text), text, F.col("_key.host"))
    best = found.groupBy("_host", "_path").agg(F.max_by(F.struct(text.alias("rule"), "verdict"), order).alias("_r"))
    return best.select(F.col("_host").alias("host"), F.col("_path").alias("path"), "_r")


def with_rule(urls: DataFrame, rules: list[Rule] | DataFrame) -> DataFrame:
    """``urls`` (host, path, ...) with ``_r``, the rule that fits."""
    if isinstance(rules, list) and len(rules) <= MOST_RULES:
        return urls.withColumn("_r", best_rule(F.col("host"), F.col("path"), rules))
    if isinstance(rules, list):
        rules = urls.sparkSession.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    keyed = urls.withColumn("_key", F.struct("host", "path"))
    return skew_join(keyed, joined_rules(urls, rules).select(F.struct("host", "path").alias("_key"), "_r"), "_key", "left").drop("_key")


def canonical(url: Column) -> Column:
    """The URL without scheme, fragment, tracking parameters and letter case of the host: what a server takes for the same page."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~F.regexp_like(x, F.lit(TRACKING)))
    rest = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), path_of(url), rest))


def decoded(text: Column) -> Column:
    """``text`` with the HTML entities that URLs hold decoded; &amp; last, so that nothing is decoded twice."""
    for entity, mark in ((r"&(?:quot|#0*34|#x0*22);", '"'), (r"&(?:apos|#0*39|#x0*27);", "'"), (r"&(?:#0*47|#x0*2f|sol);", "/"), (r"&(?:amp|#0*38|#x0*26);", "&")):
        text = F.regexp_replace(text, "(?i)" + entity, mark)
    return text


def resolved(target: Column, base: Column) -> Column:
    """``target`` as a whole URL, as a browser on the page ``base`` takes it (RFC 3986); null if it leads to no page."""
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    path = F.when(path_of(base) == "", F.lit("/")).otherwise(path_of(base))
    tail = F.regexp_extract(target, r"(?s)([?#].*)$", 1)
    own = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    joined = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(F.regexp_replace(path, r"(?s)[^/]*$", ""), own))

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    parts = F.split(F.substring(joined, 2, 2**31 - 1), "/", -1)
    # a last . or .. names a folder
    parts = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    flat = F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
    query = F.when(F.startswith(tail, F.lit("?")), tail).otherwise(F.concat(F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1), tail))
    relative = F.when(own == "", F.concat(root, path, query)).otherwise(F.concat(root, flat, tail))
    whole = F.when(F.startswith(target, F.lit("//")), F.concat(scheme, target)).when(root != "", relative)
    return F.when(F.regexp_like(target, F.lit(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://")), target).when(~F.regexp_like(target, F.lit(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:")), whole)


def page_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """src and dst (canonical URLs) of all canonical links and immediate refreshes that pages declare; targets may be relative."""
    html, low = F.col(html_col), F.lower(html_col)
    links = F.regexp_extract_all(html, F.lit(r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""), 1)
    hops = F.regexp_extract_all(html, F.lit(r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""), 1)
    # most pages declare neither; contains() spares them the expressions
    hints = F.contains(low, F.lit("canonical")) | F.contains(low, F.lit("refresh"))
    targets = pages.where(hints).select(F.col(url_col).alias("base"), F.explode(F.concat(links, hops)).alias("to"))
    ends = targets.where("to <> ''").select(canonical(F.col("base")).alias("src"), canonical(resolved(decoded(F.col("to")), F.col("base"))).alias("dst"))
    return ends.where("src is not null and dst is not null and src <> dst")


def judge(pages: DataFrame, rules: list[Rule] | DataFrame, edges: DataFrame | None = None, default: str = "allow", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The id column, host, path, rule, verdict and source (rule, alias or default) of every row.

    ``edges`` (src, dst: URLs) are further redirects, such as a crawler's log;
    a URL that is no page is judged by the rules like any other, so a block on
    it reaches the pages that lead there. Null URLs have empty parts and the
    default verdict. Repeated rows are judged alike. ``rules`` may be a list or a
    table (host, path, verdict) of any size; of rules as long as one another the
    greatest text wins, then the greatest host, of two verdicts on one host and
    path ``allow``.
    """
    links = page_edges(pages, url_col, html_col)
    if edges is not None:
        links = links.unionByName(edges.select(canonical(F.col("src")).alias("src"), canonical(F.col("dst")).alias("dst")))
    groups = connected_components(links)
    member = F.concat(F.lit("x://"), F.col("node"))
    ruled = with_rule(groups.withColumns({"host": host_of(member), "path": path_of(member)}), rules)
    blocked = ruled.where("_r.verdict = 'block'").select("component").distinct()
    tainted = groups.join(blocked, "component").select(F.col("node").alias("_node")).distinct().withColumn("_tainted", F.lit(True))
    url = F.col(url_col)
    own = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), canonical(url).alias("_node"))
    own = with_rule(own, rules)
    seen = skew_join(own, tainted, "_node", "left")
    return seen.select(
        id_col,
        "host",
        "path",
        F.col("_r.rule").alias("rule"),
        F.coalesce(F.col("_r.verdict"), F.when(F.col("_tainted"), F.lit("block")), F.lit(default)).alias("verdict"),
        F.when(F.col("_r").isNotNull(), "rule").when(F.col("_tainted"), "alias").otherwise("default").alias("source"),
    )


#: The rules of the registered query.
RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]

#: The rules alone: right wherever no page declares a canonical link or a refresh, as in the given tables.
#: The closure over aliases is tested against a brute-force version instead.
SQL = r"""
WITH rules(h, p, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
fit AS (SELECT page_id, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(h || p) DESC NULLS LAST) AS rn
        FROM u LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict, CASE WHEN rule IS NULL THEN 'default' ELSE 'rule' END AS source FROM fit WHERE rn = 1
"""
