"""URL filters by redirect equivalence (operator 7), in DataFrame operations alone.

Rules block or allow a host with its subdomains, below a path; of those that fit a url, the longest
decides, and of two as long, the allowing one. Pages that point at another address by
<link rel="canonical"> or <meta http-equiv="refresh">, and pairs of a redirect table, make the two
addresses aliases; aliases of aliases are found as connected components. For a page that no rule
fits, if a rule allows one of its aliases, it is allowed (an explicit allow goes before a block);
else, if a rule blocks one of them, it is blocked; else it is allowed.

An address is a host and what follows it up to `#`; scheme and fragment don't count. A null url, or
one without `://`, has an empty host and path, fits no rule and has no alias. A null or empty html
has no links; links without a usable address are ignored. Rows with equal page_id or url are
judged alike; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written
from .components import components

#: (host, path, verdict)
Rule = tuple[str, str, str]
RULES: list[Rule] = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Rules up to which they are tried one by one in an expression; beyond, they are joined by host.
INLINE = 128
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """What tells addresses apart; null if there is no host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host_of(url) != "", F.concat(host_of(url), rest))


def judged(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df, which has host and path, with the columns rule and ruled (its verdict); null where none fits."""
    order = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow"))
    if len(order) <= INLINE:
        fits = lambda r: ((F.col("host") == r[0]) | F.col("host").endswith("." + r[0])) & F.col("path").startswith(r[1])
        pick = lambda value: reduce(lambda c, r: c.when(fits(r), F.lit(value(r))), order[1:], F.when(fits(order[0]), F.lit(value(order[0])))) if order else F.lit(None).cast("string")
        return df.withColumn("rule", pick(lambda r: r[0] + r[1])).withColumn("ruled", pick(lambda r: r[2]))
    known = df.sparkSession.createDataFrame([(h, p, h + p, v) for h, p, v in rules], "suffix string, start string, rule string, ruled string")
    kinds = df.select("host", "path").distinct()
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = kinds.withColumn("suffix", F.explode(suffixes)).join(known, "suffix").where(F.col("path").startswith(F.col("start")))
    best = found.groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), (F.col("ruled") == "allow").alias("a"), "rule", "ruled")).alias("best"))
    return df.join(best.select("host", "path", "best.rule", "best.ruled"), ["host", "path"], "left")


def page_links(pages: DataFrame) -> DataFrame:
    """u, v: the address of each page and those that its html names as its own."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    named = F.filter(tags, lambda t: t.rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b") | t.rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    found = pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", F.explode(named).alias("tag"))
    href = F.regexp_extract("tag", r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", 0)
    href = F.regexp_replace(F.regexp_replace(href, r"(?is)^href\s*=\s*", ""), "^[\"']|[\"']$", "")
    refresh = F.regexp_extract("tag", r"(?is)\burl\s*=\s*[\"']?([^\"'>\s]+)", 1)
    to = F.trim(F.regexp_replace(F.when(F.col("tag").rlike("(?i)^<link"), href).otherwise(refresh), "&amp;", "&"))
    # each step is a row of its own, lest the optimizer copies its expression into all that use it
    once = lambda c, name: F.explode(F.array(c)).alias(name)
    found = found.select("url", once(to, "to"))
    scheme = F.regexp_extract("url", r"(?s)^(.*?)://", 1)
    found = found.select("to", once(F.struct(scheme.alias("scheme"), host_of(F.col("url")).alias("host"), F.regexp_extract(path_of(F.col("url")), r"(?s)^(.*/)", 1).alias("folder"), address_of(F.col("url")).alias("u")), "from"))
    to, base = F.col("to"), F.concat("from.scheme", F.lit("://"), "from.host")
    whole = (
        F.when(to.contains("://"), to)
        .when(to.startswith("//"), F.concat("from.scheme", F.lit(":"), to))
        .when(to.startswith("/"), F.concat(base, to))
        .when((to != "") & ~to.startswith("#") & ~to.contains(":"), F.concat(base, F.when(F.col("from.folder") == "", F.lit("/")).otherwise(F.col("from.folder")), to))
    )
    found = found.select(F.col("from.u").alias("u"), once(whole, "whole"))
    return found.select("u", address_of(F.col("whole")).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v")


def filtered(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of each page; redirects: columns from_url and to_url."""
    pages = pages.select("page_id", "url", "html")
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(address_of(F.col("from_url")).alias("u"), address_of(F.col("to_url")).alias("v")).where("u IS NOT NULL AND v IS NOT NULL"))
    links = written(links.distinct(), "alias-links")
    roots = components(links)
    known = judged(roots.withColumn("host", host_of(F.concat(F.lit("x://"), "node"))).withColumn("path", path_of(F.concat(F.lit("x://"), "node"))), rules)
    by_root = known.groupBy("root").agg(F.max(F.col("ruled") == "allow").alias("allows"), F.max(F.col("ruled") == "block").alias("blocks"))
    aliases = roots.join(by_root, "root").select(F.col("node").alias("address"), F.when(F.col("allows"), "allow").when(F.col("blocks"), "block").alias("inherited")).where("inherited IS NOT NULL")
    rows = judged(pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address_of(F.col("url")).alias("address")), rules)
    out = rows.join(aliases, "address", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "inherited", F.lit("allow")).alias("verdict"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages"), RULES)
