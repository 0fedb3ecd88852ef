"""URL filters with redirect equivalence.

Fixed rules name hosts and path prefixes. Pages that redirect to one another or name one canonical address are
aliases: connected components over those links carry a block to aliases that no rule names. An explicit allow, on the
address itself or on an alias, goes before a carried block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import components
from florilege.session import cut_lineage

#: Fixed values: (verdict, host with path prefix), in no particular order.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: What is no markup of the page.
_UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<template\b.*?(?:</template\s*>|\z)"
_TAGS = r"(?is)<(?:link|meta)\b[^>]*>"
_IS_CANONICAL = r"(?is)^<link\b.*\brel\s*=\s*[\"']?canonical\b"
_IS_REFRESH = r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"
_HREF = r"(?is)\bhref\s*=\s*(?:\"\s*([^\"]*?)\s*\"|'\s*([^']*?)\s*'|([^\s\"'>]+))"
_GOES_TO = r"(?is)\bcontent\s*=\s*[\"']?[^\"'>]*?url\s*=\s*['\"]?\s*([^\"'>\s]+)"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without it."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), *_LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does. Give host and path as plain columns."""
    ordered = sorted(rules, key=lambda r: -len(r[1]))
    table = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.partition("/")[0]).alias("name"), F.lit("/" + r.partition("/")[2]).alias("prefix")) for v, r in ordered])
    fit = F.filter(table, lambda r: path.startswith(r["prefix"]) & F.concat(F.lit("."), host).endswith(F.concat(F.lit("."), r["name"])))
    return F.get(fit, 0)


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..``: the latter takes the segment before it away."""

    def step(acc: Column, part: Column) -> Column:
        up = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(1)))
        return F.when(part == ".", acc).when(part == "..", up).otherwise(F.concat(acc, F.array(part)))

    # a last segment of dots names a folder
    parts = F.split(F.regexp_replace(path, r"(/\.{1,2})$", "$1/"), "/", -1)
    kept = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step)
    return F.when(path.rlike(r"/\.{1,2}(?:/|$)"), F.array_join(kept, "/")).otherwise(path)


def address(url: Column) -> Column:
    """What a link is matched by: the address without its fragment and dot segments, scheme and host in lower case; null if
    relative."""
    part = lambda i: F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*://)([^/?#\s]*)([^?#\s]*)([^#\s]*)", i)
    root = F.translate(F.concat(part(1), part(2)), *_LOWER)
    path = F.when(part(3) == "", F.lit("/")).otherwise(without_dots(part(3)))
    return F.when(root != "", F.concat(root, path, part(4)))


def absolute(link: Column, base: Column) -> Column:
    """A link of a page with the address ``base``: absolute, host-relative, path-absolute or relative to its folder."""
    root = F.regexp_extract(base, r"^[^/]*//[^/]*", 0)
    return (
        F.when(link == "", None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^[^/]*", 0), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(F.regexp_extract(base, r"^[^?]*/", 0), link))
    )


def alias_links(pages: DataFrame) -> DataFrame:
    """(source, target): addresses of pages and of all that they refresh to or call canonical, from the whole html but its
    comments, scripts and styles."""
    some = pages.where(F.col("html").rlike("(?i)canonical|refresh")).select(address(F.col("url")).alias("source"), F.regexp_replace("html", _UNSEEN, " ").alias("html"))
    tags = some.where("source IS NOT NULL").select("source", F.explode(F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0))).alias("tag"))
    href = F.concat(*[F.regexp_extract("tag", _HREF, i) for i in (1, 2, 3)])
    link = F.when(F.col("tag").rlike(_IS_CANONICAL), href).when(F.col("tag").rlike(_IS_REFRESH), F.regexp_extract("tag", _GOES_TO, 1))
    # written once: the filters below would else be pushed under the expressions they look at, and repeat them
    links = cut_lineage(tags.select("source", link.alias("link"))).where("link <> ''")
    whole = cut_lineage(links.select("source", absolute(F.regexp_replace(F.trim("link"), "&amp;", "&"), F.col("source")).alias("link")))
    return cut_lineage(whole.select("source", address(F.col("link")).alias("target"))).where("target IS NOT NULL AND source <> target").distinct()


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_of) for every row of (page_id, url, html).

    A rule that fits the address decides. Else, if aliases are named by rules: allow where any of them is allowed, block
    where any is blocked. All else is allowed. alias_of: the smallest address of the component, null for pages
    without links. A null url or one without ``://`` has an empty host and path, no rule and no aliases. Equal rows
    have equal verdicts; other columns are not read.
    """
    links = alias_links(pages)
    groups = components(links.select(F.col("source").alias("a"), F.col("target").alias("b")))
    parts = groups.select("component", host_of(F.col("node")).alias("_host"), path_of(F.col("node")).alias("_path"))
    judged = parts.select("component", matched(F.col("_host"), F.col("_path"), rules)["verdict"].alias("_own"))
    has = lambda v: F.max(F.when(F.col("_own") == v, 1).otherwise(0))
    carried = judged.groupBy("component").agg(F.when(has("allow") == 1, "allow").when(has("block") == 1, "block").alias("_carried"))
    aliases = groups.join(carried, "component").select(F.col("node").alias("_node"), F.col("component").alias("alias_of"), "_carried")
    seen = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("_address"))
    ruled = seen.withColumn("_rule", matched(F.col("host"), F.col("path"), rules))
    both = ruled.join(aliases, F.col("_address") == F.col("_node"), "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.col("_carried"), F.lit("allow"))
    return both.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "alias_of")
