"""Address expressions: normal form, site, domain, pattern and tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from florilege.functions import rules


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query_text(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def absolute(url: Column, base: Column) -> Column:
    """A link resolved against the page it stands on."""
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    folder = F.concat(root, F.coalesce(F.nullif(F.regexp_extract(path(base), r"^(.*/)", 1), F.lit("")), F.lit("/")))
    return (
        F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), url)
        .when(url.startswith("//"), F.concat(scheme(base), F.lit(":"), url))
        .when(url.startswith("/"), F.concat(root, url))
        .when(url.startswith("?"), F.concat(root, path(base), url))
        .when(url.startswith("#") | (url == ""), base)
        .otherwise(F.concat(folder, url))
    )


def normalize_url(url: Column) -> Column:
    """Lower-case host, no fragment, no tracking parameters; NULL when not http."""
    tracking = "(?i)^(" + "|".join(rules.TRACKING_PREFIXES) + ")"
    pairs = F.filter(F.split(query_text(url), "&"), lambda p: p.rlike("^[^=]+=.+") & ~p.rlike(tracking))
    query = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise("")
    place = F.coalesce(F.nullif(path(url), F.lit("")), F.lit("/"))
    whole = F.concat(scheme(url), F.lit("://"), netloc(url), place, query)
    return F.when(scheme(url).isin("http", "https") & (netloc(url) != ""), whole)


def site_key(url: Column) -> Column:
    return F.regexp_replace(netloc(url), r"^www\.", "")


def registrable_domain(url_or_host: Column) -> Column:
    """The domain someone can register: two labels, three under a known two-part suffix."""
    host = F.when(F.contains(url_or_host, F.lit("//")), netloc(url_or_host)).otherwise(F.lower(url_or_host))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":.*$", ""), r"^\.+|\.+$", "")
    last_two = F.substring_index(host, ".", -2)
    return F.when(~F.contains(host, F.lit(".")), F.lit(None)).when(last_two.isin(*rules.MULTI_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(last_two)


def is_blocked(domain: Column) -> Column:
    """No domain, a listed one or below it, or a listed base name."""
    listed = domain.rlike(r"(^|\.)(" + "|".join(d.replace(".", r"\.") for d in rules.BLOCKED_DOMAINS) + ")$")
    base = F.substring_index(domain, ".", 1).isin(*rules.BLOCKED_BASES)
    return F.coalesce(domain, F.lit("")).isin("") | F.coalesce(listed | base, F.lit(False))


def should_skip(url: Column) -> Column:
    """Assets and parts of a site that hold no content."""
    low = F.lower(url)
    asset = path(low).rlike("(" + "|".join(e.replace(".", r"\.") for e in rules.ASSET_ENDINGS) + ")$")
    never = low.rlike("|".join(w.replace("?", r"\?") for w in rules.NEVER_VISIT))
    return asset | never


def url_pattern(url: Column) -> Column:
    """Path with numbers, ids and slugs replaced by what they are."""
    clean = F.regexp_replace(path(url), "^/+|/+$", "")
    parts = F.split(F.lower(clean), "/")

    def shape(seg: Column, i: Column) -> Column:
        marks = F.length(seg) - F.length(F.translate(seg, "-_", ""))
        slug = (marks >= 1) & ((marks >= 2) | (i == F.size(parts) - 1))
        return F.when(seg.rlike(r"^\d+$"), "{n}").when(seg.rlike(r"(?U)^[\w-]*\d{3,}[\w-]*$") | (F.length(seg) > 40), "{id}").when(slug, "{slug}").otherwise(seg)

    return F.when(clean == "", "/").otherwise(F.concat(F.lit("/"), F.array_join(F.transform(parts, shape), "/")))


def url_tokens(url: Column, anchor: Column | None = None) -> Column:
    """Words of path and anchor, a mark for a query, and the depth."""
    decoded = F.lower(F.coalesce(F.try_url_decode(F.replace(path(url), F.lit("+"), F.lit("%2B"))), path(url)))
    text = decoded if anchor is None else F.concat_ws(" ", decoded, F.lower(anchor))
    w = F.filter(F.split(text, r"(?U)[^\w]+|_"), lambda x: (F.length(x) >= 3) & ~x.rlike(r"^\d+$"))
    clean = F.regexp_replace(path(url), "^/+|/+$", "")
    depth = F.least(F.lit(4), F.length(clean) - F.length(F.replace(clean, F.lit("/"), F.lit(""))) + 1)
    extra = F.array_compact(F.array(F.when(query_text(url) != "", "?query"), F.concat(F.lit("#depth"), depth.cast("string"))))
    return F.concat(w, extra)


def keyword_score(url: Column, anchor: Column, keywords: Sequence[str]) -> Column:
    """Half a point per keyword in path or anchor, one at most."""
    hay = F.lower(F.concat_ws(" ", path(url), anchor))
    found = F.size(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(hay, k)))
    return F.least(F.lit(1.0), found / 2)


def url_priority(url: Column, anchor: Column, depth: Column, productivity: Column, hub: Column, keywords: Sequence[str], from_sitemap: Column) -> Column:
    """Weighted priority of an address; listing pages without hub value lose some."""
    prod, value = F.coalesce(productivity, F.lit(0.5)), F.coalesce(hub, F.lit(0.0))
    listing = F.lower(url).rlike("|".join(rules.HUB_HINTS)) & (value == 0)
    score = 0.45 * prod + 0.35 * keyword_score(url, anchor, keywords) + 0.2 / (1 + depth) + 0.25 * value
    score = score + F.when(from_sitemap, 0.05).otherwise(0.0) - F.when(listing, 0.15).otherwise(0.0)
    return F.round(score, 4)


def site_root(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url), F.lit("/"))


def media_title(name: Column) -> Column:
    """File title from a local name; only raster images."""
    base = F.replace(F.trim(F.regexp_replace(name, "^[^:]*:", "")), F.lit("_"), F.lit(" "))
    title = F.concat(F.lit("File:"), F.upper(F.left(base, F.lit(1))), F.substring(base, 2, 10000))
    return F.when(base.rlike(r"(?i)\.(jpe?g|png|webp|tiff?)$"), title)
