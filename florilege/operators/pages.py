"""Site-wide page rules: boilerplate, cleaning, novelty, address statistics and a naive Bayes over addresses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions import rules
from florilege.functions import text as X
from florilege.functions.urls import url_priority
from florilege.operators.primitives import count_where, top_per_key


def site_boilerplate(
    pages: DataFrame, page: str, site: str, text: str, last: int = 40, least_pages: int = rules.SITE_MIN_PAGES, share: float = rules.SITE_SHARE
) -> DataFrame:
    """Keys of short lines that repeat on many of the last pages of a site, as rows."""
    recent = top_per_key(pages.filter(F.col(text) != "").select(page, site, text), [site], [F.desc(page)], last)
    sizes = recent.groupBy(site).agg(F.count("*").alias("pages"))
    short = F.filter(X.lines(F.col(text)), lambda x: F.length(F.trim(x)).between(1, rules.SHORT_LINE))
    keys = recent.select(site, page, F.explode(F.array_distinct(F.transform(short, X.line_key))).alias("key")).filter("key <> ''")
    n = keys.groupBy(site, "key").agg(F.count("*").alias("n")).join(sizes, site)
    need = F.greatest(F.lit(least_pages), F.floor(F.lit(share) * F.col("pages") + 0.999).cast("int"))
    return n.filter((F.col("pages") >= least_pages) & (F.col("n") >= need)).select(site, "key", "n")


def clean_pages(pages: DataFrame, page: str, site: str, text: str, last: int = 40) -> DataFrame:
    """Page texts without noise, site boilerplate, repeats and tables of contents.

    Boilerplate comes from the last pages of a site, so its list per site is short.
    """
    known = site_boilerplate(pages, page, site, text, last).groupBy(site).agg(F.collect_list("key").alias("_known"))
    marked = pages.join(known, site, "left").withColumn("_m", X.marked_lines(F.col(text), F.col("_known")))
    return marked.select(page, site, X.clean_text(F.col("_m")).alias("clean"))


def new_paragraphs(pages: DataFrame, keys: Sequence[str], text: str, seen: DataFrame, names: Column | None = None, least: int = 200) -> DataFrame:
    """Paragraphs not read before, what to remember, and why nothing is new.

    ``seen`` holds per key the hashes read before. With ``names`` only paragraphs that name the entity and the one
    after each count. Too little new text waits for more.
    """
    none = F.array().cast("array<string>")
    p = pages.join(seen, list(keys), "left").withColumn("_p", X.paragraphs(F.col(text)))
    p = p.withColumn("_old", F.coalesce("seen", none))

    def mark(x: Column) -> Column:
        def judged(hash_: Column) -> Column:
            fresh = ~F.array_contains(F.col("_old"), hash_)
            hit = F.lit(True) if names is None else X.let(F.lower(x), lambda low: F.exists(names, lambda n: F.contains(low, n)))
            return F.struct(hash_.alias("hash"), fresh.alias("fresh"), (fresh & hit).alias("hit"), x.alias("text"))

        return X.let(X.text_hash(x), judged)

    p = p.withColumn("_m", F.transform("_p", mark))
    before = F.slice(F.concat(F.array(F.lit(None)), F.col("_m")), 1, F.size("_m"))
    kept = F.zip_with("_m", before, lambda e, b: F.struct(e["hash"].alias("hash"), e["fresh"].alias("fresh"), (e["fresh"] & (e["hit"] | F.coalesce(b["hit"], F.lit(False)))).alias("keep"), e["text"].alias("text")))
    p = p.withColumn("_k", kept)
    chosen = F.array_join(F.transform(F.filter("_k", lambda e: e["keep"]), lambda e: e["text"]), "\n\n")
    p = p.withColumn("_c", chosen)
    enough = F.length("_c") >= F.when(X.is_cjk(F.col("_c")), least // 3).otherwise(least)
    done = F.transform(F.filter("_k", lambda e: ~e["fresh"] | ~e["keep"] | F.col("_enough")), lambda e: e["hash"])
    p = p.withColumn("_enough", enough)
    total, fresh = F.size("_k"), F.size(F.filter("_k", lambda e: e["fresh"]))
    off = F.size(F.filter("_k", lambda e: e["fresh"] & ~e["keep"]))
    why = (
        F.when(total == 0, "empty").when(fresh == 0, "unchanged").when(~F.col("_enough") & (off > 0), "off_topic").when(~F.col("_enough"), "too_little")
    )
    return p.select(*keys, F.when(F.col("_enough"), F.col("_c")).otherwise("").alias("new_text"), done.alias("remember"), total.alias("total"), (total - fresh).alias("seen_before"), off.alias("off_topic"), why.alias("skip"))


def rank_frontier(links: DataFrame, stats: DataFrame, site: str, keywords: Sequence[str], limit: int | None = None, extra: Column | None = None) -> DataFrame:
    """Addresses to visit next: priority from pattern statistics, keywords and depth; dead patterns are left out.

    All are returned; with ``limit`` the first ones by priority.
    """
    s = stats.select(site, "pattern", "productivity", "hub_value", "dead")
    j = links.join(s, [site, "pattern"], "left").filter(~F.coalesce("dead", F.lit(False)))
    score = url_priority(F.col("url"), F.col("anchor"), F.col("depth"), F.col("productivity"), F.col("hub_value"), keywords, F.col("from_sitemap"))
    scored = j.withColumn("priority", F.round(score + (extra if extra is not None else F.lit(0.0)), 4))
    return scored if limit is None else scored.orderBy(F.desc("priority"), "url").limit(limit)


def best_patterns(stats: DataFrame, k: int) -> DataFrame:
    """Patterns with hits by productivity, then hits."""
    return stats.filter("hits > 0").orderBy(F.desc("productivity"), F.desc("hits"), "pattern").limit(k)


def url_bayes(train: DataFrame, site: str, tokens: str, useful: Column, least: int = 30, least_class: int = 5) -> tuple[DataFrame, DataFrame]:
    """Per-site word counts of useful and useless addresses with add-one smoothing.

    Returns the weights ``(site, token, weight)`` and per site the prior and the weight of an unseen word; sites
    with too few rows have no model.
    """
    rows = train.select(site, useful.alias("_u"), F.array_distinct(tokens).alias("_t"))
    classes = rows.groupBy(site).agg(count_where(F.col("_u")).alias("n_pos"), count_where(~F.col("_u")).alias("n_neg"))
    classes = classes.filter((F.col("n_pos") + F.col("n_neg") >= least) & (F.col("n_pos") >= least_class) & (F.col("n_neg") >= least_class))
    n = rows.select(site, "_u", F.explode("_t").alias("token")).groupBy(site, "token").agg(count_where(F.col("_u")).alias("pos"), count_where(~F.col("_u")).alias("neg"))
    totals = n.groupBy(site).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"), F.count("*").alias("vocab"))
    model = classes.join(totals, site)
    up, down = F.col("all_pos") + F.col("vocab"), F.col("all_neg") + F.col("vocab")

    def weight(pos: Column, neg: Column) -> Column:
        return F.log((pos + 1) / up) - F.log((neg + 1) / down)

    priors = model.select(site, F.log(F.col("n_pos") / F.col("n_neg")).alias("prior"), weight(F.lit(0), F.lit(0)).alias("unseen"))
    weights = n.join(model.drop("vocab").join(totals.select(site, "vocab"), site), site).select(site, "token", weight(F.col("pos"), F.col("neg")).alias("weight"))
    return weights, priors


def url_bayes_score(rows: DataFrame, row: str, site: str, tokens: str, weights: DataFrame, priors: DataFrame) -> DataFrame:
    """Probability that an address is useful, and its bonus between -0.3 and 0.3."""
    each = rows.select(row, site, F.explode(F.array_distinct(tokens)).alias("token")).join(priors, site)
    j = each.join(weights, [site, "token"], "left")
    sums = j.groupBy(row).agg((F.max("prior") + F.sum(F.coalesce("weight", "unseen"))).alias("_z"))
    p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("_z")))))
    return sums.select(row, F.round(p, 6).alias("probability"), F.round(0.6 * (p - 0.5), 4).alias("bonus"))
