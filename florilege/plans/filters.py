"""Registered filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.functions import text as X
from florilege.functions import urls as U
from florilege.operators import filters as B
from florilege.operators.joins import about_entity
from florilege.plans.joins import catalogue
from florilege.plans.registry import Tables, query
from florilege.plans.sequences import ntz
from florilege.plans.standins import cte, standin
from florilege.plans.text_functions import norm_sql

ITEMS_SQL = """items AS (SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'recipe' WHEN n_chars % 3 = 1 THEN 'fact' ELSE 'other' END AS kind, CASE WHEN toxic = 1 THEN 'skipped' WHEN quality = 1 THEN 'approved' ELSE 'raw' END AS status, source,
CASE WHEN n_chars % 7 = 0 THEN doc_id - 1 END AS duplicate_of, split_part(text, ' ', 1) AS title, 'https://' || source || '.example/' || doc_id AS url, text, lang FROM documents LEFT JOIN labels USING (doc_id))"""


def items(t: Tables):
    d = t.documents.join(t.labels, "doc_id", "left")
    return d.select(
        "doc_id",
        F.when(F.col("n_chars") % 3 == 0, "recipe").when(F.col("n_chars") % 3 == 1, "fact").otherwise("other").alias("kind"),
        F.when(F.col("toxic") == 1, "skipped").when(F.col("quality") == 1, "approved").otherwise("raw").alias("status"),
        "source",
        F.when(F.col("n_chars") % 7 == 0, F.col("doc_id") - 1).alias("duplicate_of"),
        F.substring_index("text", " ", 1).alias("title"),
        F.concat(F.lit("https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string")).alias("url"),
        "text",
        "lang",
    )


@query("item_filter", f"WITH {ITEMS_SQL} SELECT doc_id, kind, url FROM items WHERE duplicate_of IS NULL AND kind IN ('recipe', 'fact') AND status = 'approved' AND (contains(title, 'th') OR contains(url, 'src1'))")
def item_filter(t: Tables):
    return B.item_filter(items(t), kinds=["recipe", "fact"], status="approved", q="src1").unionByName(
        B.item_filter(items(t), kinds=["recipe", "fact"], status="approved", q="th").filter(~F.contains("url", F.lit("src1")))
    ).select("doc_id", "kind", "url")


SITES_SQL = r"""(SELECT page_id AS site, regexp_extract(url, '//([^/?#]*)', 1) AS domain, regexp_extract(url, '//[^/]*/([a-z]{2})/', 1) AS country, CASE WHEN contains(url, '?') THEN 'found' ELSE 'verified' END AS status, length(html) % 1000 AS score FROM pages)"""


def sites(t: Tables):
    return t.pages.select(
        F.col("page_id").alias("site"), F.regexp_extract("url", "//([^/?#]*)", 1).alias("domain"), F.regexp_extract("url", "//[^/]*/([a-z]{2})/", 1).alias("country"),
        F.when(F.contains("url", F.lit("?")), "found").otherwise("verified").alias("status"), (F.length("html") % 1000).alias("score"),
    )


@query("site_filter", f"SELECT site, domain, score FROM {SITES_SQL} WHERE country = 'en' AND status = 'verified' AND contains(domain, 'th') ORDER BY score DESC, site LIMIT 200")
def site_filter(t: Tables):
    return B.site_filter(sites(t), "en", "verified", "TH").select("site", "domain", "score")


@query(
    "entity_browse",
    "SELECT p_partkey AS entity, p_name AS name FROM part WHERE p_type = 'PROMO' AND p_name ILIKE '%ring%' AND p_size <= 20",
)
def entity_browse(t: Tables):
    e = t.part.select(F.col("p_partkey").alias("entity"), F.col("p_name").alias("name"), F.col("p_type").alias("origin"), F.col("p_size").alias("coverage"), "p_size")
    e = B.missing_slots(e, {"size": F.col("p_size") > 20, "name": F.col("name").isNotNull()})
    return B.entity_browse(e, "PROMO", "RING", "size", True).select("entity", "name")


@query("unenriched_filter", "SELECT event_id FROM events WHERE event_type = 'view' OR event_type <> 'click'")
def unenriched_filter(t: Tables):
    how = F.when(F.col("event_type") == "click", F.lit("rules-v2")).when(F.col("event_type") == "error", F.lit("model"))
    raw = F.to_json(F.struct(F.struct(how.alias("jak")).alias("opracowanie"), "value"))
    return B.unenriched(t.events.withColumn("raw", raw), "raw", "$.opracowanie.jak", "rules").select("event_id")


@query("still_pending_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def still_pending_filter(t: Tables):
    chosen = t.lineitem.filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return B.still_pending(t.orders, "o_orderkey", chosen, "o_orderstatus", "O").select("o_orderkey")


@query("unscanned_facts", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL ORDER BY doc_id DESC LIMIT 100")
def unscanned_facts(t: Tables):
    return B.unscanned(t.documents.join(t.labels, "doc_id", "left"), "text", "quality", "doc_id", 100).select("doc_id")


@query("recheck_filter", f"WITH {ITEMS_SQL} SELECT doc_id FROM items WHERE status = 'skipped' AND lang IN ('en', 'de')")
def recheck_filter(t: Tables):
    method = F.when(F.col("lang") == "en", "nn:page_kind:v3").when(F.col("lang") == "de", "deferred").otherwise("rules")
    return B.recheck_due(items(t).withColumn("method", method), "status", "method", "nn:page_kind", "deferred").select("doc_id")


@query(
    "prediction_review_filter",
    cte("decisions") + " SELECT ref, confidence FROM decisions WHERE task = 'task1' AND known AND predicted <> label UNION ALL SELECT ref, confidence FROM decisions WHERE task = 'task2' AND length(source) = 5",
)
def prediction_review_filter(t: Tables):
    log = standin(t, "decisions").select(
        "ref", "task", "decision", "confidence", F.when(F.col("known"), F.col("predicted") == F.col("label")).alias("agree"), F.when(F.length("source") == 4, F.col("label")).alias("human_label")
    )
    a = B.prediction_review(log, "task1", "disagreement", False, "ref").select("ref", "confidence")
    return a.unionByName(B.prediction_review(log, "task2", "uncertain", True, "ref").select("ref", "confidence"))


@query(
    "url_skip_filter",
    r"""SELECT page_id FROM pages WHERE NOT (regexp_matches(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '\.(jpg|pdf|css|js|xml|rss|json)$') OR regexp_matches(lower(url), 'login|cart|account|/feed|/search|privacy|cookie|terms|register|share=|print='))""",
)
def url_skip_filter(t: Tables):
    return t.pages.filter(~U.should_skip(F.col("url"))).select("page_id")


@query(
    "domain_block_filter",
    r"""SELECT page_id FROM (SELECT page_id, regexp_extract(url, '//([^/?#]*)', 1) AS h FROM pages) WHERE NOT (h = 'spam-farm.example.org' OR h LIKE '%.spam-farm.example.org' OR h LIKE '%.example.net' OR h = 'example.net')""",
)
def domain_block_filter(t: Tables):
    blocked = t.spark.createDataFrame([("spam-farm.example.org",), ("example.net",)], "domain string")
    rows = t.pages.select("page_id", U.netloc(F.col("url")).alias("domain")).filter(~U.is_blocked(F.col("domain")))
    return B.blocked_domains(rows, "domain", blocked).select("page_id")


@query(
    "about_entity_filter",
    f"""WITH n AS (SELECT item_id AS entity, {norm_sql("array_to_string(regexp_split_to_array(text, '\\s+')[1:2], ' ')")} AS nm, split_part({norm_sql("array_to_string(regexp_split_to_array(text, '\\s+')[3:4], ' ')")}, ' ', 1) AS genus FROM benchmark),
    d AS (SELECT doc_id, ' ' || {norm_sql('text')} || ' ' AS t FROM documents), l AS (SELECT *, list_filter(string_split(nm, ' '), lambda w: length(w) >= 4) AS ws FROM n)
    SELECT doc_id, entity FROM d, l WHERE (length(genus) >= 4 AND contains(t, ' ' || genus)) OR contains(t, nm) OR (len(ws) >= 1 AND len(list_filter(ws, lambda w: contains(t, ' ' || w[1:5]))) >= greatest(1, len(ws) - 1))""",
)
def about_entity_filter(t: Tables):
    from florilege.operators.joins import word_prefixes, word_substrings
    from florilege.session import written

    c = catalogue(t)
    genus = F.substring_index(X.norm_text(F.col("latin")), " ", 1)
    heads = F.array_append(F.transform(F.filter(X.words(F.col("name")), lambda w: F.length(w) >= 4), lambda w: F.left(w, F.lit(5))), genus)
    pieces = c.select("entity", F.explode(heads).alias("piece"))
    whole = c.select("entity", F.substring_index(X.norm_text(F.col("name")), " ", 1).alias("piece"))
    # texts are brought into normal form once
    texts = written(t.documents.select("doc_id", X.norm_text(F.col("text")).alias("n")), "normal")
    near = word_prefixes(texts, "doc_id", F.col("n"), pieces, normal=True).join(pieces, "piece").select("doc_id", "entity")
    inside = word_substrings(texts, "doc_id", F.col("n"), whole).join(whole, "piece").select("doc_id", "entity")
    names = c.select("entity", X.norm_text(F.col("latin")).alias("la"), X.norm_text(F.col("name")).alias("nm"))
    pairs = near.unionByName(inside).distinct().join(texts, "doc_id").join(names, "entity")
    return pairs.filter(about_entity(F.col("n"), F.col("la"), F.col("nm"))).select("doc_id", "entity")


@query(
    "topic_relevance_filter",
    """WITH s AS (SELECT doc_id, lower(text) AS l FROM documents), h AS (SELECT doc_id, contains(l, 'thand') OR contains(l, 'eau') AS named, CASE WHEN contains(l, 'tion') THEN 1 ELSE 0 END + CASE WHEN contains(l, 'elle') THEN 1 ELSE 0 END + CASE WHEN contains(l, 'ing') THEN 1 ELSE 0 END AS n FROM s)
    SELECT doc_id, CASE WHEN NOT named THEN 'no_name' WHEN n < 2 THEN 'too_little:' || n ELSE 'topic:' || n END AS reason FROM h""",
)
def topic_relevance_filter(t: Tables):
    return t.documents.select("doc_id", B.topic_filter(F.col("text"), ["thand", "eau"], ["tion", "elle", "ing"], 2).alias("reason"))


@query(
    "media_filter",
    r"""SELECT page_id FROM pages WHERE length(html) % 5 <> 0 AND length(html) >= 3000 AND length(html) % 4 <> 1 AND contains(url, 'https') AND NOT contains(lower(url), 'blog')""",
)
def media_filter(t: Tables):
    n = F.length("html")
    rows = t.pages.select(
        "page_id", F.when(n % 5 == 0, "image/svg+xml").otherwise("image/jpeg").alias("mime"), n.alias("width"), F.when(n % 4 == 1, "CC BY-NC 4.0").otherwise("CC BY-SA 4.0").alias("licence"),
        U.scheme(F.col("url")).alias("host"), F.col("url").alias("title"),
    )
    return B.media_filter(rows, ["https"], ["blog"], 3000).select("page_id")


@query(
    "palette_filter",
    f"""WITH {ITEMS_SQL} SELECT doc_id FROM items WHERE status = 'approved' AND length(text) BETWEEN 80 AND 3000 AND regexp_matches({norm_sql('text')}, 'tion')""",
)
def palette_filter(t: Tables):
    status = F.when(F.col("status") == "approved", "verified").otherwise("new")
    return items(t).filter(B.palette_fits(F.col("text"), status, F.col("url"), "tion", "elle", 80, 3000)).select("doc_id")


@query("profile_recheck", f"WITH {ITEMS_SQL} SELECT doc_id, CASE WHEN status <> 'skipped' AND kind = 'other' THEN 'skipped' ELSE status END AS status, CASE WHEN status <> 'skipped' AND kind = 'other' THEN 'off topic: other' ELSE '' END AS reason FROM items")
def profile_recheck(t: Tables):
    rows = items(t).withColumn("reason", F.lit(""))
    out = B.profile_recheck(rows, "status", "reason", F.col("kind") == "other", F.concat(F.lit("off topic: "), F.col("kind")), ["raw", "approved"])
    return out.select("doc_id", "status", "reason")


@query("pause_filter", "SELECT event_id FROM events WHERE ts + to_days(CAST(user_id % 5 AS INT)) > TIMESTAMP '2024-01-31 00:00:00'")
def pause_filter(t: Tables):
    rows = t.events.withColumn("until", F.col("ts") + F.make_dt_interval((F.col("user_id") % 5).cast("int")))
    return B.paused(rows, "until", ntz("2024-01-31 00:00:00")).select("event_id")


@query(
    "stale_review_filter",
    f"""WITH h AS (SELECT conv_id, turn, substr(sha1({norm_sql('text')}), 1, 16) AS h FROM conversations), c AS (SELECT conv_id, max_by(h, turn) AS cur FROM h GROUP BY 1), r AS (SELECT conv_id, max_by(h, turn) AS rev FROM h WHERE turn <= 3 GROUP BY 1)
    SELECT c.conv_id FROM c LEFT JOIN r USING (conv_id) WHERE rev IS NULL OR rev <> cur""",
)
def stale_review_filter(t: Tables):
    current = t.conversations.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))
    reviews = t.conversations.filter("turn <= 3").groupBy("conv_id").agg(F.max_by("text", "turn").alias("text")).select("conv_id", X.text_hash(F.col("text")).alias("reviewed_hash"))
    return B.stale_reviews(current, "conv_id", X.text_hash(F.col("text")), reviews).select("conv_id")


def documents_json(t: Tables):
    """Parts as JSON documents of changing layout."""
    none = F.lit(None).cast("array<string>")
    facts = F.when(F.col("p_size") > 10, F.array("p_name", "p_type"))
    doc = F.to_json(
        F.struct(
            F.when(F.col("p_size") % 6 != 0, F.col("p_partkey").cast("string")).alias("id"), F.when(F.col("p_size") % 4 == 0, F.col("p_name")).alias("gatunek"),
            F.when(F.col("p_size") % 5 == 0, F.array("p_brand")).otherwise(none).alias("zdjecia"),
            F.struct(facts.alias("fakty"), F.when(F.col("p_size") > 25, F.array("p_type")).otherwise(none).alias("sekcje")).alias("wiedza"),
            F.when(F.col("p_size") > 40, F.lit("yes")).alias("scalone"),
        )
    )
    return t.part.select(F.col("p_partkey").alias("entity"), F.try_parse_json(doc).alias("doc"))


@query("nonstandard_layout_filter", "SELECT p_partkey AS entity FROM part WHERE p_size % 6 = 0 AND p_size % 4 = 0")
def nonstandard_layout_filter(t: Tables):
    return B.odd_layout(documents_json(t), "doc").select("entity")


@query("names_due_filter", "SELECT c_custkey FROM customer WHERE c_mktsegment <> 'FURNITURE' AND (c_nationkey % 3 = 0 OR c_acctbal < 0 OR c_acctbal < 5000) ORDER BY c_nationkey > 10, c_custkey LIMIT 500")
def names_due_filter(t: Tables):
    c = t.customer.select("c_custkey", "c_nationkey", F.when(F.col("c_mktsegment") == "FURNITURE", "-").otherwise(F.col("c_name")).alias("latin"), F.col("c_acctbal").alias("checked"), F.when(F.col("c_nationkey") % 3 != 0, "x").alias("names"))
    return B.names_due(c, "latin", "checked", "names", F.lit(5000), F.col("c_nationkey") <= 10, "c_custkey", 500).select("c_custkey")


@query("document_state_filters", "SELECT p_partkey AS entity, p_size % 5 <> 0 AS no_gallery, p_size > 10 AND p_size <= 25 AS unorganized, p_size > 25 AND p_size <= 40 AS unmerged, CASE WHEN p_size > 10 THEN 2 ELSE 0 END AS facts FROM part")
def document_state_filters(t: Tables):
    return B.document_states(documents_json(t), "entity", "doc")


@query("blocked_run_filter", "SELECT event_id FROM events WHERE user_id % 3 > 0 AND value < 40 AND user_id % 2 = 0")
def blocked_run_filter(t: Tables):
    stats = F.to_json(F.struct((F.col("user_id") % 3).cast("int").alias("refused"), F.when(F.col("value") >= 40, 1).otherwise(0).alias("applied"), F.when(F.col("user_id") % 2 == 1, 2).alias("merged")))
    return B.blocked_runs(t.events.withColumn("stats", stats), "stats", "refused", ["applied", "merged"]).select("event_id")


@query("open_conflicts", cte("decisions") + " SELECT ref, count(*) OVER () AS total FROM decisions WHERE decision = 'defer' AND length(source) = 4 ORDER BY ref DESC LIMIT 100")
def open_conflicts(t: Tables):
    log = standin(t, "decisions").select("ref", F.when(F.col("decision") == "defer", "conflict").otherwise("ok").alias("decision"), F.when(F.length("source") != 4, F.col("label")).alias("human_label"))
    return B.open_conflicts(log, "ref", 100).select("ref", "total")


@query("bulk_status_update", f"WITH {ITEMS_SQL} SELECT doc_id, CASE WHEN source = 'src2' AND kind <> 'other' THEN 'exported' ELSE status END AS status FROM items")
def bulk_status_update(t: Tables):
    return B.bulk_status(items(t), F.col("source") == "src2", "status", "exported", F.col("kind") != "other").select("doc_id", "status")


@query("task_list_filter", "SELECT o_orderkey, count(*) OVER () AS total FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '5-LOW' ORDER BY o_orderkey DESC LIMIT 40 OFFSET 40")
def task_list_filter(t: Tables):
    return B.task_list(t.orders, {"o_orderstatus": "O", "o_orderpriority": "5-LOW", "agent": None}, "o_orderkey", 2, 40).select("o_orderkey", "total")


@query("idea_views", f"WITH {ITEMS_SQL} SELECT doc_id, 'pool' AS view FROM items WHERE status <> 'skipped' AND kind <> 'fact' AND duplicate_of IS NULL UNION ALL SELECT doc_id, 'used' FROM items WHERE duplicate_of IS NOT NULL")
def idea_views(t: Tables):
    ideas = items(t).select("doc_id", F.when(F.col("status") == "skipped", "rejected").otherwise("rated").alias("status"), (F.col("kind") == "fact").alias("risky"), F.col("duplicate_of").isNotNull().alias("used"))
    pool, used = (B.idea_view(ideas, v).select("doc_id", F.lit(v).alias("view")) for v in ("pool", "used"))
    return pool.unionByName(used)
