"""Registered queries over pages, quotes and versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.functions import amounts, arrow
from florilege.functions import text as X
from florilege.functions import urls as U
from florilege.operators import aggregates as A
from florilege.operators import pages as P
from florilege.operators import quotes as Q
from florilege.operators import versions as V
from florilege.plans.registry import Tables, query
from florilege.plans.sequences import ntz
from florilege.plans.standins import cte, standin
from florilege.plans.text_functions import PATTERN_SQL, TOKENS_SQL, norm_sql, stems_sql


@query(
    "site_boilerplate",
    r"""WITH r AS (SELECT doc_id, source, text FROM documents WHERE text <> '' QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 40), z AS (SELECT source, count(*) AS pages FROM r GROUP BY 1),
    k AS (SELECT DISTINCT source, doc_id, trim(regexp_replace(lower(l), '[^\p{L}\p{N}_]+', ' ', 'g')) AS key FROM (SELECT source, doc_id, unnest(regexp_split_to_array(text, '\r\n|\r|\n')) AS l FROM r) WHERE length(trim(l)) BETWEEN 1 AND 90)
    SELECT k.source, key, count(*) AS n FROM k JOIN z ON z.source = k.source WHERE key <> '' AND pages >= 2 GROUP BY k.source, key, pages HAVING count(*) >= greatest(2, CAST(floor(0.05 * pages + 0.999) AS INT))""",
)
def site_boilerplate(t: Tables):
    return P.site_boilerplate(t.documents, "doc_id", "source", "text", least_pages=2, share=0.05)


@query("clean_text")
def clean_text(t: Tables):
    return P.clean_pages(t.documents, "doc_id", "source", "text").select("doc_id", F.length("clean").alias("chars"), X.text_hash(F.col("clean")).alias("hash"))


@query("toc_run_removal")
def toc_run_removal(t: Tables):
    """Lines dropped from each document without any site knowledge."""
    m = t.documents.withColumn("m", X.marked_lines(F.col("text")))
    return m.select("doc_id", F.size("m").alias("lines"), F.size(X.lines(X.clean_text(F.col("m")))).alias("kept"))


@query("new_paragraphs")
def new_paragraphs(t: Tables):
    """Second reading of each document after one that ended half way."""
    half = F.left("text", F.floor(F.length("text") / 2).cast("int"))
    first = t.documents.select("doc_id", "source", F.transform(X.paragraphs(half), X.text_hash).alias("seen"))
    n = P.new_paragraphs(t.documents, ["source", "doc_id"], "text", first, F.array(F.lit("the"), F.lit("que"), F.lit("die")))
    return n.select("doc_id", F.length("new_text").alias("chars"), F.size("remember").alias("remember"), "total", "seen_before", "off_topic", "skip")


QUOTE_SQL = f"""q AS MATERIALIZED (SELECT item_id, {norm_sql('text')} AS q FROM benchmark), d AS MATERIALIZED (SELECT doc_id, {norm_sql('text')} AS t FROM documents),
g AS MATERIALIZED (SELECT item_id, q, list_transform(range(1, greatest(len(string_split(q, ' ')) - 1, 1)), lambda i: array_to_string(string_split(q, ' ')[i:i + 2], ' ')) AS grams FROM q),
s AS (SELECT item_id, doc_id, CASE WHEN length(q) < 12 THEN 0 WHEN contains(t, q) THEN 1 WHEN len(string_split(q, ' ')) < 4 THEN 0 ELSE len(list_filter(grams, lambda x: contains(t, x))) / len(grams) END AS share FROM g, d)"""


@query("quote_in_text", f"WITH {QUOTE_SQL} SELECT item_id, doc_id, round(share, 6) AS share FROM s WHERE share >= 0.8")
def quote_in_text(t: Tables):
    return Q.quotes_in_texts(t.benchmark, "item_id", "text", t.documents, "doc_id", "text")


@query("snap_quote")
def snap_quote(t: Tables):
    """Exact span of each quote in the documents that hold it."""
    pairs = Q.quotes_in_texts(t.benchmark, "item_id", "text", t.documents, "doc_id", "text")
    both = pairs.join(t.benchmark.select("item_id", F.col("text").alias("quote")), "item_id").join(t.documents.select("doc_id", "text"), "doc_id")
    return both.select("item_id", "doc_id", arrow.snap_quote(F.col("quote"), F.col("text")).alias("span"))


@query("verbatim_share")
def verbatim_share(t: Tables):
    """How much of each quote stands word by word in the documents that hold most of it."""
    pairs = Q.quotes_in_texts(t.benchmark, "item_id", "text", t.documents, "doc_id", "text", least=0.5)
    lines = t.benchmark.select("item_id", Q.word_tokens(F.col("text")).alias("line"), amounts.numbers(F.col("text")).alias("n1"))
    sources = t.documents.select("doc_id", Q.word_tokens(F.col("text")).alias("source"), amounts.numbers(F.col("text")).alias("n2"))
    j = pairs.join(lines, "item_id").join(sources, "doc_id")
    supported = F.forall("n1", lambda x: F.exists("n2", lambda y: F.abs(x - y) < 0.011))
    return j.select("item_id", "doc_id", F.round(Q.verbatim_share(F.col("line"), F.col("source")), 6).alias("verbatim"), supported.alias("numbers_ok"))


def visits(t: Tables):
    return t.pages.select(
        "page_id", U.registrable_domain(F.col("url")).alias("site"), U.url_pattern(F.col("url")).alias("pattern"), (F.length("html") % 3 == 0).alias("hit"),
        F.when(F.length("html") % 2 == 0, F.concat(F.lit("/"), F.regexp_extract("url", "//[^/]*/([a-z]+)/", 1))).alias("parent"), "url",
    )


STATS_SQL = f"""v AS (SELECT p.page_id, regexp_extract(url, '([^./]+\\.[^./]+)(/|$|\\?|#)', 1) AS site, pattern, length(html) % 3 = 0 AS hit, CASE WHEN length(html) % 2 = 0 THEN '/' || regexp_extract(url, '//[^/]*/([a-z]+)/', 1) END AS parent, url FROM pages p JOIN {PATTERN_SQL} x ON x.page_id = p.page_id),
u AS (SELECT site, pattern, CASE WHEN hit THEN 1 ELSE 0 END AS h, CASE WHEN hit THEN 0 ELSE 1 END AS m, 0 AS d FROM v UNION ALL SELECT site, parent, 0, 0, 1 FROM v WHERE hit AND parent IS NOT NULL),
st AS (SELECT site, pattern, CAST(sum(h) AS BIGINT) AS hits, CAST(sum(m) AS BIGINT) AS misses, CAST(sum(d) AS BIGINT) AS discovered, round((sum(h) + 1) / (sum(h) + sum(m) + 2), 6) AS productivity, round(least(1.0, sum(d) / (sum(h) + sum(m) + 1)), 6) AS hub_value,
sum(m) >= 8 AND sum(h) = 0 AND sum(d) = 0 AS dead FROM u GROUP BY 1, 2)"""


def pattern_stats(t: Tables):
    return A.url_pattern_stats(visits(t), "site", "pattern", F.col("hit"), "parent")


@query("url_pattern_stats", f"WITH {STATS_SQL} SELECT * FROM st")
def url_pattern_stats(t: Tables):
    return pattern_stats(t)


@query("best_patterns", f"WITH {STATS_SQL} SELECT * FROM st WHERE hits > 0 ORDER BY productivity DESC, hits DESC, pattern, site LIMIT 5")
def best_patterns(t: Tables):
    stats = pattern_stats(t)
    return stats.filter("hits > 0").orderBy(F.desc("productivity"), F.desc("hits"), "pattern", "site").limit(5)


@query(
    "url_priority_rank",
    f"""WITH {STATS_SQL} SELECT v.page_id, round(0.45 * coalesce(productivity, 0.5) + 0.35 * least(1.0, (CASE WHEN contains(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '/7') THEN 1 ELSE 0 END + CASE WHEN contains(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), 'html') THEN 1 ELSE 0 END) / 2)
    + 0.2 / (1 + page_id % 4) + 0.25 * coalesce(hub_value, 0) + CASE WHEN page_id % 5 = 0 THEN 0.05 ELSE 0 END, 4) AS priority FROM v LEFT JOIN st ON st.site = v.site AND st.pattern = v.pattern WHERE NOT coalesce(dead, false)""",
)
def url_priority_rank(t: Tables):
    links = visits(t).withColumns({"anchor": F.lit(""), "depth": F.col("page_id") % 4, "from_sitemap": F.col("page_id") % 5 == 0})
    return P.rank_frontier(links, pattern_stats(t), "site", ["/7", "html"]).select("page_id", "priority")


@query(
    "url_naive_bayes",
    f"""WITH r AS (SELECT p.page_id, regexp_extract(url, '\\.([a-z]+)(/|$|\\?|#)', 1) AS site, length(html) % 2 = 0 AS u, list_distinct(tokens) AS tokens FROM pages p JOIN {TOKENS_SQL} x ON x.page_id = p.page_id),
    c AS (SELECT site, count(*) FILTER (u) AS np, count(*) FILTER (NOT u) AS nn FROM r GROUP BY 1 HAVING count(*) >= 30 AND count(*) FILTER (u) >= 5 AND count(*) FILTER (NOT u) >= 5), e AS (SELECT page_id, site, u, unnest(tokens) AS tok FROM r),
    n AS (SELECT site, tok, count(*) FILTER (u) AS pos, count(*) FILTER (NOT u) AS neg FROM e GROUP BY 1, 2), tt AS (SELECT site, sum(pos) AS ap, sum(neg) AS an, count(*) AS vocab FROM n GROUP BY 1),
    z AS (SELECT page_id, max(ln(np / nn)) + sum(ln((pos + 1) / (ap + vocab)) - ln((neg + 1) / (an + vocab))) AS z FROM e JOIN n ON n.site = e.site AND n.tok = e.tok JOIN tt ON tt.site = e.site JOIN c ON c.site = e.site GROUP BY 1)
    SELECT page_id, round(1 / (1 + exp(-z)), 6) AS probability, round(0.6 * (1 / (1 + exp(-z)) - 0.5), 4) AS bonus FROM z""",
)
def url_naive_bayes(t: Tables):
    rows = t.pages.select("page_id", F.regexp_extract("url", r"\.([a-z]+)(/|$|\?|#)", 1).alias("site"), (F.length("html") % 2 == 0).alias("u"), U.url_tokens(F.col("url")).alias("tokens"))
    weights, priors = P.url_bayes(rows, "site", "tokens", F.col("u"))
    return P.url_bayes_score(rows, "page_id", "site", "tokens", weights, priors)


@query(
    "backlog_merge",
    """WITH o AS (SELECT s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN 'done' ELSE 'open' END AS status, s_nationkey AS priority FROM supplier WHERE s_acctbal < 8000), n AS (SELECT s_suppkey AS key, s_nationkey + 100 AS priority FROM supplier WHERE s_acctbal > 3000)
    SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'inserted' WHEN n.key IS NULL AND status = 'open' THEN 'expired' WHEN n.key IS NULL THEN status ELSE 'confirmed' END AS state, coalesce(n.priority, o.priority) AS priority FROM o FULL JOIN n ON o.key = n.key""",
)
def backlog_merge(t: Tables):
    status = F.when(F.col("s_suppkey") % 3 == 0, "done").otherwise("open")
    old = t.supplier.filter("s_acctbal < 8000").select(F.col("s_suppkey").alias("key"), status.alias("status"), F.col("s_nationkey").alias("priority"))
    new = t.supplier.filter("s_acctbal > 3000").select(F.col("s_suppkey").alias("key"), (F.col("s_nationkey") + 100).alias("priority"))
    return V.backlog_merge(old, new, "key", ["priority"])


@query("new_records_vs_head", "SELECT DISTINCT o_custkey || o_orderpriority AS key FROM orders WHERE o_orderdate >= TIMESTAMP '1999-06-01 00:00:00' AND o_custkey || o_orderpriority NOT IN (SELECT o_custkey || o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1999-06-01 00:00:00')")
def new_records_vs_head(t: Tables):
    o = t.orders.withColumn("key", F.concat(F.col("o_custkey").cast("string"), "o_orderpriority"))
    cut = ntz("1999-06-01 00:00:00")
    return V.new_records(o.filter(F.col("o_orderdate") >= cut), o.filter(F.col("o_orderdate") < cut), "key")


@query("leftover_points", "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_extendedprice > 90000 AND l_linestatus = 'F')")
def leftover_points(t: Tables):
    used = t.lineitem.filter("l_extendedprice > 90000")
    return V.leftover_points(t.lineitem.select("l_orderkey", "l_partkey"), "l_orderkey", used, "l_partkey", F.col("l_linestatus") == "F")


@query(
    "fact_union_latest",
    """WITH b AS (SELECT source, doc_id, text, 0 AS v FROM documents UNION ALL SELECT source, doc_id, 'new ' || doc_id, 1 FROM documents WHERE n_chars > 900), l AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY source, doc_id ORDER BY v DESC) = 1)
    SELECT source, doc_id, substr(text, 1, 20) AS head, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rank FROM l QUALIFY rank <= 30""",
)
def fact_union_latest(t: Tables):
    old = t.documents.select("source", "doc_id", "text", F.col("doc_id").alias("at"))
    new = t.documents.filter("n_chars > 900").select("source", "doc_id", F.concat(F.lit("new "), F.col("doc_id").cast("string")).alias("text"), F.col("doc_id").alias("at"))
    return V.fact_union_latest(old, new, "source", "doc_id", "at", 30).select("source", "doc_id", F.left("text", F.lit(20)).alias("head"), "rank")


@query(
    "lead_save",
    f"""WITH l AS (SELECT doc_id, array_to_string(list_sort({stems_sql('text')}), ' ') AS fp, n_chars % 4 AS depth, lang FROM documents), k AS (SELECT fp FROM l WHERE lang = 'de')
    SELECT min(doc_id) AS doc_id FROM l WHERE depth <= 2 AND lang <> 'de' AND fp NOT IN (SELECT fp FROM k) GROUP BY fp""",
)
def lead_save(t: Tables):
    l = t.documents.select("doc_id", X.fingerprint(F.lit("lead"), F.col("text")).alias("fp"), (F.col("n_chars") % 4).alias("depth"), "lang")  # noqa: E741
    return V.save_leads(l.filter("lang <> 'de'"), l.filter("lang = 'de'"), "fp", "depth", 2, "doc_id").select("doc_id")


@query("distinct_ordered", r"SELECT regexp_extract(url, '//([^/?#]*)', 1) AS host, min(page_id) AS first_at FROM pages GROUP BY 1")
def distinct_ordered(t: Tables):
    return V.distinct_ordered(t.pages.select("page_id", F.regexp_extract("url", "//([^/?#]*)", 1).alias("host")), "host", "page_id")


@query(
    "asked_and_used_sets",
    cte("query_log")
    + r""", u AS (SELECT entity, used_url FROM query_log WHERE used_url <> '') SELECT DISTINCT entity, 'asked' AS what, slot AS value FROM query_log WHERE created_at >= TIMESTAMP '2024-01-20 00:00:00' UNION SELECT entity, 'used_url', used_url FROM u UNION SELECT entity, 'used_domain', regexp_extract(used_url, '//([^/?#]*)', 1) FROM u""",
)
def asked_and_used_sets(t: Tables):
    return V.asked_and_used(standin(t, "query_log"), "entity", "created_at", ntz("2024-01-20 00:00:00"), "slot", ["used_url"])


@query(
    "known_texts_union",
    """SELECT source, doc_id, substr(text, 1, 30) AS head FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0 UNION ALL SELECT p_brand, p_partkey, unnest(list_filter([p_name, CASE WHEN p_size > 20 THEN p_type ELSE '' END], lambda x: x <> '')) FROM part""",
)
def known_texts_union(t: Tables):
    facts = t.documents.join(t.labels, "doc_id", "left").withColumn("e", F.struct("source", "doc_id"))
    docs = t.part.select(F.struct(F.col("p_brand").alias("source"), F.col("p_partkey").alias("doc_id")).alias("e"), F.array("p_name", F.when(F.col("p_size") > 20, F.col("p_type")).otherwise("")).alias("fields"))
    out = V.known_texts(facts, "e", "text", F.coalesce("toxic", F.lit(0)) == 0, docs, F.col("fields"))
    return out.select("e.source", "e.doc_id", F.left("text", F.lit(30)).alias("head"))
