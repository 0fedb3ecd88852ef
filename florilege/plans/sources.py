"""Registered readers, writers and page extraction over the given tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from florilege.functions import json_fields as JF
from florilege.functions import rules as R
from florilege.functions import urls as U
from florilege.operators import classify as C
from florilege.operators import similarity as S
from florilege.operators.joins import link_longest
from florilege.plans.filters import ITEMS_SQL, items
from florilege.plans.joins import NAMES_SQL, catalogue
from florilege.plans.registry import Tables, query
from florilege.plans.standins import cte, standin
from florilege.plans.text_functions import turn_pairs
from florilege.session import scratch_folder
from florilege.sources import dom as D
from florilege.sources import html as H
from florilege.sources import stores as A


@query("page_scan", "SELECT lang, count(*) AS n, sum(CASE WHEN n_chars > 500 THEN 1 ELSE 0 END)::BIGINT AS long FROM documents GROUP BY lang")
def page_scan(t: Tables):
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(F.col("n_chars") > 500, 1)).alias("long"))


@query("json_doc_scan", "SELECT p_brand AS entity, count(*) AS n FROM part GROUP BY 1")
def json_doc_scan(t: Tables):
    """One JSON file per brand written and read back, beside one unreadable file."""
    folder = scratch_folder(t.spark, "documents")
    docs = t.part.groupBy(F.col("p_brand").alias("entity")).agg(F.to_json(F.struct(F.count("*").alias("n"))).alias("value"))
    broken = t.spark.createDataFrame([("broken", "{oops")], "entity string, value string")
    docs.unionByName(broken).repartition("entity").write.partitionBy("entity").text(folder)
    out = A.json_documents(t.spark, folder, r"entity=([^/]+)/")
    return out.select(F.url_decode(F.url_decode("entity")).alias("entity"), F.try_variant_get("doc", "$.n", "long").alias("n"))


@query(
    "recipe_store_scan",
    """SELECT o_orderkey AS id, min(o_orderpriority || o_orderkey) AS tytul FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1""",
)
def recipe_store_scan(t: Tables):
    """Records in files that hold a list or an object with a list; the first file wins."""
    folder = scratch_folder(t.spark, "stores")
    rec = t.orders.select(F.col("o_orderkey").alias("id"), F.concat("o_orderpriority", F.col("o_orderkey").cast("string")).alias("tytul"), F.floor(F.col("o_orderkey") / 1000).alias("file"), F.when(F.col("o_orderkey") % 7 == 0, True).alias("wzmianka")).distinct()
    lists = rec.groupBy("file").agg(F.to_json(F.array_sort(F.collect_list(F.struct("id", "tytul", "wzmianka")))).alias("value"))
    # the key of the list has any name; what stands before it is no list, what stands behind it is not the first
    inside = F.concat(F.lit('{"wersja":2,"zrodlo":{"a":[0]},"lista'), F.col("file").cast("string"), F.lit('":'), "value", F.lit(',"archiwum":[{"id":-1}]}'))
    wrapped = lists.withColumn("value", F.when(F.col("file") % 2 == 1, inside).otherwise(F.col("value")))
    wrapped.repartition("file").write.partitionBy("file").text(folder)
    out = A.record_stores(t.spark, folder)
    return out.select(F.try_variant_get("rec", "$.id", "long").alias("id"), F.try_variant_get("rec", "$.tytul", "string").alias("tytul"))


def dated_files(t: Tables):
    folder = scratch_folder(t.spark, "dated")
    name = F.concat(F.regexp_replace("event_type", "_", ""), F.lit("_"), F.to_date("ts").cast("string"), F.lit(".json"))
    files = t.events.groupBy(name.alias("file")).agg(F.count("*").cast("string").alias("value"))
    files.repartition(4, "file").write.partitionBy("file").text(folder)
    return A.file_catalog(t.spark, folder, r"file=([^/]+)/")


@query("file_catalog", "WITH f AS (SELECT event_type AS series, CAST(CAST(ts AS DATE) AS VARCHAR) AS d, count(*) FROM events GROUP BY 1, 2) SELECT series || '_' || d || '.json' AS file, series, d = max(d) OVER (PARTITION BY series) AS live FROM f")
def file_catalog(t: Tables):
    return dated_files(t).select("file", "series", "live")


@query("newest_per_series", "SELECT event_type AS series, event_type || '_' || max(CAST(CAST(ts AS DATE) AS VARCHAR)) || '.json' AS file FROM events GROUP BY 1")
def newest_per_series(t: Tables):
    return A.newest_per_series(dated_files(t)).select("series", "file")


@query(
    "legacy_archive_convert",
    """WITH s AS (SELECT l_orderkey, list(p_name || '.' ORDER BY l_linenumber, p_name) AS steps FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) SELECT o_orderkey, len(steps) AS n_steps, 'Krok 1: ' || steps[1] AS first FROM orders JOIN s ON l_orderkey = o_orderkey WHERE o_orderpriority <> '3-MEDIUM'""",
)
def legacy_archive_convert(t: Tables):
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    steps = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))).alias("s"))  # lines of one order
    text = F.array_join(F.transform("s", lambda x: F.concat(F.lit("- "), x["p_name"], F.lit("."))), "\n")
    rows = t.orders.join(steps, F.col("o_orderkey") == F.col("l_orderkey")).withColumn("title", F.when(F.col("o_orderpriority") != "3-MEDIUM", "x"))
    out = A.convert_archive(rows, "o_orderkey", F.regexp_replace(text, "(?m)^- ", "krok 1: "), ["title"])
    return out.select("o_orderkey", F.size("steps").alias("n_steps"), F.get("steps", F.lit(0)).alias("first"))


def xml_files(t: Tables, entry, root: str):
    """Entries of 200 pages each as the text of one XML file."""
    g = t.pages.groupBy(F.floor(F.col("page_id") / 200).alias("file")).agg(F.array_join(F.collect_list(entry), "").alias("body"))
    return g.select(F.concat(F.lit(f"<{root}>"), "body", F.lit(f"</{root}>")).alias("value"))


@query("sitemap_scan", r"SELECT DISTINCT 'https://s.example/p/' || regexp_extract(url, '/([0-9]+)', 1) AS url, CASE WHEN contains(url, 'https') THEN 1 ELSE 1 END AS rank FROM pages")
def sitemap_scan(t: Tables):
    folder = scratch_folder(t.spark, "sitemap")
    loc = F.concat(F.lit("<url><loc> https://s.example/p/"), F.regexp_extract("url", "/([0-9]+)", 1), F.lit("?utm_source=x </loc></url>"))
    xml_files(t, loc, "urlset").write.option("maxRecordsPerFile", 1).text(folder)
    out = A.sitemap_urls(t.spark, folder, "s.example", ["part"])
    return out.select("url", (F.col("rank") - 1).cast("int").alias("rank"))


@query("feed_scan", r"SELECT DISTINCT CASE WHEN page_id % 2 = 0 THEN 'https://rss.example/' ELSE 'https://atom.example/' END || regexp_extract(url, '/([0-9]+)', 1) AS url FROM pages")
def feed_scan(t: Tables):
    folder = scratch_folder(t.spark, "feed")
    n = F.regexp_extract("url", "/([0-9]+)", 1)
    rss = F.concat(F.lit("<item><link>https://rss.example/"), n, F.lit("</link></item>"))
    atom = F.concat(F.lit('<entry><link href="https://atom.example/'), n, F.lit('"/></entry>'))
    xml_files(t, F.when(F.col("page_id") % 2 == 0, rss).otherwise(atom), "feed").write.option("maxRecordsPerFile", 1).text(folder)
    return A.feed_urls(t.spark, folder)


@query("search_result_merge", r"""WITH r AS (SELECT regexp_extract(url, '//([^/?#]*)', 1) AS url, CASE WHEN page_id % 2 = 0 THEN 'a' ELSE 'b' END AS engine FROM pages) SELECT url, array_to_string(list_sort(list(DISTINCT engine)), ',') AS engines FROM r GROUP BY 1""")
def search_result_merge(t: Tables):
    r = t.pages.select(U.netloc(F.col("url")).alias("url"), F.col("page_id").alias("pos"), F.lit("t").alias("title"))
    parts = [r.filter(f"pos % 2 = {i}").withColumn("engine", F.lit(e)) for i, e in enumerate("ab")]
    return A.merge_search_results(parts, "url").select("url", F.array_join("engines", ",").alias("engines"))


@query("export_sink", f"WITH {ITEMS_SQL} SELECT doc_id AS item, CASE WHEN status = 'approved' AND duplicate_of IS NULL THEN 'exported' ELSE status END AS status FROM items")
def export_sink(t: Tables):
    folder = scratch_folder(t.spark, "export")
    rows = items(t).select(F.col("doc_id").alias("item"), "title", "status", "duplicate_of", "url")
    sources = S.group_sources(rows, "item", "duplicate_of", "url")
    return A.export_records(rows, sources, folder, "records", "2024-01-31").select("item", "status")


@query("write_if_changed", "SELECT 'first' AS step, true AS written UNION ALL SELECT 'same', false UNION ALL SELECT 'changed', true")
def write_if_changed(t: Tables):
    """Three writes of the part table: new, the same in another order, and changed."""
    folder = scratch_folder(t.spark, "versions")
    rows = t.part.withColumn("stamp", F.lit("a"))
    steps = [("first", rows), ("same", rows.orderBy(F.desc("p_name")).withColumn("stamp", F.lit("b"))), ("changed", rows.withColumn("p_size", F.col("p_size") + 1))]
    done = [(name, A.write_if_changed(df, folder)) for name, df in steps]
    return t.spark.createDataFrame(done, "step string, written boolean")


@query(
    "counter_upsert",
    cte("counter_feed") + """, l AS (SELECT day, kind, key, arg_max(n, seq) AS n FROM counter_feed GROUP BY 1, 2, 3), c AS (SELECT DISTINCT day, kind, key, 7 AS n FROM counter_feed WHERE day < '2024-01-05' UNION SELECT '2023-12-31', 'old', 'k', 3) SELECT coalesce(l.day, c.day) AS day, coalesce(l.kind, c.kind) AS kind, coalesce(l.key, c.key) AS key, coalesce(l.n, c.n) AS n FROM l FULL JOIN c ON l.day = c.day AND l.kind = c.kind AND l.key = c.key""",
)
def counter_upsert(t: Tables):
    feed = standin(t, "counter_feed").withColumn("n", F.col("n").cast("string"))
    bad = feed.withColumn("n", F.lit("many")).withColumn("seq", F.col("seq") + 10**9)
    current = feed.filter("day < '2024-01-05'").select("day", "kind", "key", F.lit(7).cast("long").alias("n")).distinct()
    current = current.unionByName(t.spark.createDataFrame([("2023-12-31", "old", "k", 3)], "day string, kind string, key string, n long"))
    return A.upsert_counters(current, feed.unionByName(bad), "seq")


@query(
    "page_refresh_upsert",
    """SELECT page_id, CASE WHEN fresh THEN 'raw' WHEN page_id % 3 = 0 THEN 'error' ELSE 'approved' END AS status, CASE WHEN fresh THEN 'new' ELSE 'old' END AS body FROM (SELECT page_id, page_id % 5 = 0 OR (page_id % 3 = 0 AND page_id % 4 <> 0) AS fresh FROM pages WHERE page_id % 5 <> 0 OR page_id % 4 <> 0)""",
)
def page_refresh_upsert(t: Tables):
    stored = t.pages.filter("page_id % 5 <> 0").select("page_id", F.when(F.col("page_id") % 3 == 0, "error").otherwise("approved").alias("status"), F.lit("old").alias("body"))
    fetched = t.pages.filter("page_id % 4 <> 0").select("page_id", F.lit("new").alias("body"))
    return A.refresh_pages(stored, fetched, "page_id", ["body"])


@query(
    "change_log",
    """WITH p AS (SELECT a.conv_id, a.turn, a.text AS before, b.text AS after FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.text <> b.text), l AS (SELECT conv_id, turn, unnest(string_split(before, chr(10))) AS line, 1 AS a, 0 AS b FROM p UNION ALL SELECT conv_id, turn, unnest(string_split(after, chr(10))), 0, 1 FROM p),
    g AS (SELECT conv_id, turn, line, sum(a) AS a, sum(b) AS b FROM l GROUP BY 1, 2, 3), s AS (SELECT conv_id, turn, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS added, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS removed FROM g GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM s QUALIFY rank <= 3""",
)
def change_log(t: Tables):
    return A.change_log(turn_pairs(t), "conv_id", "turn", 3).select("conv_id", "turn", "added", "removed", "rank")


@query("add_missing_columns", "SELECT doc_id, lang, NULL AS source FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, lang, source FROM documents WHERE lang <> 'en'")
def add_missing_columns(t: Tables):
    old = t.documents.filter("lang = 'en'").select("doc_id", "lang")
    return old.unionByName(t.documents.filter("lang <> 'en'").select("doc_id", "lang", "source"), allowMissingColumns=True)


@query("usage_ledger_scan", cte("calls") + " SELECT day, purpose, CAST(coalesce(sum(tokens) FILTER (NOT local), 0) AS BIGINT) AS chmura, CAST(coalesce(sum(tokens) FILTER (local), 0) AS BIGINT) AS lokalnie, count(*) AS zapytania FROM calls GROUP BY 1, 2")
def usage_ledger_scan(t: Tables):
    local = F.col("local")
    g = standin(t, "calls").groupBy("day", "purpose").agg(
        F.sum(F.when(~local, F.col("tokens")).otherwise(0)).alias("chmura"), F.sum(F.when(local, F.col("tokens")).otherwise(0)).alias("lokalnie"), F.count("*").alias("zapytania")
    )
    per_day = g.groupBy("day").agg(F.map_from_entries(F.collect_list(F.struct("purpose", F.struct("chmura", "lokalnie", "zapytania")))).alias("m"))  # a fixed list of purposes
    return A.usage_ledger(per_day.select(F.to_json(F.create_map("day", "m")).alias("raw")), "raw")


@query("known_domain_cleanup", r"""WITH d AS (SELECT page_id, array_to_string(list_slice(string_split(regexp_extract(url, '//([^/?#]*)', 1), '.'), -2, -1), '.') AS domain FROM pages) SELECT domain, min(page_id) AS page_id FROM d WHERE domain <> 'example.org' GROUP BY 1""")
def known_domain_cleanup(t: Tables):
    return A.cleanup_known(t.pages.select("page_id", "url"), "page_id", "url", t.spark.createDataFrame([("example.org",)], "domain string"))


@query(
    "promote_verified",
    r"""WITH f AS (SELECT regexp_extract(url, '//([^/?#]*)', 1) AS domain, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/' AS root, regexp_extract(url, '//[^/]*/([a-z]+)', 1) AS lang, contains(url, '#') AS v FROM pages), s AS (SELECT DISTINCT domain FROM f WHERE NOT v AND contains(domain, 'blog'))
    SELECT domain, 'x' AS root, 'en' AS lang FROM s UNION ALL SELECT domain, min(root), coalesce(nullif(min(lang)[1:2], ''), 'en') FROM f WHERE v AND domain NOT IN (SELECT domain FROM s) GROUP BY 1""",
)
def promote_verified(t: Tables):
    f = t.pages.select(U.netloc(F.col("url")).alias("domain"), U.site_root(F.col("url")).alias("root"), F.regexp_extract("url", "//[^/]*/([a-z]+)", 1).alias("lang"), F.when(F.contains("url", F.lit("#")), "verified").otherwise("found").alias("status"))
    s = f.filter("status = 'found'").filter(F.contains("domain", F.lit("blog"))).select("domain", F.lit("x").alias("root"), F.lit("en").alias("lang")).distinct()
    return A.promote_verified(f, s)


@query(
    "entity_registry_sync",
    """WITH r AS (SELECT p_partkey AS entity, 'old' AS name, p_brand AS latin FROM part WHERE p_size < 30), c AS (SELECT p_partkey AS entity, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS latin FROM part WHERE p_size > 20), l AS (SELECT p_partkey AS entity, 'legacy' AS name, 'leg' AS latin FROM part WHERE p_size > 10),
    f AS (SELECT * FROM c UNION ALL SELECT * FROM l WHERE entity NOT IN (SELECT entity FROM c)) SELECT coalesce(r.entity, f.entity) AS entity, coalesce(f.name, r.name) AS name, coalesce(nullif(f.latin, ''), r.latin) AS latin FROM r FULL JOIN f ON r.entity = f.entity""",
)
def entity_registry_sync(t: Tables):
    p = t.part.withColumnRenamed("p_partkey", "entity")
    registry = p.filter("p_size < 30").select("entity", F.lit("old").alias("name"), F.col("p_brand").alias("latin"))
    current = p.filter("p_size > 20").select("entity", F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("latin"))
    return A.sync_registry(registry, current, p.filter("p_size > 10").select("entity", F.lit("legacy").alias("name"), F.lit("leg").alias("latin")))


@query("reference_corpus_scan", "SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT s_suppkey FROM supplier) THEN o_custkey || '_s' || o_orderkey ELSE CAST(o_custkey AS VARCHAR) END AS id FROM orders WHERE o_orderpriority <> '5-LOW'")
def reference_corpus_scan(t: Tables):
    live = t.orders.filter(~F.col("o_orderpriority").isin("5-LOW")).select("o_orderkey", F.col("o_custkey").alias("rec"))
    return A.unique_ids(live, "rec", "o_orderkey", t.supplier.select(F.col("s_suppkey").alias("rec")))


def _plain_sql(text: str) -> str:
    """Text between tags with its references read and white space as one space."""
    for name, char in (("nbsp", " "), ("quot", '"'), ("#x27", "''"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{char}')"
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


# the text of the article as the parser gives it: a line for each string between two tags
_ARTICLE_LINES = rf"list_filter(list_transform(string_split(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', chr(10), 'g'), chr(10)), lambda x: {_plain_sql('x')}), lambda x: x <> '')"


@query(
    "html_extract_job",
    rf"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS html, length(html) AS html_chars, array_to_string({_ARTICLE_LINES}, chr(10)) AS lines FROM pages)
    SELECT page_id, {_plain_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS title, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, length(lines) AS chars,
    len(regexp_extract_all(html, '<h[1-4]>')) AS headings, len(regexp_extract_all(html, '<li>')) AS items, len(regexp_extract_all(html, '<a href="[^"]+"')) AS links, FALSE AS needs_script FROM p""",
)
def html_extract_job(t: Tables):
    e = H.extract_pages(t.pages, "page_id", "url", "html")
    return e.select("page_id", "title", "lang", F.length("text").alias("chars"), F.size("headings").alias("headings"), F.size("items").alias("items"), F.size("links").alias("links"), "needs_script")


@query(
    "css_extract_job",
    rf"""SELECT page_id, site, title, ingredients, steps, content, CASE WHEN ingredients > 0 AND steps > 0 THEN 'fields' WHEN length(content) >= 300 THEN 'article' END AS mode, length(content) >= 400 AS fact FROM (
    SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\.', '') AS site, {_plain_sql("regexp_extract(html, '(?s)<article><h1>(.*?)</h1>', 1)")} AS title,
    CASE WHEN contains(url, '.net') THEN 0 ELSE len(regexp_extract_all(html, '<a href="/[^"]+">')) END AS ingredients, CASE WHEN contains(url, '.net') THEN 0 ELSE len(list_filter(list_transform(string_split(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p>')[2:],
    lambda x: trim(regexp_replace(x, '<[^>]*>', ' ', 'g'))), lambda x: x <> '')) END AS steps, array_to_string({_ARTICLE_LINES}, chr(10)) AS content FROM pages) ORDER BY page_id""",
)
def css_extract_job(t: Tables):
    """Profiles of all sites: on some a complete record (addresses of the menu, paragraphs of the article), else the article."""
    pages = t.pages.withColumn("page_site", U.site_key(F.col("url")))
    sites = pages.select("page_site").distinct()
    record = {"title": {"css": "article > h1"}, "ingredients": {"css": "nav ul a[href]", "attr": "href"}, "steps": {"css": "body article p"}, "content": {"css": "article"}}
    told = {"title": record["title"], "content": record["content"], "steps": {"css": "article:hover p"}}
    profiles = sites.withColumn("fields", F.when(F.col("page_site").contains(".net"), json.dumps(told)).otherwise(json.dumps(record)))
    got = H.apply_profiles(t.pages, "page_id", "url", "html", D.profile_rules(profiles, "page_site", "fields"))
    done = got.join(pages.select("page_id", F.col("page_site").alias("site")), "page_id")
    return done.select("page_id", "site", "title", F.size("ingredients").alias("ingredients"), F.size("steps").alias("steps"), "content", "mode", "fact")


@query(
    "profile_rule_search",
    rf"""WITH p AS (SELECT regexp_extract(url, '([^./]+\.[^./]+)(/|$|\?|#)', 1) AS site, contains(html, 'footer') AS marked, length(array_to_string({_ARTICLE_LINES}, ' ')) >= 300 AS long,
    contains(html, '<h1>') AS title, contains(html, '<li>') AS items, contains(html, '<table') AS rows FROM pages),
    s AS (SELECT site, bool_or(marked) AS marked, CASE WHEN bool_and(long) THEN 'article' END AS css, count(*) AS pages, count(*) FILTER (title AND items AND rows) AS complete, count(*) FILTER (title) AS titled FROM p GROUP BY site)
    SELECT site, rule, css, pages, n AS complete, n / pages AS coverage, n * 100 >= pages * 67 AS passes FROM (SELECT *, unnest(['blog', 'content']) AS rule, CASE WHEN css IS NOT NULL THEN titled WHEN rule = 'blog' THEN complete ELSE 0 END AS n FROM s)
    WHERE (rule = 'blog' AND marked) OR (rule = 'content' AND css IS NOT NULL)""",
)
def profile_rule_search(t: Tables):
    """Ready-made sets on all pages of a site: one of a plugin, known by its mark, and the first container with enough text."""
    p = t.pages.withColumn("site", U.registrable_domain(F.col("url")))
    blog = {"title": "footer ~ h1, article h1", "ingredients": "nav li", "steps": "table tr > td"}
    return H.rule_search(p, "page_id", "site", "html", {"blog": blog}, ["article .entry-content", ".post-content", "article", "main"])


@query(
    "link_graph",
    r"""WITH e AS (SELECT DISTINCT url AS a, lower(regexp_extract(url, '^[a-z]+://[^/?#]*')) || regexp_extract(h, '^[^#]*') AS b FROM (SELECT url, unnest(regexp_extract_all(html, '<a href="(/[^"]*)"', 1)) AS h FROM pages)),
    d0 AS (SELECT DISTINCT url FROM pages), d1 AS (SELECT DISTINCT b AS url FROM e WHERE b NOT IN (SELECT url FROM d0)), d2 AS (SELECT DISTINCT e.b AS url FROM e JOIN d1 ON d1.url = e.a WHERE e.b NOT IN (SELECT url FROM d0 UNION SELECT url FROM d1))
    SELECT CAST(depth AS INT) AS depth, count(*) AS n FROM (SELECT 0 AS depth, url FROM d0 UNION ALL SELECT 1, url FROM d1 UNION ALL SELECT 2, url FROM d2) GROUP BY 1""",
)
def link_graph(t: Tables):
    """Depth of every address reached from the pages within two links."""
    edges = H.link_edges(H.extract_pages(t.pages, "page_id", "url", "html"), "page_id", "url")
    depth = H.link_depths(edges, t.pages.select("url"), "url", 2)
    return depth.groupBy("depth").agg(F.count("*").alias("n"))


@query(
    "request_response_tables",
    """WITH r AS (SELECT DISTINCT text AS prompt FROM conversations WHERE role = 'user'), a AS (SELECT x.text AS prompt, x.conv_id * 100 + x.turn AS version, y.text AS answer,
    CASE WHEN length(y.text) < 40 THEN 'short' WHEN length(y.text) > 300 THEN 'long' WHEN len(regexp_extract_all(y.text, '[0-9]+')) > len(regexp_extract_all(x.text, '[0-9]+')) + 2 THEN 'numbers' END AS problem
    FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1 WHERE x.role = 'user' AND x.conv_id % 4 <> 0 AND x.turn < 7),
    best AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY problem IS NULL DESC, version DESC, answer DESC) = 1)
    SELECT md5(r.prompt) AS prompt, CASE WHEN best.prompt IS NULL THEN 'pending' WHEN problem IS NULL THEN 'answered' ELSE 'rejected' END AS state, CASE WHEN problem IS NULL THEN version END AS version, CASE WHEN problem IS NULL THEN length(answer) END AS chars, problem FROM r LEFT JOIN best ON best.prompt = r.prompt""",
)
def request_response_tables(t: Tables):
    """Every user turn is asked; what follows it answers, in as many versions as it was said; some are never answered."""
    user = t.conversations.filter("role = 'user'")
    requests = H.request_table(user, "wiedza", F.col("text"))
    after = t.conversations.select(F.col("conv_id").alias("_c"), (F.col("turn") - 1).alias("_t"), F.col("text").alias("answer"))
    said = user.filter("conv_id % 4 <> 0 AND turn < 7").join(after, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t")))
    asked = said.select(F.lit("wiedza").alias("purpose"), F.col("text").alias("prompt"), (F.col("conv_id") * 100 + F.col("turn")).alias("version"), "answer")
    responses = asked.select(F.sha2(F.to_json(F.struct("purpose", "prompt")), 256).alias("key"), "version", F.struct("prompt", "answer").alias("answer"))
    digits = lambda x: F.size(F.regexp_extract_all(x, F.lit("[0-9]+"), F.lit(0)))
    wrong = lambda a: F.when(F.length(a["answer"]) < 40, "short").when(F.length(a["answer"]) > 300, "long").when(digits(a["answer"]) > digits(a["prompt"]) + 2, "numbers")
    done = H.join_answers(requests, responses, wrong)
    return done.select(F.md5(F.col("prompt").cast("binary")).alias("prompt"), "state", "version", F.length("answer.answer").alias("chars"), "problem")


@query(
    "shop_signals",
    rf"""WITH s AS (SELECT page_id, regexp_matches(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '(^|[^0-9])[0-9]{{13}}([^0-9]|$)') AS number, len(regexp_extract_all(html, '<h[1-4]>')) AS heads, array_to_string({_ARTICLE_LINES}, chr(10))[:6000] AS top FROM pages)
    SELECT page_id, number OR (heads <= 6 AND regexp_matches(top, '(?i)' || '{R.CART.removeprefix("(?iU)")}') AND regexp_matches(top, '(?i)' || '{R.PRICE.removeprefix("(?iU)")}')) AS shop FROM s""",
)
def shop_signals(t: Tables):
    e = H.extract_pages(t.pages, "page_id", "url", "html")
    return e.select("page_id", C.is_shop_page(F.col("url"), F.col("headings"), F.col("text")).alias("shop"))


@query("layered_classify")
def layered_classify(t: Tables):
    """Kind of each page by the first rule that holds, with its reason; a model's gate speaks for some of the unclear ones."""
    signals = C.page_signals(t.pages, "page_id", "url", "html", ["the", "que", "der"], ["the", "ver"], ["cake", "soup"])
    gate = F.struct(F.when(F.col("page_id") % 2 == 0, "fact").otherwise("recipe").alias("label"), F.lit(0.9).alias("confidence"), (F.col("page_id") % 3 == 0).alias("use"), (F.col("page_id") % 3 == 1).alias("fallback"))
    return C.classify_pages(signals.withColumn("gate", gate), "page_id", C.page_rules(model="gate"))


@query(
    "recipe_jsonld",
    """SELECT o_orderkey, o_orderpriority AS title, array_to_string(list(CAST(l_partkey AS VARCHAR) ORDER BY l_linenumber, l_partkey), ' ') AS ingredients,
    CASE o_orderkey % 3 WHEN 0 THEN 'mix|wait|serve' WHEN 1 THEN 'mix.|2. wait|serve' ELSE 'mix' END AS steps, o_orderkey % 3 < 2 AS complete FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""",
)
def recipe_jsonld(t: Tables):
    """Recipes below a graph, a main entity of a list, or nested item lists; steps in sections, as one text, or one that is no recipe's title."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: F.concat(F.lit(" <b>"), x["l_partkey"].cast("string"), F.lit("</b>")))
    g = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", "o_orderpriority").agg(F.to_json(items).alias("parts"))
    sections = '[{"@type":"HowToSection","itemListElement":[{"@type":"HowToStep","text":"mix"},{"itemListElement":[{"name":"wait"}]}]},{"text":"serve"}]'
    steps = F.when(F.col("o_orderkey") % 3 == 0, sections).when(F.col("o_orderkey") % 3 == 1, json.dumps("mix. 2. wait\nserve")).otherwise('"mix"')
    name = F.when(F.col("o_orderkey") % 3 < 2, F.concat(F.lit('"name":"'), "o_orderpriority", F.lit('",'))).otherwise(F.concat(F.lit('"name":null,"alternateName":"'), "o_orderpriority", F.lit('",')))
    recipe = F.concat(F.lit('{"@type":["Thing","Recipe"],'), name, F.lit('"recipeIngredient":'), "parts", F.lit(',"recipeInstructions":'), steps, F.lit("}"))
    within = (
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('{"@graph":[{"@type":"WebPage","mainEntity":'), recipe, F.lit("}]}")))
        .otherwise(F.concat(F.lit('[{"@type":"ItemList","itemListElement":[[{"@type":"ListItem","mainEntity":['), recipe, F.lit("]}]]}]")))
    )
    got = H.recipe_from_jsonld(g.select("o_orderkey", within.alias("ld")), "o_orderkey", "ld")
    told = got.join(t.orders.select(F.col("o_orderkey").alias("k"), "o_orderpriority"), F.col("o_orderkey") == F.col("k"))
    return told.select("o_orderkey", F.coalesce("title", "o_orderpriority").alias("title"), F.array_join("ingredients", " ").alias("ingredients"), F.array_join("steps", "|").alias("steps"), "complete")


@query("record_normalize", "SELECT p_partkey, p_name AS tytul, CASE WHEN p_type IN ('PROMO', 'LARGE') THEN p_type ELSE 'inne' END AS typ, 'Krok 1: mix ' || p_name AS step, CASE WHEN p_size > 20 THEN p_brand ELSE '' END AS link FROM part")
def record_normalize(t: Tables):
    known = F.when(F.col("p_size") > 20, F.array("p_brand")).otherwise(F.array().cast("array<string>"))
    rec = H.normalize_record(F.concat(F.lit("  "), "p_name"), F.array("p_name", F.lit(" ")), F.array(F.lit(""), F.concat(F.lit("Krok 7: mix "), "p_name")), F.array("p_brand", F.lit("ghost")), known, F.col("p_type"), ["PROMO", "LARGE"], "inne")
    return t.part.select("p_partkey", rec.alias("r")).select("p_partkey", "r.tytul", "r.typ", F.get("r.sposob", F.lit(0)).alias("step"), F.array_join("r.linki", ",").alias("link"))


@query("strip_fields", "SELECT event_id, regexp_extract(props, '[0-9]+', 0) AS k FROM events")
def strip_fields(t: Tables):
    raw = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(', "retired": "x", "link_id": ""}'))
    m = t.events.select("event_id", JF.strip_fields(raw, ["retired"]).alias("m"))
    return m.filter(F.size("m") == 1).select("event_id", F.try_element_at("m", F.lit("k")).alias("k"))


@query(
    "lead_export_records",
    f"""WITH {NAMES_SQL}, c AS (SELECT entity, regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}_]+')[1:2] AS ws FROM names), p AS (SELECT entity, len(ws) AS size, ws[1][1:greatest(4, length(ws[1]) - 2)] AS a, ws[2][1:greatest(4, length(ws[2]) - 2)] AS b FROM c),
    m AS (SELECT doc_id, entity FROM docs JOIN p ON contains(lower(text), a) AND (b IS NULL OR contains(lower(text), b)) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, entity) = 1)
    SELECT d.doc_id, CASE WHEN m.entity IS NULL THEN '{{"jezyk":"' || lang || '"}}' ELSE '{{"jezyk":"' || lang || '","roslina":' || m.entity || '}}' END AS record FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id""",
)
def lead_export_records(t: Tables):
    linked = link_longest(t.documents, "doc_id", F.col("text"), catalogue(t), "entity", F.col("name"))
    return t.documents.join(linked, "doc_id", "left").select("doc_id", F.to_json(F.struct(F.col("lang").alias("jezyk"), F.col("entity").alias("roslina"))).alias("record"))


@query("legacy_backfill", """SELECT doc_id, CASE WHEN n_chars % 3 = 0 THEN 'kept' ELSE 'filled' END AS state FROM documents""")
def legacy_backfill(t: Tables):
    """Rows without a fingerprint get one; rows that have one keep it."""
    from florilege.functions import text as X

    rows = t.documents.select("doc_id", "text", F.when(F.col("n_chars") % 3 == 0, "old").alias("fingerprint"))
    filled = rows.withColumn("new", F.coalesce("fingerprint", X.fingerprint(F.lit("item"), F.col("text"))))
    return filled.select("doc_id", F.when(F.col("new") == "old", "kept").otherwise("filled").alias("state"))
