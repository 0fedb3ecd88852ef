"""Registered aggregate reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.operators import aggregates as A
from florilege.operators.primitives import count_where
from florilege.plans.registry import Tables, query
from florilege.plans.standins import NOW, cte, standin

KINDS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]


def now_col():
    return F.lit(NOW).cast("timestamp_ntz")
SINCE = "TIMESTAMP '2024-01-08 00:00:00'"


def counters(t: Tables):
    feed = standin(t, "counter_feed")
    return feed.groupBy("day", "kind", "key").agg(F.sum("n").cast("long").alias("n"))


COUNTERS = cte("counter_feed") + ", counters AS (SELECT day, kind, key, CAST(sum(n) AS BIGINT) AS n FROM counter_feed GROUP BY ALL)"


@query(
    "kind_status_pivot",
    """SELECT k.kind, count(o_orderkey) FILTER (o_orderstatus = 'F') AS n_F, count(o_orderkey) FILTER (o_orderstatus = 'O') AS n_O,
    count(o_orderkey) FILTER (o_orderstatus = 'P') AS n_P, count(o_orderkey) FILTER (o_orderstatus = 'X') AS n_X
    FROM (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '6-NONE']) AS kind) k
    LEFT JOIN orders ON o_orderpriority = k.kind GROUP BY k.kind""",
)
def kind_status_pivot(t: Tables):
    return A.status_pivot(t.orders.withColumnRenamed("o_orderpriority", "kind"), "kind", "o_orderstatus", KINDS, ["F", "O", "P", "X"])


@query(
    "source_kind_counts",
    """SELECT source, count(*) FILTER (lang = 'en') AS n_en, count(*) FILTER (lang = 'de') AS n_de, count(*) AS n_all,
    round(count(*) FILTER (n_chars >= 200) / count(*), 6) AS coverage, max(doc_id) AS last_harvest FROM documents GROUP BY source""",
)
def source_kind_counts(t: Tables):
    return A.source_kind_counts(t.documents, "source", F.col("lang"), ["en", "de"], F.col("n_chars") >= 200, F.col("doc_id"))


@query(
    "fact_funnel",
    cte("facts")
    + """ SELECT count(*) FILTER (status = 'new') AS collected, count(*) FILTER (status = 'verified') AS verified,
    count(*) FILTER (status = 'applied') AS in_files, count(*) FILTER (status = 'rejected') AS rejected,
    count(*) FILTER (created_at >= TIMESTAMP '2024-01-24 00:00:00') AS collected_recent FROM facts""",
)
def fact_funnel(t: Tables):
    return A.fact_funnel(standin(t, "facts"), F.col("status"), F.col("created_at"), now_col())


@query(
    "intake_stats",
    cte("facts", "query_log")
    + f""", a AS (SELECT count(*) AS new_facts, count(*) FILTER (status IN ('verified', 'applied')) AS new_verified FROM facts WHERE created_at >= {SINCE}),
    b AS (SELECT count(*) AS queries, count(*) FILTER (used_url <> '') AS queries_hit, count(*) FILTER (facts > 0) AS queries_with_facts
    FROM query_log WHERE created_at >= {SINCE}) SELECT * FROM a, b""",
)
def intake_stats(t: Tables):
    since = F.expr("TIMESTAMP_NTZ '2024-01-08 00:00:00'")
    return A.intake_totals(standin(t, "facts"), standin(t, "query_log"), since, ["verified", "applied"])


@query(
    "intake_languages",
    cte("facts") + f""" SELECT lang, count(*) AS n FROM facts WHERE created_at >= {SINCE} AND status IN ('verified', 'applied')
    GROUP BY lang ORDER BY n DESC, lang LIMIT 12""",
)
def intake_languages(t: Tables):
    since = F.expr("TIMESTAMP_NTZ '2024-01-08 00:00:00'")
    return A.intake_by_language(standin(t, "facts"), since, ["verified", "applied"], F.col("lang"))


@query(
    "section_count_map",
    """SELECT entity, string_agg(section || '=' || n, ',' ORDER BY section) AS sections FROM (
    SELECT l_suppkey AS entity, l_returnflag AS section, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) GROUP BY entity""",
)
def section_count_map(t: Tables):
    rows = t.lineitem.select(F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("section"), "l_linestatus")
    maps = A.as_count_map(A.section_counts(rows, "entity", "section", F.col("l_linestatus") == "F"), "entity", "section")
    text = F.transform(F.array_sort(F.map_entries("sections")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return maps.select("entity", F.array_join(text, ",").alias("sections"))


SLOTS_SQL = """(SELECT c_custkey AS entity, unnest(['nation', 'balance', 'segment', 'orders']) AS slot,
unnest([
 CASE WHEN c_nationkey % 5 = 0 THEN 'merged' WHEN c_nationkey % 5 = 1 THEN 'own' ELSE 'missing' END,
 CASE WHEN c_acctbal > 8000 THEN 'merged' WHEN c_acctbal > 3000 AND c_custkey % 2 = 0 THEN 'own+web' WHEN c_acctbal > 3000 THEN 'own' WHEN c_custkey % 2 = 0 THEN 'waiting' ELSE 'missing' END,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 'waiting' ELSE 'own' END,
 CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'own' ELSE 'missing' END]) AS state FROM customer)"""


def cover(t: Tables):
    done = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("entity")).distinct().withColumn("has", F.lit(True))
    c = t.customer.withColumnRenamed("c_custkey", "entity").join(done, "entity", "left")
    no = F.lit(False)
    slots = {
        "nation": (F.col("c_nationkey") % 5 == 0, F.col("c_nationkey") % 5 == 1, no),
        "balance": (F.col("c_acctbal") > 8000, F.col("c_acctbal") > 3000, F.col("entity") % 2 == 0),
        "segment": (no, F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment") == "BUILDING"),
        "orders": (no, F.coalesce("has", no), no),
    }
    return A.slot_coverage(c, slots)


@query(
    "schema_coverage",
    f"""SELECT entity, CAST(round_even(100.0 * count(*) FILTER (state IN ('merged', 'own', 'own+web')) / count(*), 0) AS BIGINT) AS percent,
    coalesce(string_agg(slot, ',' ORDER BY slot) FILTER (state = 'missing'), '') AS missing FROM {SLOTS_SQL} GROUP BY entity""",
)
def schema_coverage(t: Tables):
    return A.coverage_summary(cover(t), "entity")


@query(
    "slot_summary",
    f"""SELECT slot, count(*) FILTER (state = 'missing') AS n_missing, count(*) FILTER (state = 'waiting') AS n_waiting,
    CAST(round_even(100.0 * count(*) FILTER (state = 'missing') / count(*), 0) AS BIGINT) AS percent_missing FROM {SLOTS_SQL} GROUP BY slot""",
)
def slot_summary(t: Tables):
    return A.slot_summary(cover(t))


CARD_WEIGHTS = {"completeness": 0.25, "hard_knowledge": 0.25, "stories": 0.2, "recipe_score": 0.15, "source_score": 0.15}
CARDS_SQL = """(SELECT entity, completeness, hard_knowledge, stories, recipe_score, source_score,
 round(completeness * 0.25 + hard_knowledge * 0.25 + stories * 0.2 + recipe_score * 0.15 + source_score * 0.15, 1) AS score,
 concat_ws(',', CASE WHEN points = 0 THEN 'no_points' END, CASE WHEN stories_own + stories_web < 4 OR stories_foreign = 0 THEN 'few_stories' END,
 CASE WHEN distant = 0 THEN 'nothing_distant' END, CASE WHEN points > 0 AND NOT merged THEN 'to_merge' END, CASE WHEN NOT photos THEN 'no_photos' END,
 CASE WHEN percent < 60 THEN 'low_coverage' END, CASE WHEN special_recipes = 0 THEN 'no_recipes' END) AS flags
FROM (SELECT *, CAST(least(100, percent) AS DOUBLE) AS completeness,
 CAST(least(100, hard * 5 + languages * 10 + CASE WHEN distant > 0 THEN 20 ELSE 0 END) AS DOUBLE) AS hard_knowledge,
 CAST(least(100, (stories_own + stories_web + stories_foreign) * 6) AS DOUBLE) AS stories,
 CAST(least(100, special_recipes * 15 + CASE WHEN recipes > 0 THEN 10 ELSE 0 END) AS DOUBLE) AS recipe_score,
 CAST(least(100, sources * 10 + CASE WHEN photos THEN 20 ELSE 0 END + CASE WHEN merged THEN 10 ELSE 0 END) AS DOUBLE) AS source_score
 FROM (SELECT l_partkey AS entity, count(*) AS points, count(*) * 2 % 101 AS percent, count(*) FILTER (l_returnflag = 'A') AS hard,
 count(DISTINCT l_shipmonth) AS languages, count(*) FILTER (l_discount >= 0.09) AS distant, count(*) FILTER (l_linestatus = 'O' AND l_returnflag = 'R') AS stories_own,
 count(*) FILTER (l_tax < 0.02) AS stories_web, count(*) FILTER (l_tax < 0.01) AS stories_foreign, count(*) FILTER (l_quantity > 40) AS recipes,
 count(*) FILTER (l_quantity > 45) AS special_recipes, count(DISTINCT l_suppkey) AS sources, bool_or(l_discount = 0) AS photos, bool_or(l_quantity = 1) AS merged
 FROM (SELECT *, month(l_shipdate) % 4 AS l_shipmonth FROM lineitem) GROUP BY l_partkey)))"""


def cards(t: Tables):
    n = t.lineitem.groupBy(F.col("l_partkey").alias("entity")).agg(
        F.count("*").alias("points"),
        (F.count("*") * 2 % 101).alias("percent"),
        count_where(F.col("l_returnflag") == "A").alias("hard"),
        F.countDistinct(F.month("l_shipdate") % 4).alias("languages"),
        count_where(F.col("l_discount") >= 0.09).alias("distant"),
        count_where((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")).alias("stories_own"),
        count_where(F.col("l_tax") < 0.02).alias("stories_web"),
        count_where(F.col("l_tax") < 0.01).alias("stories_foreign"),
        count_where(F.col("l_quantity") > 40).alias("recipes"),
        count_where(F.col("l_quantity") > 45).alias("special_recipes"),
        F.countDistinct("l_suppkey").alias("sources"),
        F.bool_or(F.col("l_discount") == 0).alias("photos"),
        F.bool_or(F.col("l_quantity") == 1).alias("merged"),
    )
    return A.entity_scorecard(n, "entity", CARD_WEIGHTS)


@query("entity_scorecard", f"SELECT * FROM {CARDS_SQL}")
def entity_scorecard(t: Tables):
    return cards(t)


@query(
    "corpus_kpis",
    f"""SELECT count(*) AS entities, round(avg(score), 1) AS avg_score, round(avg(completeness), 1) AS avg_completeness,
    count(*) FILTER (NOT list_contains(string_split(flags, ','), 'few_stories')) AS with_stories,
    count(*) FILTER (list_contains(string_split(flags, ','), 'no_recipes')) AS without_recipes FROM {CARDS_SQL}""",
)
def corpus_kpis(t: Tables):
    return A.corpus_kpis(cards(t))


@query(
    "corpus_flags",
    f"SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(flags, ',')) AS flag FROM {CARDS_SQL}) WHERE flag <> '' GROUP BY flag",
)
def corpus_flags(t: Tables):
    return A.flag_counts(cards(t))


@query(
    "data_problem_rows",
    """WITH r AS (SELECT c_custkey AS entity, CASE WHEN c_custkey % 97 = 0 THEN c_custkey + 1 ELSE c_custkey END AS stored,
     CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_mktsegment || c_nationkey || '-' || CAST(floor(c_acctbal / 100) AS BIGINT) END AS key FROM customer)
    SELECT 'id_mismatch' AS problem, CAST(entity AS VARCHAR) AS entity, CAST(stored AS VARCHAR) AS detail FROM r WHERE stored <> entity
    UNION ALL SELECT 'shared_key', CAST(entity AS VARCHAR), key FROM r WHERE key IN (SELECT key FROM r WHERE key IS NOT NULL GROUP BY key HAVING count(*) > 1)""",
)
def data_problem_rows(t: Tables):
    key = F.concat(F.col("c_mktsegment"), F.col("c_nationkey").cast("string"), F.lit("-"), F.floor(F.col("c_acctbal") / 100).cast("string"))
    rows = t.customer.select(
        F.col("c_custkey").alias("entity"),
        F.when(F.col("c_custkey") % 97 == 0, F.col("c_custkey") + 1).otherwise(F.col("c_custkey")).alias("stored"),
        F.when(F.col("c_custkey") % 10 != 0, key).alias("key"),
    )
    return A.identity_problems(rows, "key", "entity", "stored")


@query(
    "category_counts",
    """SELECT category, count(*) AS n, count(*) FILTER (p_size > 25 AND category <> 'plain') AS n_foreign_special FROM (
    SELECT p_size, CASE WHEN p_type LIKE 'STAND%' THEN 'plain' WHEN p_name LIKE '%bolt%' THEN 'hardware' WHEN p_name LIKE '%ring%' THEN 'jewellery'
    ELSE lower(p_type) END AS category FROM part) GROUP BY category""",
)
def category_counts(t: Tables):
    category = (
        F.when(F.col("p_type").startswith("STAND"), "plain")
        .when(F.col("p_name").contains("bolt"), "hardware")
        .when(F.col("p_name").contains("ring"), "jewellery")
        .otherwise(F.lower("p_type"))
    )
    return A.category_counts(t.part, category, F.col("p_size") > 25, "plain")


@query(
    "site_tiles",
    COUNTERS
    + """ SELECT kind, CAST(sum(CASE WHEN day = '2024-01-30' THEN n ELSE 0 END) AS BIGINT) AS today, CAST(sum(CASE WHEN day >= '2024-01-24' THEN n ELSE 0 END) AS BIGINT) AS week,
    CAST(sum(CASE WHEN day >= '2024-01-10' THEN n ELSE 0 END) AS BIGINT) AS period, CAST(sum(n) AS BIGINT) AS all_time FROM counters GROUP BY kind""",
)
def site_tiles(t: Tables):
    return A.counter_tiles(standin(t, "counter_feed"), "2024-01-30", "2024-01-24", "2024-01-10")


@query(
    "site_topk_series",
    COUNTERS
    + """, s AS (SELECT kind, CASE WHEN contains(key, ':') THEN substr(key, strpos(key, ':') + 1) ELSE key END AS label, CAST(sum(n) AS BIGINT) AS n
    FROM counters WHERE day >= '2024-01-10' GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, label) AS rank FROM s QUALIFY rank <= 15""",
)
def site_topk_series(t: Tables):
    return A.counter_top(standin(t, "counter_feed"), "2024-01-10", 15)


@query(
    "site_series",
    COUNTERS
    + """, days AS (SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day FROM generate_series(DATE '2023-12-25', DATE '2024-01-30', INTERVAL 1 DAY) g(d)),
    s AS (SELECT days.day, CAST(coalesce(sum(n) FILTER (kind = 'view'), 0) AS BIGINT) AS n_view, CAST(coalesce(sum(n) FILTER (kind = 'click'), 0) AS BIGINT) AS n_click
    FROM days LEFT JOIN counters ON counters.day = days.day GROUP BY days.day)
    SELECT *, greatest(1, max(n_view) OVER ()) AS peak FROM s""",
)
def site_series(t: Tables):
    return A.counter_series(standin(t, "counter_feed"), "2023-12-25", "2024-01-30", ["view", "click"])


@query(
    "archive_rollup",
    COUNTERS
    + """ SELECT day, kind, key, n FROM counters WHERE day >= '2024-01-20' UNION ALL
    SELECT 'archiwum', kind, key, CAST(sum(n) AS BIGINT) FROM counters WHERE day < '2024-01-20' GROUP BY kind, key HAVING sum(n) <> 0""",
)
def archive_rollup(t: Tables):
    return A.archive_rollup(counters(t), "2024-01-20")


@query(
    "site_summary",
    COUNTERS
    + """ SELECT s.key, coalesce(c_name, s.key) AS name, s.n FROM (SELECT key, CAST(sum(n) AS BIGINT) AS n FROM counters WHERE kind = 'view' AND day >= '2024-01-24'
    GROUP BY key ORDER BY n DESC, key LIMIT 4) s LEFT JOIN customer ON s.key = 'c' || c_custkey""",
)
def site_summary(t: Tables):
    names = t.customer.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("name"))
    return A.counter_digest(standin(t, "counter_feed"), names, "2024-01-24", "view")


@query(
    "entity_value",
    COUNTERS
    + """, v AS (SELECT split_part(key, ':', 1) AS entity, n * CASE kind WHEN 'view' THEN 1.0 ELSE 0.5 END AS value FROM counters WHERE kind IN ('view', 'click') AND day >= '2024-01-05'
    UNION ALL SELECT 'c' || o_custkey, 2.0 FROM orders) SELECT entity, round(CAST(sum(value) AS DOUBLE), 6) AS value FROM v GROUP BY entity""",
)
def entity_value(t: Tables):
    refs = t.orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("entity"))
    return A.entity_value(standin(t, "counter_feed"), refs, "2024-01-05", {"view": 1.0, "click": 0.5})


@query(
    "source_yield",
    """SELECT source, count(*) AS pages, count(*) FILTER (quality = 1 AND toxic = 1) AS recipes, count(*) FILTER (quality = 1 AND toxic = 0) AS facts,
    count(*) >= 40 AND count(*) FILTER (quality = 1 AND toxic = 1) = 0 AND count(*) FILTER (quality = 1 AND toxic = 0) / greatest(count(*), 1) < 0.5 AS auto_off
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
)
def source_yield(t: Tables):
    items = t.documents.join(t.labels, "doc_id", "left")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    return A.source_yield(items, "source", good & toxic, good & ~toxic, min_pages=40, min_share=0.5)


@query(
    "misfit_sources",
    """SELECT * FROM (SELECT source, count(*) AS pages, count(*) FILTER (n_chars < 400) AS n_off, count(*) FILTER (quality = 1 AND toxic = 1) AS n_good
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source) WHERE (n_off >= 5 AND n_off > 3 * n_good) OR (pages >= 40 AND n_good = 0)""",
)
def misfit_sources(t: Tables):
    items = t.documents.join(t.labels, "doc_id", "left")
    return A.misfit_sources(items, "source", F.col("n_chars") < 400, (F.col("quality") == 1) & (F.col("toxic") == 1))


@query(
    "provider_yield",
    cte("query_log")
    + """ SELECT provider, count(*) AS asked, count(*) FILTER (used_url <> '') AS found, CAST(coalesce(sum(facts), 0) AS BIGINT) AS facts,
    CAST(max(created_at) AS VARCHAR) AS last_asked, count(*) >= 30 AND coalesce(sum(facts), 0) = 0 AS useless FROM query_log GROUP BY provider""",
)
def provider_yield(t: Tables):
    out = A.provider_yield(standin(t, "query_log"), "provider", 30)
    return out.withColumn("last_asked", F.col("last_asked").cast("string"))


@query(
    "closed_gaps",
    cte("query_log") + f" SELECT entity, slot, count(*) AS asked FROM query_log WHERE created_at >= {SINCE} GROUP BY entity, slot HAVING count(*) >= 5 AND max(facts) <= 0",
)
def closed_gaps(t: Tables):
    return A.closed_gaps(standin(t, "query_log"), "entity", "slot", F.expr("TIMESTAMP_NTZ '2024-01-08 00:00:00'"), 5)


@query(
    "meta_breakdown",
    """WITH f AS (SELECT unnest(['kind', 'tens', 'lang']) AS facet, unnest([coalesce(event_type, 'none'), CAST(CAST(floor(CAST(regexp_extract(props, '[0-9]+', 0) AS INT) / 10) AS INT) AS VARCHAR),
    substr(lower(event_type), 1, 2)]) AS value FROM events), n AS (SELECT facet, value, count(*) AS n FROM f GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) AS rank FROM n QUALIFY rank <= 15""",
)
def meta_breakdown(t: Tables):
    props = F.from_json("props", "k INT")
    facets = {"kind": F.coalesce("event_type", F.lit("none")), "tens": F.floor(props["k"] / 10), "lang": F.left(F.lower("event_type"), F.lit(2))}
    return A.facet_counts(t.events, facets, 15)


@query("discovery_counts", "SELECT n_name AS country, c_mktsegment AS status, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def discovery_counts(t: Tables):
    rows = t.customer.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    return rows.join(t.nation, rows.c_nationkey == t.nation.n_nationkey).select(F.col("n_name").alias("country"), F.col("c_mktsegment").alias("status"), "n")


@query(
    "model_task_summary",
    cte("decisions")
    + """, d AS (SELECT *, CASE WHEN known THEN predicted = label END AS agree, ref % 3 = 0 AS human FROM decisions WHERE ref >= 100)
    SELECT task, count(*) AS total, count(*) FILTER (decision = 'accept') AS n_accept, count(*) FILTER (decision = 'audit') AS n_audit, count(*) FILTER (decision = 'defer') AS n_defer,
    count(*) FILTER (agree) AS agreed, count(*) FILTER (NOT agree) AS disagreed, round(count(*) FILTER (agree) / count(*) FILTER (agree IS NOT NULL), 6) AS agreement,
    round(count(*) FILTER (agree AND decision = 'audit') / count(*) FILTER (agree IS NOT NULL AND decision = 'audit'), 6) AS audit_accuracy,
    count(*) FILTER (NOT agree AND NOT human) AS conflicts, count(*) FILTER (agree IS NOT NULL) >= 50 AND count(*) FILTER (agree) / count(*) FILTER (agree IS NOT NULL) >= 0.85 AS ready
    FROM d GROUP BY task""",
)
def model_task_summary(t: Tables):
    log = standin(t, "decisions").select(
        "task",
        "decision",
        F.when(F.col("known"), F.col("predicted") == F.col("label")).alias("agree"),
        F.when(F.col("ref") % 3 == 0, F.col("label")).alias("human_label"),
        F.col("ref").alias("created_at"),
    )
    out = A.task_digest(log, "task", F.lit(100), 50, 0.85)
    return out.withColumn("agreement", F.round("agreement", 6)).withColumn("audit_accuracy", F.round("audit_accuracy", 6))


@query(
    "class_quality",
    cte("decisions")
    + """, q AS (SELECT predicted, count(*) AS n, count(*) FILTER (predicted = label) AS agreed FROM decisions WHERE known AND confidence >= 0.5 GROUP BY predicted)
    SELECT predicted, n, agreed, round(agreed / n, 6) AS agreement, round(greatest(0, (agreed / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(agreed / n * (1 - agreed / n) / n
    + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS lower FROM q""",
)
def class_quality(t: Tables):
    agree = F.when(F.col("known"), F.col("predicted") == F.col("label"))
    return A.class_quality(standin(t, "decisions"), "predicted", agree, F.col("confidence"), 0.5)


@query(
    "group_report",
    cte("posts")
    + """ SELECT kind AS key, count(*) AS n, round(avg(overall), 1) AS avg_overall, round(avg(expert), 1) AS avg_expert, round(avg(code), 1) AS avg_code,
    CAST(round_even(100.0 * count(*) FILTER (overall >= 70) / count(*), 0) AS BIGINT) AS percent_publishable, count(*) FILTER (status = 'published') AS n_published
    FROM posts WHERE status <> 'rejected' GROUP BY kind""",
)
def group_report(t: Tables):
    rows = standin(t, "posts").filter("status <> 'rejected'")
    return A.group_report(rows, F.col("kind"), ["overall", "expert", "code"], F.col("overall") >= 70, F.col("status") == "published")


@query(
    "bucket_report",
    """WITH b AS (SELECT CASE WHEN l_quantity < 12 THEN 'to 11' WHEN l_quantity < 16 THEN '12-15' WHEN l_quantity <= 20 THEN '16-20' ELSE 'over 20' END AS bucket, l_discount * 100 AS v FROM lineitem),
    n AS (SELECT bucket, CASE bucket WHEN 'to 11' THEN 0 WHEN '12-15' THEN 1 WHEN '16-20' THEN 2 ELSE 3 END AS place, count(*) AS n, avg(v) AS mean FROM b GROUP BY bucket)
    SELECT bucket, place, n, round(mean, 6) AS mean, place = first(place) OVER (ORDER BY round(mean, 1) DESC, place) AS is_best FROM n""",
)
def bucket_report(t: Tables):
    q = F.col("l_quantity")
    buckets = [("to 11", q < 12), ("12-15", q < 16), ("16-20", q <= 20), ("over 20", F.lit(True))]
    return A.bucket_report(t.lineitem, F.col("l_discount") * 100, buckets)


@query(
    "score_histogram",
    cte("posts")
    + """ SELECT CAST(i AS INT) AS bin, count(post_id) AS n FROM range(10) r(i) LEFT JOIN posts ON least(9, CAST(floor(overall / 10) AS INT)) = i GROUP BY i""",
)
def score_histogram(t: Tables):
    return A.score_histogram(standin(t, "posts"), F.col("overall"))


@query(
    "daily_trend",
    cte("posts") + """ SELECT CAST(day AS VARCHAR) AS day, round(avg(overall), 6) AS mean, count(*) AS n FROM posts WHERE day >= (SELECT max(day) FROM posts) - 30 GROUP BY day""",
)
def daily_trend(t: Tables):
    return A.daily_trend(standin(t, "posts"), F.col("day"), F.col("overall"))


@query(
    "pearson_corr",
    """SELECT l_suppkey, round(CASE WHEN count(*) >= 3 AND stddev_pop(l_quantity) > 0 AND stddev_pop(l_extendedprice) > 0 THEN corr(l_quantity, l_extendedprice) END, 6) AS corr
    FROM lineitem GROUP BY l_suppkey""",
)
def pearson_corr(t: Tables):
    corr = A.guarded_corr(F.col("l_quantity"), F.col("l_extendedprice"))
    return t.lineitem.groupBy("l_suppkey").agg(F.round(corr, 6).alias("corr"))


@query(
    "issue_rate",
    """WITH c AS (SELECT list_filter([CASE WHEN n_chars < 120 THEN 'short' END, CASE WHEN contains(text, '!!') THEN 'shouting' END, CASE WHEN contains(text, '###') THEN 'noise' END,
    CASE WHEN regexp_matches(text, '[0-9]{3}') THEN 'digits' END], lambda x: x IS NOT NULL) AS codes FROM documents)
    SELECT issue, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM c), 6) AS percent FROM (SELECT unnest(codes) AS issue FROM c) GROUP BY issue""",
)
def issue_rate(t: Tables):
    codes = F.array_compact(
        F.array(
            F.when(F.col("n_chars") < 120, "short"),
            F.when(F.col("text").contains("!!"), "shouting"),
            F.when(F.col("text").contains("###"), "noise"),
            F.when(F.col("text").rlike("[0-9]{3}"), "digits"),
        )
    )
    return A.issue_rates(t.documents, codes)


@query(
    "reviewer_gap",
    cte("posts") + """ SELECT reviewer, count(*) AS n, round(avg(expert), 6) AS expert, round(avg(code), 6) AS code, round(avg(expert - code), 6) AS gap FROM posts WHERE expert IS NOT NULL GROUP BY reviewer""",
)
def reviewer_gap(t: Tables):
    return A.reviewer_gap(standin(t, "posts"), "reviewer", F.col("expert"), F.col("code"))


@query(
    "prediction_vs_actual",
    """SELECT coalesce(CASE WHEN quality = 1 THEN 'high' WHEN toxic = 1 THEN 'low' END, 'none') AS predicted, count(*) AS n, round(avg(n_chars), 6) AS mean_actual
    FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
)
def prediction_vs_actual(t: Tables):
    rows = t.documents.join(t.labels, "doc_id", "left")
    predicted = F.when(F.col("quality") == 1, "high").when(F.col("toxic") == 1, "low")
    return A.mean_by_prediction(rows, predicted, F.col("n_chars"), "none")


@query(
    "criteria_means",
    """WITH n AS (SELECT event_type AS criterion, avg(CAST(regexp_extract(props, '[0-9]+', 0) AS INT)) AS mean, count(*) AS n FROM events GROUP BY 1
    UNION ALL SELECT 'all', avg(value), count(value) FROM events)
    SELECT criterion, round(mean, 6) AS mean, n, row_number() OVER (ORDER BY mean, criterion) <= 2 AS is_weakest FROM n""",
)
def criteria_means(t: Tables):
    k = F.from_json("props", "map<string,double>")["k"]
    return A.criteria_means(t.events, F.create_map(F.col("event_type"), k, F.lit("all"), F.col("value")))


@query(
    "usage_rollup",
    cte("calls")
    + """ SELECT purpose, CAST(coalesce(sum(tokens) FILTER (day = '2024-01-30' AND NOT local), 0) AS BIGINT) AS cloud_today, CAST(coalesce(sum(tokens) FILTER (day = '2024-01-30' AND local), 0) AS BIGINT) AS local_today,
    count(*) FILTER (day = '2024-01-30') AS requests_today, CAST(sum(tokens) AS BIGINT) AS week_total,
    CASE purpose WHEN 'view' THEN 500 WHEN 'click' THEN 90000000 ELSE 0 END > 0 AND coalesce(sum(tokens) FILTER (day = '2024-01-30' AND NOT local), 0) >= CASE purpose WHEN 'view' THEN 500 WHEN 'click' THEN 90000000 ELSE 0 END AS over_budget
    FROM calls WHERE day > '2024-01-23' AND day <= '2024-01-30' GROUP BY purpose""",
)
def usage_rollup(t: Tables):
    return A.usage_rollup(standin(t, "calls"), "2024-01-30", 7, {"view": 500, "click": 90000000})


@query(
    "char_usage_rollup",
    cte("calls")
    + """ SELECT model AS engine, substr(day, 1, 7) AS month, CAST(sum(tokens) AS BIGINT) AS total, CAST(coalesce(sum(tokens) FILTER (purpose <> 'view'), 0) AS BIGINT) AS knowledge,
    CAST(coalesce(sum(tokens) FILTER (day = '2024-01-30'), 0) AS BIGINT) AS today, CAST(greatest(0, 300000 - sum(tokens)) AS BIGINT) AS budget_left FROM calls WHERE tokens > 0 GROUP BY 1, 2""",
)
def char_usage_rollup(t: Tables):
    log = standin(t, "calls").withColumnsRenamed({"model": "engine", "tokens": "chars"})
    return A.char_usage(log, F.left("day", F.lit(7)), F.col("day"), "2024-01-30", F.col("purpose") != "view", 300000)


YIELDS_SQL = cte("runs") + """, y AS (SELECT kind, count(*) AS n, sum(value * CASE kind WHEN 'purchase' THEN 3.0 WHEN 'click' THEN 2.0 ELSE 1.0 END) AS value,
    sum(greatest(1.0, value / 3)) AS minutes FROM runs WHERE status IN ('done', 'blocked') GROUP BY kind), z AS (SELECT *, round(value / minutes, 4) AS per_minute FROM y)"""


@query(
    "ucb_bonus",
    YIELDS_SQL
    + """ SELECT kind, n, round(value, 4) AS value, round(minutes, 4) AS minutes, per_minute, round(least(10, greatest(-5, 10 * (per_minute / (SELECT max(per_minute) FROM z)
    + 0.5 * sqrt(ln((SELECT sum(n) FROM z) + 1) / (n + 1)) - 0.5))), 2) AS bonus FROM z""",
)
def ucb_bonus(t: Tables):
    runs = standin(t, "runs").filter(F.col("status").isin("done", "blocked"))
    weight = F.when(F.col("kind") == "purchase", 3.0).when(F.col("kind") == "click", 2.0).otherwise(1.0)
    y = A.kind_yields(runs, "kind", F.col("value") * weight, F.col("value") / 3)
    return A.ucb_bonus(y).withColumn("value", F.round("value", 4)).withColumn("minutes", F.round("minutes", 4))


@query(
    "placement_usage",
    "SELECT l_returnflag AS place, l_linestatus AS part, count(*) AS points, count(DISTINCT l_orderkey) AS entities FROM lineitem GROUP BY ALL",
)
def placement_usage(t: Tables):
    rows = t.lineitem.select("l_orderkey", F.col("l_returnflag").alias("place"), F.col("l_linestatus").alias("part"))
    return A.layout_usage(rows, "l_orderkey", "place", "part")


@query(
    "gate_summary",
    cte("facts")
    + """, w AS (SELECT entity, count(*) AS waiting FROM facts WHERE status = 'verified' GROUP BY entity)
    SELECT c_custkey AS entity, coalesce(waiting, 0) AS waiting, c_acctbal > 5000 AS blocked FROM customer LEFT JOIN w ON c_custkey = entity WHERE c_mktsegment = 'BUILDING'""",
)
def gate_summary(t: Tables):
    until = F.when(F.col("c_acctbal") > 5000, F.lit("2024-03-01").cast("timestamp_ntz"))
    rejected = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("entity"), until.alias("blocked_until"))
    return A.gate_summary(rejected, standin(t, "facts").filter("status = 'verified'"), "entity", now_col())


@query(
    "daily_changelog_merge",
    cte("facts")
    + """ SELECT CAST(CAST(created_at + INTERVAL 1 HOUR AS DATE) AS VARCHAR) AS day, entity, CAST(sum(floor(value)) AS BIGINT) AS added, array_to_string(list_sort(list(DISTINCT lang)), ',') AS languages FROM facts GROUP BY 1, 2""",
)
def daily_changelog_merge(t: Tables):
    local = F.to_date(F.col("created_at") + F.expr("INTERVAL 1 HOUR")).cast("string")
    return A.daily_changelog(standin(t, "facts"), local, "entity", F.floor("value"), F.col("lang"))


@query(
    "provider_utility",
    cte("calls")
    + """, n AS (SELECT model, count(*) AS calls, count(*) FILTER (ok) AS successes, avg(latency) AS latency, max(base) AS base FROM calls GROUP BY model),
    u AS (SELECT *, CASE WHEN calls >= 20 THEN base * (successes + 1) / (calls + 2) / (1 + log10(1 + latency / 5.0)) ELSE base END AS utility FROM n)
    SELECT model, calls, successes, round(latency, 6) AS latency, base, round(utility, 6) AS utility, row_number() OVER (ORDER BY utility DESC, model) AS rank FROM u""",
)
def provider_utility(t: Tables):
    out = A.provider_utility(standin(t, "calls"), "model", F.col("ok"), F.col("latency"), F.col("base"))
    return out.withColumn("latency", F.round("latency", 6)).withColumn("utility", F.round("utility", 6))


@query(
    "unknown_term_counts",
    r"""SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS term FROM documents) WHERE length(term) >= 3
    AND term NOT IN (SELECT unnest(string_split(p_name, ' ')) FROM part) GROUP BY term""",
)
def unknown_term_counts(t: Tables):
    words = t.documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    known = t.part.select(F.explode(F.split("p_name", " ")).alias("term")).distinct()
    return A.term_counts(words, F.col("word"), known)


@query(
    "work_backlog",
    cte("runs")
    + """, w AS (SELECT 'to_publish' AS grp, o_orderkey AS item FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' UNION ALL
    SELECT 'stale', o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00' AND o_orderstatus = 'P' UNION ALL SELECT 'failed', run_id FROM runs WHERE status = 'failed'
    UNION ALL SELECT 'no_orders', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
    SELECT grp AS "group", item, count(*) OVER (PARTITION BY grp) AS size, row_number() OVER (PARTITION BY grp ORDER BY item) AS rank FROM w QUALIFY rank <= 5""",
)
def work_backlog(t: Tables):
    o = t.orders.withColumnRenamed("o_orderkey", "item")
    groups = {
        "to_publish": o.filter("o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'"),
        "stale": o.filter("o_orderdate < TIMESTAMP_NTZ '1996-01-01 00:00:00' AND o_orderstatus = 'P'"),
        "failed": standin(t, "runs").filter("status = 'failed'").withColumnRenamed("run_id", "item"),
        "no_orders": t.customer.join(t.orders, t.customer.c_custkey == t.orders.o_custkey, "left_anti").withColumnRenamed("c_custkey", "item"),
    }
    return A.backlog(groups, "item", 5)


@query(
    "palette_overview",
    cte("facts")
    + """, f AS (SELECT entity, count(*) AS a, count(*) FILTER (value > 50) AS b, count(*) FILTER (status = 'new') AS c FROM facts GROUP BY entity),
    m AS (SELECT p_partkey, entity, a, b, c FROM part LEFT JOIN f ON entity % 50 = p_partkey % 50 AND p_partkey % 7 < 3)
    SELECT p_partkey AS item, CAST(coalesce(sum(a), 0) AS BIGINT) AS n_all, CAST(coalesce(sum(b), 0) AS BIGINT) AS n_topic, CAST(coalesce(sum(c), 0) AS BIGINT) AS n_to_verify FROM m GROUP BY item""",
)
def palette_overview(t: Tables):
    items = t.part.select(F.col("p_partkey").alias("item"))
    facts = standin(t, "facts").withColumn("on_topic", F.col("value") > 50)
    entities = facts.select("entity").distinct().withColumn("slot", F.col("entity") % 50)
    mapping = items.filter("item % 7 < 3").withColumn("slot", F.col("item") % 50).join(entities, "slot").select("item", "entity")
    return A.item_overview(items, mapping, facts, "item", "entity")


@query(
    "label_teacher_stats",
    """SELECT 'label' AS facet, CAST(quality AS VARCHAR) AS value, count(*) AS n FROM labels GROUP BY quality UNION ALL
    SELECT 'origin', CAST(source AS VARCHAR), count(*) FROM labels JOIN documents USING (doc_id) GROUP BY source""",
)
def label_teacher_stats(t: Tables):
    return A.label_origin_stats(t.labels.join(t.documents, "doc_id"), "quality", "source")


@query(
    "load_summary",
    cte("calls", "runs")
    + """, j AS (SELECT count(*) AS jobs FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'),
    c AS (SELECT count(*) FILTER (NOT local) AS remote_calls, count(*) FILTER (NOT local AND ok) AS remote_ok, count(*) FILTER (local AND NOT ok) AS local_queue FROM calls WHERE called_at >= TIMESTAMP '2024-01-30 22:00:00')
    SELECT *, concat_ws(';', CASE WHEN jobs >= 10 THEN 'jobs' END, CASE WHEN remote_calls >= 6 AND remote_ok / remote_calls < 0.3 THEN 'remote' END, CASE WHEN local_queue >= 2 THEN 'queue' END) AS reasons,
    concat_ws(';', CASE WHEN jobs >= 10 THEN 'jobs' END, CASE WHEN remote_calls >= 6 AND remote_ok / remote_calls < 0.3 THEN 'remote' END, CASE WHEN local_queue >= 2 THEN 'queue' END) <> '' AS overloaded FROM j, c""",
)
def load_summary(t: Tables):
    jobs = t.orders.select(F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT"), "queued").otherwise("done").alias("status"))
    return A.load_summary(jobs, standin(t, "calls"), F.expr("TIMESTAMP_NTZ '2024-01-30 22:00:00'"), 10)


@query(
    "topic_lookup_sets",
    cte("facts") + " SELECT entity, array_to_string(list_sort(list(DISTINCT lang || section)), ',') AS languages, count(*) AS n_facts FROM facts GROUP BY entity",
)
def topic_lookup_sets(t: Tables):
    return A.topic_sets(standin(t, "facts"), "entity", F.concat("lang", "section"))


@query(
    "idea_counts",
    """SELECT quality AS status, count(*) AS n, count(*) FILTER (toxic = 1) AS used, array_to_string(list_sort(list(DISTINCT lang) FILTER (lang <> 'en')), ',') AS foreign_langs
    FROM documents JOIN labels USING (doc_id) GROUP BY quality""",
)
def idea_counts(t: Tables):
    rows = t.documents.join(t.labels, "doc_id")
    return rows.groupBy(F.col("quality").alias("status")).agg(
        F.count("*").alias("n"),
        count_where(F.col("toxic") == 1).alias("used"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("lang") != "en", F.col("lang")))), ",").alias("foreign_langs"),
    )


@query(
    "change_summary",
    """WITH p AS (SELECT p_partkey AS entity, string_split(p_name, ' ') AS points, [p_brand] AS langs FROM part WHERE p_partkey % 10 <> 3),
    n AS (SELECT p_partkey AS entity, CASE WHEN p_partkey % 4 = 0 THEN list_append(string_split(p_name, ' '), 'extra') ELSE string_split(p_name, ' ') END AS points,
    CASE WHEN p_partkey % 6 = 0 THEN [p_brand, p_type] WHEN p_partkey % 6 = 1 THEN [p_type] ELSE [p_brand] END AS langs FROM part WHERE p_partkey % 10 <> 7),
    d AS (SELECT coalesce(p.entity, n.entity) AS entity, p.entity IS NULL AS is_new, len(list_distinct(list_filter(coalesce(n.points, []), lambda x: NOT list_contains(coalesce(p.points, []), x)))) AS added_points,
    len(list_distinct(list_filter(coalesce(p.points, []), lambda x: NOT list_contains(coalesce(n.points, []), x)))) AS removed_points,
    len(list_filter(coalesce(n.langs, []), lambda x: NOT list_contains(coalesce(p.langs, []), x))) AS added_langs, len(list_filter(coalesce(p.langs, []), lambda x: NOT list_contains(coalesce(n.langs, []), x))) AS removed_langs
    FROM p FULL JOIN n ON p.entity = n.entity) SELECT * FROM d WHERE is_new OR added_points + removed_points + added_langs + removed_langs > 0""",
)
def change_summary(t: Tables):
    words = F.split("p_name", " ")
    old = t.part.filter("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("entity"), words.alias("points"), F.array("p_brand").alias("langs"))
    grown = F.when(F.col("p_partkey") % 4 == 0, F.array_append(words, "extra")).otherwise(words)
    langs = F.when(F.col("p_partkey") % 6 == 0, F.array("p_brand", "p_type")).when(F.col("p_partkey") % 6 == 1, F.array("p_type")).otherwise(F.array("p_brand"))
    new = t.part.filter("p_partkey % 10 <> 7").select(F.col("p_partkey").alias("entity"), grown.alias("points"), langs.alias("langs"))
    return A.version_changes(old, new, "entity", ["points", "langs"])
