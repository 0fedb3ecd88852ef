"""Registered ranking and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.operators import ranking as R
from florilege.plans.aggregates import SLOTS_SQL, cover
from florilege.operators.primitives import quantile_bucket
from florilege.plans.registry import Tables, query
from florilege.plans.sequences import ntz
from florilege.plans.standins import cte, standin


@query(
    "entities_to_research",
    """WITH m AS (SELECT o_custkey AS entity, count(*) AS mentions, max(o_orderdate) AS last FROM orders GROUP BY 1),
    e AS (SELECT c_custkey AS entity, c_name AS name, c_acctbal AS value, mentions, CASE WHEN c_custkey % 3 = 0 THEN last END AS last_research, c_nationkey * 4.0 AS coverage FROM customer LEFT JOIN m ON entity = c_custkey
    WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error') AND c_mktsegment <> 'FURNITURE')
    SELECT entity, name FROM e ORDER BY CASE WHEN last_research IS NULL THEN 0 ELSE 1 END, CASE WHEN last_research IS NULL THEN -value ELSE coverage END, CASE WHEN last_research IS NULL THEN -coalesce(mentions, 0) ELSE 0 END,
    last_research, name, entity LIMIT 700""",
)
def entities_to_research(t: Tables):
    m = t.orders.groupBy(F.col("o_custkey").alias("entity")).agg(F.count("*").alias("mentions"), F.max("o_orderdate").alias("last"))
    e = t.customer.withColumnRenamed("c_custkey", "entity").join(m, "entity", "left")
    e = e.select(
        "entity", F.col("c_name").alias("name"), F.col("c_acctbal").alias("value"), "mentions",
        F.when(F.col("entity") % 3 == 0, F.col("last")).alias("last_research"), (F.col("c_nationkey") * 4.0).alias("coverage"),
    )
    blocked = t.events.filter("event_type = 'error'").select(F.col("user_id").alias("entity"))
    odd = t.customer.filter("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("entity"))
    return R.entities_to_research(e, "entity", [blocked, odd], 700).select("entity", "name")


@query(
    "entities_for_topic",
    """WITH c AS (SELECT l_partkey AS entity, count(*) AS n_facts FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), s AS (SELECT l_partkey AS entity, max(l_shipdate) AS last_search FROM lineitem WHERE l_tax > 0.07 GROUP BY 1),
    l AS (SELECT l_partkey AS entity, count(*) AS open_leads FROM lineitem WHERE l_discount > 0.095 GROUP BY 1)
    SELECT p_partkey AS entity FROM part LEFT JOIN c ON c.entity = p_partkey LEFT JOIN s ON s.entity = p_partkey LEFT JOIN l ON l.entity = p_partkey
    ORDER BY last_search IS NOT NULL AND coalesce(open_leads, 0) = 0, NOT p_type IN ('PROMO', 'LARGE'), coalesce(n_facts, 0), last_search NULLS FIRST, p_partkey LIMIT 300""",
)
def entities_for_topic(t: Tables):
    li = t.lineitem.withColumnRenamed("l_partkey", "entity")
    counts = li.filter("l_returnflag = 'R'").groupBy("entity").agg(F.count("*").alias("n_facts"))
    searches = li.filter("l_tax > 0.07").groupBy("entity").agg(F.max("l_shipdate").alias("last_search"))
    leads = li.filter("l_discount > 0.095").groupBy("entity").agg(F.count("*").alias("open_leads"))
    entities = t.part.select(F.col("p_partkey").alias("entity"), "p_type")
    return R.entities_for_topic(entities, "entity", counts, searches, leads, F.col("p_type").isin("PROMO", "LARGE"), 300).select("entity")


@query(
    "lead_order",
    cte("facts")
    + """, c AS (SELECT DISTINCT lang FROM facts WHERE value > 300) SELECT fact_id, lang FROM facts LEFT JOIN c USING (lang)
    ORDER BY entity % 4, lang IN (SELECT lang FROM c), floor(value / 20) DESC, fact_id LIMIT 500""",
)
def lead_order(t: Tables):
    f = standin(t, "facts")
    leads = f.select("fact_id", "lang", (F.col("entity") % 4).alias("depth"), F.floor(F.col("value") / 20).alias("parent_yield"))
    return R.lead_order(leads, f.filter("value > 300"), "lang", "fact_id", 500).select("fact_id", "lang")


@query(
    "recipe_leads_due",
    """SELECT event_id FROM events WHERE event_type <> 'error' AND user_id % 5 < 3 ORDER BY user_id % 5, value > 20 , CASE WHEN value > 20 THEN ts END, event_id LIMIT 400""",
)
def recipe_leads_due(t: Tables):
    leads = t.events.select(
        "event_id", F.when(F.col("event_type") == "error", "closed").otherwise("open").alias("status"), (F.col("user_id") % 5).alias("attempts"),
        F.when(F.col("value") > 20, F.col("ts")).alias("last_search"),
    )
    return R.recipe_leads_due(leads, "event_id", 3, 400).select("event_id")


@query(
    "diverse_pick",
    """WITH r AS (SELECT s_suppkey AS s, s_nationkey % 3 AS lang, s_suppkey % 4 AS kind, n_regionkey AS entity, row_number() OVER (PARTITION BY s_nationkey % 3, s_suppkey % 4, n_regionkey ORDER BY s_suppkey * 37 % 101) AS rn, s_suppkey * 37 % 101 AS rank
    FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT entity, s AS supplier, row_number() OVER (PARTITION BY entity ORDER BY CASE WHEN rn = 1 THEN 0 ELSE 1 END, rank) AS pick FROM r QUALIFY pick <= 15""",
)
def diverse_pick(t: Tables):
    s = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("entity"), F.col("s_suppkey").alias("supplier"), (F.col("s_nationkey") % 3).alias("lang"),
        (F.col("s_suppkey") % 4).alias("kind"), (F.col("s_suppkey") * 37 % 101).alias("rank"),
    )
    return R.diverse_pick(s, "entity", ["lang", "kind"], "rank", 15).select("entity", "supplier", "pick")


@query(
    "language_plan",
    cte("facts")
    + """, r AS (SELECT entity, lang, bool_or(value > 150) AS read, max(CASE WHEN value > 150 THEN created_at END) AS read_at FROM (SELECT entity, section AS lang, value, created_at FROM facts) GROUP BY 1, 2),
    k AS (SELECT *, CASE lang WHEN 'sec5' THEN 0 WHEN 'sec2' THEN 1 ELSE 2 END AS place FROM r WHERE lang = 'sec6' OR NOT read OR read_at IS NULL OR read_at < TIMESTAMP '2024-01-20 00:00:00'),
    n AS (SELECT entity, lang, CASE WHEN read THEN 'refresh' ELSE 'new' END AS why FROM k WHERE lang <> 'sec6' QUALIFY row_number() OVER (PARTITION BY entity ORDER BY read, CASE WHEN read THEN read_at END NULLS FIRST, place, lang) <= 3)
    SELECT * FROM n UNION ALL SELECT entity, lang, 'always' FROM k WHERE lang = 'sec6'""",
)
def language_plan(t: Tables):
    f = standin(t, "facts").withColumn("lang", F.col("section"))
    reads = f.groupBy("entity", "lang").agg(F.bool_or(F.col("value") > 150).alias("read"), F.max(F.when(F.col("value") > 150, F.col("created_at"))).alias("read_at"))
    return R.language_plan(reads, "entity", "lang", ["sec5", "sec2"], ["sec6"], 3, ntz("2024-01-20 00:00:00"))


@query(
    "one_per_label",
    """WITH l AS (SELECT p_brand AS entity, p_partkey, CASE WHEN p_name LIKE '%ring%' THEN 'ring' WHEN p_name LIKE '%bolt%' THEN 'bolt' WHEN p_name LIKE '%widget%' THEN 'widget' ELSE 'other' END AS label FROM part),
    f AS (SELECT entity, label, min(p_partkey) AS p_partkey FROM l GROUP BY 1, 2)
    SELECT *, row_number() OVER (PARTITION BY entity ORDER BY CASE label WHEN 'bolt' THEN 0 WHEN 'other' THEN 1 WHEN 'ring' THEN 2 ELSE 3 END) AS rank FROM f QUALIFY rank <= 3""",
)
def one_per_label(t: Tables):
    label = F.coalesce(*[F.when(F.col("p_name").contains(w), w) for w in ("ring", "bolt", "widget")], F.lit("other"))
    return R.one_per_label(t.part.withColumnRenamed("p_brand", "entity"), "entity", label, ["bolt", "other", "ring"], "p_partkey", 3)


@query(
    "season_pick",
    """WITH e AS (SELECT o_custkey AS entity, list_sort(list(DISTINCT month(o_orderdate))) AS months, bool_or(o_orderpriority = '1-URGENT') AS harvest, bool_or(o_totalprice > 400000) AS recipes, count(*) > 12 AS facts FROM orders GROUP BY 1),
    s AS (SELECT entity, CASE WHEN list_has_any(months, [4, 5]) THEN 3 + CASE WHEN harvest THEN 2 ELSE 0 END ELSE 0 END + CASE WHEN recipes THEN 1 ELSE 0 END + CASE WHEN facts THEN 0.5 ELSE 0 END + (entity * 7919 % 1000) / 1000.0
    - CASE WHEN entity % 10 = 3 THEN 10 ELSE 0 END AS score FROM e) SELECT entity, round(CAST(score AS DOUBLE), 6) AS score FROM s ORDER BY score DESC, entity LIMIT 200""",
)
def season_pick(t: Tables):
    e = t.orders.groupBy(F.col("o_custkey").alias("entity")).agg(
        F.collect_set(F.month("o_orderdate")).alias("months"),
        F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("harvest"),
        F.bool_or(F.col("o_totalprice") > 400000).alias("recipes"),
        (F.count("*") > 12).alias("facts"),
    )
    now = R.season_months(F.lit("2024-04-25").cast("date"))
    score = R.season_score(F.col("months"), now, F.col("harvest"), F.col("recipes"), F.col("facts")) + (F.col("entity") * 7919 % 1000) / 1000.0
    recent = t.customer.filter("c_custkey % 10 = 3").select(F.col("c_custkey").alias("entity"))
    return R.season_pick(e, "entity", score, recent, 200).select("entity", "score")


@query(
    "idea_pool",
    """SELECT doc_id, CAST(n_chars % 100 + CASE WHEN doc_id % 12 + 1 = 5 OR doc_id % 7 + 1 = 5 THEN 8 ELSE 0 END AS DOUBLE) AS total FROM documents LEFT JOIN labels USING (doc_id)
    WHERE coalesce(quality, 1) = 1 AND coalesce(toxic, 0) = 0 AND doc_id NOT IN (SELECT item_id * 5 FROM benchmark) ORDER BY total DESC, doc_id LIMIT 50""",
)
def idea_pool(t: Tables):
    ideas = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id", F.when(F.col("quality").isNull(), "new").when(F.col("quality") == 1, "rated").otherwise("rejected").alias("status"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("risky"), (F.col("n_chars") % 100).cast("double").alias("score"),
        F.array((F.col("doc_id") % 12 + 1).cast("int"), (F.col("doc_id") % 7 + 1).cast("int")).alias("months"),
    )
    used = t.benchmark.select((F.col("item_id") * 5).alias("doc_id"))
    return R.idea_pool(ideas, "doc_id", used, 5, 50).select("doc_id", "total")


@query(
    "recipe_pick",
    """SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 3 ELSE 0 END + CASE WHEN o_custkey % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderpriority <> '5-LOW' THEN 1.5 ELSE 0 END + CASE WHEN o_totalprice > 300000 THEN 1 ELSE 0 END + (o_orderkey * 31 % 2000) / 1000.0 AS score
    FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) ORDER BY score DESC, o_orderkey LIMIT 1""",
)
def recipe_pick(t: Tables):
    score = R.recipe_score(F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 3 == 0, F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice") > 300000)
    score = score + (F.col("o_orderkey") * 31 % 2000) / 1000.0
    used = t.lineitem.filter("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.best_unused(t.orders.filter("o_orderstatus <> 'P'"), "o_orderkey", used, score)


TOPIC_OF = {"nation": "origin", "balance": "uses"}
PRIORITY = ["uses", "history", "origin", "general"]
GAPS_SQL = f"""(SELECT *, CASE topic WHEN 'uses' THEN 0 WHEN 'history' THEN 1 WHEN 'origin' THEN 2 ELSE 3 END AS place FROM (
SELECT entity, slot, CASE slot WHEN 'nation' THEN 'origin' WHEN 'balance' THEN 'uses' ELSE 'general' END AS topic FROM {SLOTS_SQL} WHERE state = 'missing'
UNION ALL SELECT c_custkey, 'part.' || lower(c_mktsegment), 'history' FROM customer WHERE c_acctbal < 1000))"""


def gaps(t: Tables):
    part_gaps = t.customer.filter("c_acctbal < 1000").select(F.col("c_custkey").alias("entity"), F.concat(F.lit("part."), F.lower("c_mktsegment")).alias("slot"), F.lit("history").alias("topic"))
    return R.gap_list(cover(t).select("entity", "slot", "state"), part_gaps, "entity", TOPIC_OF, PRIORITY)


@query("gap_list", f"SELECT * FROM {GAPS_SQL}")
def gap_list(t: Tables):
    return gaps(t)


@query(
    "gap_queries",
    f"""WITH tl AS (SELECT * FROM (VALUES ('uses', 'en', 'traditional uses', 0), ('uses', 'de', 'Verwendung', 1), ('uses', 'fr', 'usages', 2), ('history', 'de', 'Geschichte', 0), ('history', 'en', 'history', 1), ('origin', 'fr', 'origine', 0), ('general', 'en', 'overview', 0)) v(topic, lang, words, lang_order)),
    nm AS (SELECT c_custkey AS entity, unnest(['en', 'de', 'fr']) AS lang, unnest([c_name, CASE WHEN c_custkey % 2 = 0 THEN c_name || ' (de)' END, c_mktsegment]) AS name FROM customer),
    f AS (SELECT entity, topic, min(place) AS place FROM {GAPS_SQL} GROUP BY ALL),
    q AS (SELECT f.entity, f.topic, place, tl.lang, '"' || name || '" ' || words AS query, lang_order FROM f JOIN tl ON f.topic = tl.topic JOIN nm ON nm.entity = f.entity AND nm.lang = tl.lang WHERE name IS NOT NULL
    AND NOT (f.entity % 5 = 0 AND tl.lang = 'en')), r AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY entity, topic ORDER BY lang_order, lang) <= 2)
    SELECT entity, topic, lang, query FROM r QUALIFY dense_rank() OVER (PARTITION BY entity ORDER BY place, topic) <= 2""",
)
def gap_queries(t: Tables):
    topics = t.spark.createDataFrame(
        [("uses", "en", "traditional uses", 0), ("uses", "de", "Verwendung", 1), ("uses", "fr", "usages", 2), ("history", "de", "Geschichte", 0), ("history", "en", "history", 1), ("origin", "fr", "origine", 0), ("general", "en", "overview", 0)],
        "topic string, lang string, words string, lang_order int",
    )
    de = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit(" (de)")))
    pairs = F.array(F.struct(F.lit("en").alias("lang"), F.col("c_name").alias("name")), F.struct(F.lit("de").alias("lang"), de.alias("name")), F.struct(F.lit("fr").alias("lang"), F.col("c_mktsegment").alias("name")))
    names = t.customer.select(F.col("c_custkey").alias("entity"), F.inline(pairs)).filter("name IS NOT NULL")
    words = F.array(F.lit("traditional uses"), F.lit("history"), F.lit("overview"))
    asked = t.customer.filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("entity"), F.concat(F.lit('"'), "c_name", F.lit('" ')).alias("head"), F.explode(words).alias("w"))
    asked = asked.select("entity", F.concat("head", "w").alias("query"))
    return R.gap_queries(gaps(t), "entity", names, topics, asked, max_topics=2)


@query(
    "template_queries",
    """WITH n AS (SELECT p_name AS name, row_number() OVER (ORDER BY p_name) - 1 AS pos FROM (SELECT DISTINCT p_name FROM part)),
    c AS (SELECT name || ' ' || ['tincture', 'ointment', 'syrup'][CAST((pos + r) % 3 AS INT) + 1] AS query, r, pos FROM n, (SELECT unnest([0, 1, 2]) AS r)),
    u AS (SELECT lower(p_name) || ' syrup' AS q FROM part WHERE p_size > 45), k AS (SELECT query, row_number() OVER (ORDER BY r, pos) - 1 AS i FROM c WHERE lower(query) NOT IN (SELECT q FROM u)),
    g AS (SELECT unnest(['folk remedies', 'old recipes', 'tincture', 'ointment', 'syrup']) AS query, unnest([0, 1, 2, 3, 4]) AS i),
    z AS (SELECT query, i // 2 AS grp, 0 AS late, i % 2 AS nr FROM k UNION ALL SELECT query, i, 1, 0 FROM g) SELECT query FROM z ORDER BY grp, late, nr LIMIT 60""",
)
def template_queries(t: Tables):
    names = t.part.select(F.col("p_name").alias("name")).distinct()
    names = R.rank_all(names, [F.asc("name")], quantile_bucket(names, ["name"]))
    names = names.select("name", (F.col("rank") - 1).alias("pos"))
    used = t.part.filter("p_size > 45").select(F.concat("p_name", F.lit(" Syrup")).alias("query"))
    return R.template_queries(names, ["tincture", "ointment", "syrup"], ["folk remedies", "old recipes", "tincture", "ointment", "syrup"], used, 60)


@query(
    "topic_queries",
    """WITH s AS (SELECT user_id AS entity, CASE event_type WHEN 'view' THEN 'lead' WHEN 'click' THEN 'concept' WHEN 'error' THEN 'archive' END AS stream, event_id AS query FROM events WHERE event_type IN ('view', 'click', 'error')),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity, stream ORDER BY query) AS rn FROM s), c AS (SELECT entity, count(*) FILTER (stream = 'lead') AS nl, count(*) FILTER (stream = 'concept') AS nc, count(*) FILTER (stream = 'archive') AS na FROM s GROUP BY entity),
    w AS (SELECT entity, nl, nc, na, 0 AS n, 0 AS l, 0 AS c, 0 AS a, CAST(NULL AS VARCHAR) AS pick FROM c)
    SELECT CAST(x.entity AS BIGINT) AS entity, place, r.query::VARCHAR AS query FROM (
    WITH RECURSIVE w2 AS (SELECT entity, nl, nc, na, 0 AS n, 0 AS l, 0 AS c, 0 AS a, '' AS pick FROM c UNION ALL
    SELECT entity, nl, nc, na, n + 1, l + CASE WHEN p = 'lead' THEN 1 ELSE 0 END, c + CASE WHEN p = 'concept' THEN 1 ELSE 0 END, a + CASE WHEN p = 'archive' THEN 1 ELSE 0 END, p FROM (
    SELECT *, CASE WHEN n % 3 = 2 AND a < na THEN 'archive' WHEN n % 2 = 0 AND l < nl THEN 'lead' WHEN c < nc THEN 'concept' WHEN l < nl THEN 'lead' WHEN a < na THEN 'archive' END AS p FROM w2 WHERE n < 8) WHERE p IS NOT NULL)
    SELECT entity, n - 1 AS place, pick, CASE pick WHEN 'lead' THEN l WHEN 'concept' THEN c ELSE a END AS rn FROM w2 WHERE n > 0) x JOIN r ON r.entity = x.entity AND r.stream = x.pick AND r.rn = x.rn""",
)
def topic_queries(t: Tables):
    stream = F.when(F.col("event_type") == "view", "lead").when(F.col("event_type") == "click", "concept").when(F.col("event_type") == "error", "archive")
    rows = t.events.select(F.col("user_id").alias("entity"), stream.alias("stream"), F.col("event_id").alias("rank"), F.col("event_id").cast("string").alias("query"))
    return R.interleave(rows.filter("stream IS NOT NULL"), "entity", 8)


@query(
    "page_offset",
    """SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM orders WHERE o_orderpriority = '2-HIGH') AS total, (SELECT count(*) FROM orders WHERE o_orderpriority = '2-HIGH') > 150 AS has_next
    FROM orders WHERE o_orderpriority = '2-HIGH' ORDER BY o_orderkey DESC LIMIT 50 OFFSET 100""",
)
def page_offset(t: Tables):
    rows = t.orders.filter("o_orderpriority = '2-HIGH'").select("o_orderkey", "o_orderstatus")
    return R.page_of(rows, [F.desc("o_orderkey")], 3, 50)


@query(
    "chunked_recommendations",
    """WITH f AS (SELECT s_suppkey AS entity, s_acctbal, unnest(list_filter([CASE WHEN s_acctbal < 3000 THEN 'poor' END, CASE WHEN s_nationkey % 3 = 0 THEN 'distant' END, CASE WHEN s_suppkey % 4 = 0 THEN 'stale' END], lambda x: x IS NOT NULL)) AS kind FROM supplier)
    SELECT kind, entity, CAST(floor((row_number() OVER (PARTITION BY kind ORDER BY s_acctbal DESC, entity) - 1) / 6) + 1 AS BIGINT) AS chunk FROM f QUALIFY chunk <= 2""",
)
def chunked_recommendations(t: Tables):
    flags = F.array_compact(F.array(F.when(F.col("s_acctbal") < 3000, "poor"), F.when(F.col("s_nationkey") % 3 == 0, "distant"), F.when(F.col("s_suppkey") % 4 == 0, "stale")))
    rows = t.supplier.select(F.col("s_suppkey").alias("entity"), "s_acctbal", F.explode(flags).alias("kind"))
    return R.chunked(rows, "kind", "entity", [F.desc("s_acctbal"), F.asc("entity")], 6, 2)


@query(
    "expert_override",
    """WITH r AS (SELECT s_suppkey AS number, s_suppkey % 9 AS priority FROM supplier), o AS (SELECT s_suppkey * 3 AS number, s_nationkey AS priority FROM supplier WHERE s_suppkey % 2 = 0)
    SELECT r.number, CASE WHEN o.priority IS NULL THEN r.priority ELSE greatest(1, least(5, o.priority)) END AS priority, CASE WHEN o.priority IS NULL THEN 'kept' ELSE 'changed' END AS outcome FROM r LEFT JOIN o USING (number)
    UNION ALL SELECT number, priority, 'rejected' FROM o WHERE number NOT IN (SELECT number FROM r)
    UNION ALL SELECT (SELECT max(number) FROM r) + row_number() OVER (ORDER BY r_regionkey), greatest(1, least(5, r_regionkey * 2)), 'added' FROM region""",
)
def expert_override(t: Tables):
    recs = t.supplier.select(F.col("s_suppkey").alias("number"), (F.col("s_suppkey") % 9).alias("priority"))
    over = t.supplier.filter("s_suppkey % 2 = 0").select((F.col("s_suppkey") * 3).alias("number"), F.col("s_nationkey").cast("long").alias("priority"))
    new = t.region.select(F.col("r_regionkey").alias("position"), (F.col("r_regionkey") * 2).cast("long").alias("priority"))
    return R.expert_override(recs, over, "number", new)


@query(
    "char_budget_sections",
    """WITH RECURSIVE c AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS chunks FROM documents),
    s AS (SELECT doc_id, chunks, 0 AS i, 0 AS size, 0 AS n FROM c UNION ALL SELECT doc_id, chunks, i + 1, size + CASE WHEN size + length(chunks[i + 1]) <= 900 THEN length(chunks[i + 1]) ELSE 0 END,
    n + CASE WHEN size + length(chunks[i + 1]) <= 900 OR n = 0 THEN 1 ELSE 0 END FROM s WHERE i < len(chunks))
    SELECT doc_id, n AS picked FROM s WHERE i = len(chunks)""",
)
def char_budget_sections(t: Tables):
    chunks = F.filter(F.split("text", "\n"), lambda x: x != "")
    picked = t.documents.select("doc_id", R.budget_fold(chunks, 900).alias("out"))
    return picked.select("doc_id", F.size("out").alias("picked"))


@query(
    "recency_narrow",
    """WITH k AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS task, o_custkey AS entity FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01 00:00:00'), l AS (SELECT DISTINCT * FROM k WHERE entity NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1999-06-01 00:00:00'))
    SELECT task, entity, count(*) OVER (PARTITION BY task) AS left FROM l""",
)
def recency_narrow(t: Tables):
    tasks = t.orders.filter("o_orderdate < TIMESTAMP_NTZ '1996-01-01 00:00:00'").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("task"), F.col("o_custkey").alias("entity")).distinct()
    recent = t.orders.filter("o_orderdate >= TIMESTAMP_NTZ '1999-06-01 00:00:00'").select(F.col("o_custkey").alias("entity"))
    return R.recency_narrow(tasks, "task", "entity", recent).select("task", "entity", "left")


@query(
    "grouped_fact_pick",
    """WITH g AS (SELECT source, lang, count(*) AS n, max(n_chars % 8) AS best FROM documents WHERE lang <> 'en' GROUP BY ALL), b AS (SELECT source, lang, least(n, 3) * 3 + best + (length(source) + ascii(substr(lang, 1, 1))) % 6 AS score FROM g ORDER BY score DESC, source, lang LIMIT 1)
    SELECT d.source, d.lang, doc_id, round(CAST(score AS DOUBLE), 6) AS score FROM documents d JOIN b ON d.source = b.source AND d.lang = b.lang ORDER BY n_chars % 8 DESC, doc_id LIMIT 3""",
)
def grouped_fact_pick(t: Tables):
    noise = (F.length("source") + F.ascii("lang")) % 6
    return R.grouped_pick(t.documents.filter("lang <> 'en'"), ["source", "lang"], "doc_id", F.col("n_chars") % 8, noise.cast("double"))


@query(
    "url_templates",
    """WITH b AS (SELECT unnest(['flora', 'herbal', 'kew']) AS base, unnest(['https://f.example/{name}?l={latin_plus}', 'https://h.example/w/{latin}', 'https://k.example/q={name}']) AS template),
    n AS (SELECT DISTINCT p_name AS name, p_brand || ' ' || p_type AS latin FROM part) SELECT name, latin, base, replace(replace(replace(template, '{name}', replace(replace(name, '#', '%23'), ' ', '%20')), '{latin_plus}', replace(replace(latin, '#', '%23'), ' ', '+')), '{latin}', replace(replace(latin, '#', '%23'), ' ', '%20')) AS url FROM n, b""",
)
def url_templates(t: Tables):
    templates = [("flora", "https://f.example/{name}?l={latin_plus}"), ("herbal", "https://h.example/w/{latin}"), ("kew", "https://k.example/q={name}")]
    names = t.part.select(F.col("p_name").alias("name"), F.concat_ws(" ", "p_brand", "p_type").alias("latin")).distinct()
    return R.url_templates(names, templates, "name", "latin")
