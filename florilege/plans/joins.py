"""Registered joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.functions import text as X
from florilege.operators import joins as J
from florilege.plans.registry import Tables, query, spread
from florilege.plans.sequences import ntz
from florilege.plans.standins import NOW, cte, standin
from florilege.plans.text_functions import norm_sql

NAMES_SQL = """names AS (SELECT item_id AS entity, array_to_string(regexp_split_to_array(text, '\\s+')[1:2], ' ') AS name, array_to_string(regexp_split_to_array(text, '\\s+')[3:4], ' ') AS latin FROM benchmark),
docs AS MATERIALIZED (SELECT doc_id, lang, text, """ + norm_sql("text") + """ AS n FROM documents), dw AS MATERIALIZED (SELECT DISTINCT doc_id, lang, unnest(string_split(n, ' ')) AS w FROM docs)"""


def catalogue(t: Tables):
    w = F.split("text", r"\s+")
    return t.benchmark.select(F.col("item_id").alias("entity"), F.array_join(F.slice(w, 1, 2), " ").alias("name"), F.array_join(F.slice(w, 3, 2), " ").alias("latin"))


@query(
    "dict_match_best",
    f"""WITH {NAMES_SQL}, c AS (SELECT entity, list_filter(string_split({norm_sql('name')}, ' '), lambda w: length(w) > 2) AS ws, string_split({norm_sql('latin')}, ' ') AS lat FROM names),
    r AS (SELECT entity, ws, lat, CASE WHEN length(ws[1]) >= 6 THEN ws[1][1:length(ws[1]) - 2] ELSE ws[1][1:greatest(3, length(ws[1]) - 1)] END AS r1, CASE WHEN length(ws[2]) >= 6 THEN ws[2][1:length(ws[2]) - 2] ELSE ws[2][1:greatest(3, length(ws[2]) - 1)] END AS r2 FROM c),
    s AS (SELECT doc_id, entity, greatest(CASE WHEN len(lat) >= 2 AND contains(' ' || n || ' ', ' ' || lat[1] || ' ' || lat[2] || ' ') THEN 10 ELSE 0 END,
    CASE WHEN len(ws) = 0 THEN 0 WHEN length(ws[1]) <= 3 THEN CASE WHEN contains(' ' || n || ' ', ' ' || ws[1] || ' ') AND ws[2] IS NOT NULL AND contains(' ' || n, ' ' || ws[2][1:4]) THEN 4 ELSE 0 END
    WHEN contains(' ' || n, ' ' || r1) THEN 3 + CASE WHEN ws[2] IS NOT NULL AND contains(' ' || n, ' ' || r2) THEN 2 ELSE 0 END ELSE 0 END) AS score FROM docs, r),
    m AS (SELECT doc_id, max(score) AS score FROM s GROUP BY 1) SELECT s.doc_id, min(entity) AS entity, s.score FROM s JOIN m ON s.doc_id = m.doc_id AND s.score = m.score WHERE s.score > 0 GROUP BY s.doc_id, s.score HAVING count(*) = 1""",
)
def dict_match_best(t: Tables):
    return J.dict_match_best(t.documents, "doc_id", F.col("text"), catalogue(t), "entity", F.col("name"), F.col("latin"))


@query(
    "mention_join",
    f"""WITH {NAMES_SQL}, st AS (SELECT DISTINCT entity, w[1:least(6, greatest(4, length(w) - 2))] AS stem FROM (SELECT entity, unnest(string_split({norm_sql('name')}, ' ')) AS w FROM names) WHERE length(w) >= 3),
    u AS (SELECT stem FROM st WHERE length(stem) >= 5 GROUP BY stem HAVING count(*) = 1), n AS (SELECT entity, count(*) AS need FROM st GROUP BY 1),
    h AS (SELECT DISTINCT doc_id, entity, stem FROM dw JOIN st ON starts_with(w, stem)) SELECT doc_id, h.entity FROM h JOIN n ON n.entity = h.entity GROUP BY doc_id, h.entity, need HAVING count(*) = need OR bool_or(stem IN (SELECT stem FROM u))""",
)
def mention_join(t: Tables):
    return J.mention_join(t.documents, "doc_id", F.col("text"), catalogue(t), "entity", F.col("name"))


@query(
    "link_longest",
    f"""WITH {NAMES_SQL}, c AS (SELECT entity, regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}_]+')[1:2] AS ws FROM names), p AS (SELECT entity, len(ws) AS size, ws[1][1:greatest(4, length(ws[1]) - 2)] AS a, ws[2][1:greatest(4, length(ws[2]) - 2)] AS b FROM c)
    SELECT doc_id, entity FROM docs JOIN p ON contains(lower(text), a) AND (b IS NULL OR contains(lower(text), b)) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, entity) = 1""",
)
def link_longest(t: Tables):
    return J.link_longest(t.documents, "doc_id", F.col("text"), catalogue(t), "entity", F.col("name"))


@query(
    "binomial_or_genus_join",
    """WITH i AS (SELECT p_brand AS item, string_split(p_name, ' ')[1] AS genus, CASE WHEN max(p_size) > 49 THEN '' ELSE string_split(p_name, ' ')[2] END AS sp, min(p_partkey) AS card FROM part GROUP BY p_brand, p_name),
    e AS (SELECT p_partkey AS entity, string_split(p_name, ' ')[1] AS genus, string_split(p_name, ' ')[2] AS sp FROM part WHERE p_type <> 'PROMO')
    SELECT DISTINCT item, entity FROM i JOIN e ON i.genus = e.genus AND (i.sp = '' OR i.sp = e.sp) UNION SELECT item, card FROM i WHERE card IN (SELECT entity FROM e)""",
)
def binomial_or_genus_join(t: Tables):
    w = F.split("p_name", " ")
    items = t.part.groupBy(F.col("p_brand").alias("item"), "p_name").agg(F.max("p_size").alias("s"), F.min("p_partkey").alias("entity_card"))
    note = F.concat(F.initcap(F.get(w, F.lit(0))), F.when(F.col("s") > 49, F.lit(" spp.")).otherwise(F.concat(F.lit(" "), F.get(w, F.lit(1)))))
    entities = t.part.filter("p_type <> 'PROMO'").select(F.col("p_partkey").alias("entity"), F.concat(F.initcap(F.get(w, F.lit(0))), F.lit(" "), F.get(w, F.lit(1))).alias("latin"))
    return J.binomial_or_genus(items.withColumn("note", note), "item", F.col("note"), "entity_card", entities, "entity", F.col("latin"))


@query(
    "lookup_with_inflection",
    """WITH n AS (SELECT p_name AS key, min(p_partkey) AS entity FROM part WHERE p_type <> 'SMALL' GROUP BY 1), k AS (SELECT p_partkey AS r, CASE WHEN p_size % 3 = 0 THEN p_name WHEN p_size % 3 = 1 THEN left(p_name, length(p_name) - 2) || 'ow' ELSE 'unknown thing' END AS q,
    CASE WHEN p_size > 45 THEN lower(p_brand || ' ' || p_type) END AS latin FROM part), l AS (SELECT lower(p_brand || ' ' || p_type) AS key, min(p_partkey) AS entity FROM part WHERE p_partkey > 1000 GROUP BY 1),
    e AS (SELECT r, min(entity) AS entity FROM k JOIN n ON length(n.key) >= 6 AND length(q) >= 6 AND starts_with(n.key, left(q, length(q) - 2)) AND abs(length(n.key) - length(q)) <= 3 WHERE latin IS NULL GROUP BY r)
    SELECT k.r AS row_id, coalesce(l.entity, n.entity, e.entity) AS entity FROM k LEFT JOIN l ON l.key = latin LEFT JOIN n ON n.key = q LEFT JOIN e ON e.r = k.r""",
)
def lookup_with_inflection(t: Tables):
    entry = t.part.select(F.col("p_partkey").alias("entity"), F.col("p_partkey").alias("ord"), "*")
    names = entry.filter("p_type <> 'SMALL'").select(F.col("p_name").alias("key"), "entity", "ord")
    latins = entry.filter("p_partkey > 1000").select(F.lower(F.concat_ws(" ", "p_brand", "p_type")).alias("key"), "entity", "ord")
    bent = F.concat(F.left("p_name", F.length("p_name") - 2), F.lit("ow"))
    rows = t.part.select(
        F.col("p_partkey").alias("row_id"), F.when(F.col("p_size") % 3 == 0, F.col("p_name")).when(F.col("p_size") % 3 == 1, bent).otherwise("unknown thing").alias("q"),
        F.when(F.col("p_size") > 45, F.concat_ws(" ", "p_brand", "p_type")).alias("latin"),
    )
    return J.lookup_with_inflection(rows, "row_id", "q", "latin", names.dropDuplicates(["key", "entity"]), latins, "entity", "ord")


FOREIGN_SQL = NAMES_SQL + f""", nm AS (SELECT entity, lang, list_filter(string_split({norm_sql('name')}, ' '), lambda w: length(w) >= 3) AS ws FROM names, (SELECT unnest(['en', 'fr', 'de', 'es']) AS lang)),
fl AS (SELECT entity, lang, ws, len(ws) > 1 OR (length(ws[1]) >= 5 AND (lang <> 'en' OR length(ws[1]) >= 7)) AS sure FROM nm WHERE len(ws) > 0 UNION ALL
SELECT entity, lang, [CASE WHEN lang IN ('fr', 'es') THEN ws[1] ELSE ws[-1] END] AS h, (lang <> 'en' OR length(h[1]) >= 7) FROM nm WHERE len(ws) > 1 AND length(CASE WHEN lang IN ('fr', 'es') THEN ws[1] ELSE ws[-1] END) >= 5),
dict AS (SELECT lang, ws, min(entity) AS entity, bool_or(sure) AS sure FROM fl GROUP BY lang, ws HAVING count(DISTINCT entity) = 1)"""


@query(
    "foreign_name_mentions",
    f"""WITH {FOREIGN_SQL} SELECT doc_id, entity, bool_or(sure) AS sure FROM docs d JOIN dict ON d.lang = dict.lang
    AND len(list_filter(ws, lambda w: NOT contains(' ' || n, ' ' || CASE WHEN length(w) <= 5 THEN w ELSE w[1:greatest(5, length(w) - 2)] END))) = 0 GROUP BY 1, 2""",
)
def foreign_name_mentions(t: Tables):
    langs = F.explode(F.array(*[F.lit(x) for x in ("en", "fr", "de", "es")]))
    names = catalogue(t).select("entity", "name", langs.alias("lang"))
    return J.foreign_mentions(t.documents, "doc_id", "lang", F.col("text"), J.name_dictionary(names, "entity", "lang", "name", ["fr", "es"]), "entity")


@query(
    "glossary_build",
    """WITH n AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'en' ELSE 'de' END AS lang, p_name AS name, CASE WHEN p_size < 3 THEN p_type ELSE p_name || ' pl' END AS target FROM part),
    v AS (SELECT lang, unnest(CASE WHEN lang = 'de' THEN [name] ELSE [lower(name), upper(name[1]) || lower(name[2:])] END) AS term, unnest(CASE WHEN lang = 'de' THEN [lower(target)] ELSE [lower(target), upper(target[1]) || lower(target[2:])] END) AS target FROM n
    WHERE contains(name, ' ') OR length(name) >= CASE WHEN lang = 'en' THEN 7 ELSE 5 END) SELECT lang, term, min(target) AS target FROM v GROUP BY 1, 2 HAVING count(DISTINCT target) = 1""",
)
def glossary_build(t: Tables):
    target = F.when(F.col("p_size") < 3, F.col("p_type")).otherwise(F.concat("p_name", F.lit(" pl")))
    names = t.part.select(F.when(F.col("p_size") % 2 == 0, "en").otherwise("de").alias("lang"), F.col("p_name").alias("name"), target.alias("target"))
    return J.glossary(names, "lang", "name", "target")


@query(
    "pages_for_entity",
    f"""WITH {NAMES_SQL}, k AS (SELECT DISTINCT entity, lower(unnest([name, latin])) AS key FROM names), h AS (SELECT entity, doc_id, CAST(sum(len(string_split(lower(text), key)) - 1) AS BIGINT) AS hits FROM docs, k GROUP BY 1, 2 HAVING hits > 0)
    SELECT entity, doc_id, hits, row_number() OVER (PARTITION BY entity ORDER BY hits DESC, doc_id) AS rank FROM h WHERE NOT (doc_id % 5 = entity % 5) QUALIFY rank <= 3""",
)
def pages_for_entity(t: Tables):
    keys = catalogue(t).select("entity", F.explode(F.array(F.lower("name"), F.lower("latin"))).alias("key")).distinct()
    used = t.documents.select("doc_id", (F.col("doc_id") % 5).alias("m")).join(catalogue(t).select("entity", (F.col("entity") % 5).alias("m")), "m")
    return J.pages_for_entity(t.documents, "doc_id", "text", keys, "entity", used, 3)


@query(
    "alias_resolution",
    """WITH a AS (SELECT p_name AS name, CASE WHEN min(p_size) = 1 THEN NULL ELSE min(p_partkey) END AS entity FROM part GROUP BY 1 HAVING count(*) > 30)
    SELECT p_partkey, a.entity, CASE WHEN a.name IS NULL THEN 'unknown' WHEN a.entity IS NULL THEN 'no_entity' ELSE 'entity' END AS state FROM part LEFT JOIN a ON a.name = p_name""",
)
def alias_resolution(t: Tables):
    g = t.part.groupBy(F.col("p_name").alias("name")).agg(F.min("p_size").alias("s"), F.min("p_partkey").alias("k"), F.count("*").alias("n"))
    aliases = g.filter("n > 30").select("name", F.when(F.col("s") > 1, F.col("k")).alias("entity"))
    return J.alias_resolution(t.part.select("p_partkey", "p_name"), F.upper("p_name"), aliases, "entity").drop("p_name")


@query(
    "known_anti_join",
    r"""WITH d AS (SELECT page_id, array_to_string(list_slice(string_split(regexp_extract(url, '//([^/?#]*)', 1), '.'), -3, -1), '.') AS domain FROM pages), k AS (SELECT domain, 1 AS hits FROM d WHERE page_id % 5 = 0 GROUP BY 1)
    SELECT domain, hits + coalesce((SELECT count(*) FROM d WHERE d.domain = k.domain AND page_id % 5 <> 0), 0) AS hits FROM k""",
)
def known_anti_join(t: Tables):
    d = t.pages.select("page_id", F.substring_index(F.regexp_extract("url", "//([^/?#]*)", 1), ".", -3).alias("domain"))
    known = d.filter("page_id % 5 = 0").select("domain", F.lit(1).alias("hits")).distinct()
    return J.split_known(d.filter("page_id % 5 <> 0"), known, "domain", "hits")[1]


@query(
    "known_anti_join_new",
    r"""WITH d AS (SELECT page_id, array_to_string(list_slice(string_split(regexp_extract(url, '//([^/?#]*)', 1), '.'), -3, -1), '.') AS domain FROM pages) SELECT page_id, domain FROM d WHERE page_id % 5 <> 0 AND domain NOT IN (SELECT domain FROM d WHERE page_id % 5 = 0)""",
)
def known_anti_join_new(t: Tables):
    d = t.pages.select("page_id", F.substring_index(F.regexp_extract("url", "//([^/?#]*)", 1), ".", -3).alias("domain"))
    known = d.filter("page_id % 5 = 0").select("domain", F.lit(1).alias("hits")).distinct()
    return J.split_known(d.filter("page_id % 5 <> 0"), known, "domain", "hits")[0].select("page_id", "domain")


@query(
    "card_enrichment_join",
    """WITH w AS (SELECT l_orderkey, p_partkey, CASE WHEN p_size > 30 THEN p_type || ' warning' END AS a, CASE WHEN l_returnflag = 'R' AND p_size % 2 = 0 THEN p_brand || ' part' END AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
    e AS (SELECT l_orderkey, p_partkey, 0 AS pos, a AS text FROM w WHERE a IS NOT NULL UNION ALL SELECT l_orderkey, p_partkey, CASE WHEN a IS NULL THEN 0 ELSE 1 END, b FROM w WHERE b IS NOT NULL),
    f AS (SELECT l_orderkey, text, min({'pos': pos, 'k': p_partkey}) AS o FROM e GROUP BY 1, 2) SELECT l_orderkey, string_agg(text, ' • ' ORDER BY o, text) AS warnings FROM f GROUP BY 1""",
)
def card_enrichment_join(t: Tables):
    cards = t.part.select(
        F.col("p_partkey").alias("l_partkey"), F.when(F.col("p_size") > 30, F.concat("p_type", F.lit(" warning"))).alias("warning"),
        F.lit("R").alias("card_part"), F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit(" part"))).alias("part_warning"),
    )
    return J.card_enrichment(t.lineitem, "l_orderkey", "l_partkey", "l_returnflag", cards)


@query(
    "tradition_annotation",
    """WITH m AS (SELECT o_orderkey, min(l_partkey) AS main FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority <> '5-LOW' GROUP BY 1)
    SELECT o_orderkey, main, CASE WHEN p_size % 3 = 0 THEN 'słodki' WHEN p_size % 3 = 1 THEN 'ostry' END AS taste FROM m JOIN part ON p_partkey = main""",
)
def tradition_annotation(t: Tables):
    from florilege.functions.profile import pick_segment, taste

    medicinal = t.orders.filter("o_orderpriority <> '5-LOW'").select("o_orderkey")
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    main = medicinal.join(lines, "o_orderkey").groupBy("o_orderkey").agg(F.min("l_partkey").alias("main"))
    note = F.when(F.col("p_size") % 3 == 0, "gorzki (kora), słodki (sok)").when(F.col("p_size") % 3 == 1, "ostry (sok, liście)").otherwise("nijaki (sok)")
    # a note belongs to a part: it is read once there, not once for every order
    tasted = spread(t.part).select(F.col("p_partkey").alias("main"), taste(pick_segment(note, F.lit("sok"))).alias("taste"))
    return main.join(tasted, "main").select("o_orderkey", "main", "taste")


@query(
    "task_job_join",
    """WITH r AS (SELECT l_orderkey AS run, CASE WHEN max(l_returnflag) = 'R' THEN 'done' ELSE 'failed' END AS status, count(*) FILTER (l_discount > 0.08) AS refusals, count(*) FILTER (l_quantity > 20) AS written, CAST(count(*) - 2 AS DOUBLE) AS minutes, sum(l_quantity) AS value FROM lineitem GROUP BY 1)
    SELECT o_orderkey AS task, o_orderkey * 2 AS run, CASE WHEN status IS NULL THEN 'failed' WHEN status = 'done' AND refusals > 0 AND written = 0 THEN 'blocked' ELSE status END AS state, greatest(1.0, coalesce(minutes, 0)) AS minutes, coalesce(value, 0) AS value FROM orders LEFT JOIN r ON run = o_orderkey * 2""",
)
def task_job_join(t: Tables):
    from florilege.operators.primitives import count_where

    runs = t.lineitem.groupBy(F.col("l_orderkey").alias("run")).agg(
        F.when(F.max("l_returnflag") == "R", "done").otherwise("failed").alias("status"), count_where(F.col("l_discount") > 0.08).alias("refusals"),
        count_where(F.col("l_quantity") > 20).alias("written"), (F.count("*") - 2).cast("double").alias("minutes"), F.sum("l_quantity").alias("value"),
    )
    tasks = t.orders.select(F.col("o_orderkey").alias("task"), (F.col("o_orderkey") * 2).alias("run"))
    return J.task_outcomes(tasks, runs, "task", "run")


@query(
    "audit_compare",
    """WITH n AS (SELECT s_suppkey AS entity, s_acctbal AS score FROM supplier), o AS (SELECT l_suppkey AS entity, round(sum(l_quantity) / 3, 2) AS score FROM lineitem WHERE l_suppkey < 95 GROUP BY 1),
    d AS (SELECT n.entity, round(n.score - o.score, 6) AS delta FROM n JOIN o USING (entity)) (SELECT entity, 'better' AS change, delta FROM d WHERE delta > 0 ORDER BY delta DESC, entity LIMIT 10) UNION ALL
    (SELECT entity, 'worse', delta FROM d WHERE delta < 0 ORDER BY delta, entity LIMIT 10) UNION ALL SELECT entity, 'new', score FROM n WHERE entity NOT IN (SELECT entity FROM o)""",
)
def audit_compare(t: Tables):
    new = t.supplier.select(F.col("s_suppkey").alias("entity"), F.col("s_acctbal").alias("score"))
    old = t.lineitem.filter("l_suppkey < 95").groupBy(F.col("l_suppkey").alias("entity")).agg(F.round(F.sum("l_quantity") / 3, 2).alias("score"))
    return J.audit_compare(old, new, "entity")


@query(
    "quote_backfill",
    r"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN 'own ' || doc_id END AS quote, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM documents)
    SELECT doc_id, coalesce(nullif(trim(quote), ''), CASE WHEN length(q) <= 300 THEN q ELSE regexp_replace(q[1:300], '\s+\S*$', '') || '…' END) AS quote FROM f""",
)
def quote_backfill(t: Tables):
    facts = t.documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("own "), F.col("doc_id").cast("string"))).alias("quote"))
    return J.quote_backfill(facts, "doc_id", t.documents.select("doc_id", F.col("text").alias("quote")))


@query(
    "version_review_join",
    f"""WITH v AS (SELECT conv_id AS root, turn, substr(sha1({norm_sql('text')}), 1, 16) AS hash FROM conversations), r AS (SELECT root, hash, turn AS review FROM v WHERE turn % 2 = 0 QUALIFY row_number() OVER (PARTITION BY root, hash ORDER BY turn DESC) = 1)
    SELECT v.root, v.turn, v.hash, review FROM v LEFT JOIN r ON r.root = v.root AND r.hash = v.hash""",
)
def version_review_join(t: Tables):
    v = t.conversations.select(F.col("conv_id").alias("root"), "turn", X.text_hash(F.col("text")).alias("hash"))
    reviews = v.filter("turn % 2 = 0").withColumnRenamed("turn", "review")
    return J.version_reviews(v, reviews, "root", "hash", "review")


SPECIES_SQL = """ent AS (SELECT p_partkey AS entity, p_brand || p_type AS species, p_size > 30 AS generated FROM part), fac AS (SELECT l_orderkey * 10 + l_linenumber AS fact, l_partkey AS entity, l_suppkey % 20 AS fp FROM lineitem),
hand AS (SELECT species, min(entity) AS target FROM ent WHERE NOT generated GROUP BY 1)"""


def species_tables(t: Tables):
    ent = t.part.select(F.col("p_partkey").alias("entity"), F.concat("p_brand", "p_type").alias("species"), (F.col("p_size") > 30).alias("generated"))
    fac = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("fact"), F.col("l_partkey").alias("entity"), (F.col("l_suppkey") % 20).alias("fp"))
    return ent, fac


@query(
    "duplicate_entity_merge",
    f"""WITH {SPECIES_SQL}, m AS (SELECT entity, target FROM ent JOIN hand USING (species) WHERE generated), o AS (SELECT fact, coalesce(target, fac.entity) AS entity, fp, target IS NOT NULL AS moved FROM fac LEFT JOIN m ON m.entity = fac.entity)
    SELECT fact, entity, fp FROM o QUALIFY row_number() OVER (PARTITION BY entity, fp ORDER BY moved, fact) = 1""",
)
def duplicate_entity_merge(t: Tables):
    ent, fac = species_tables(t)
    return J.merge_same_species(ent, "entity", "species", F.col("generated"), fac, "fact", "fp")[1]


@query(
    "entity_reassign",
    f"""WITH {SPECIES_SQL}, ch AS (SELECT entity, species AS old FROM ent WHERE generated), g AS (SELECT species AS old, min(entity) AS dest FROM ent WHERE NOT generated GROUP BY 1), mv AS (SELECT ch.entity, dest FROM ch LEFT JOIN g USING (old)),
    f AS (SELECT fac.fact, fac.entity, fp, dest FROM fac JOIN mv ON mv.entity = fac.entity) SELECT fact, CASE WHEN dest IS NULL OR EXISTS (SELECT 1 FROM fac x WHERE x.entity = dest AND x.fp = f.fp) THEN entity ELSE dest END AS entity,
    CASE WHEN dest IS NULL OR EXISTS (SELECT 1 FROM fac x WHERE x.entity = dest AND x.fp = f.fp) THEN 'rejected' ELSE 'moved' END AS state FROM f""",
)
def entity_reassign(t: Tables):
    ent, fac = species_tables(t)
    changed = ent.filter("generated").select("entity", F.col("species").alias("old"))
    return J.reassign_facts(changed, "entity", "old", ent.filter("NOT generated"), "species", fac, "fact", "fp")


@query(
    "used_idea_anti",
    """WITH p AS (SELECT o_orderkey, [o_orderkey % 1000, o_custkey % 1000] AS refs FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT unnest(refs) FROM p)""",
)
def used_idea_anti(t: Tables):
    refs = F.concat(F.lit("fact:"), (F.col("o_orderkey") % 1000).cast("string"), F.lit(","), (F.col("o_custkey") % 1000).cast("string"))
    posts = t.orders.filter("o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'").select(refs.alias("refs"))
    return J.unused_ideas(t.documents.select("doc_id", "lang"), "doc_id", posts, "refs", "fact:")


@query(
    "cache_anti_join",
    """WITH r AS (SELECT role || '|' || text AS k, count(*) AS requests FROM conversations GROUP BY 1), c AS (SELECT role || '|' || text AS k, max('answer ' || conv_id) FILTER (turn < 2 AND conv_id % 7 <> 0) AS answer FROM conversations GROUP BY 1)
    SELECT r.requests, c.answer, c.answer IS NULL AS execute FROM r JOIN c USING (k)""",
)
def cache_anti_join(t: Tables):
    keyed = t.conversations.withColumn("key", J.request_key("role", "text"))
    at = F.when(F.col("turn") < 2, ntz("2024-01-30 00:00:00")).otherwise(ntz("2023-01-01 00:00:00"))
    cache = keyed.select("key", at.alias("at"), F.concat(F.lit("answer "), F.col("conv_id").cast("string")).alias("answer"), (F.col("conv_id") % 7 == 0).alias("junk"))
    return J.split_cached(keyed, cache, ntz(NOW), 7 * 86400, F.col("junk")).drop("key")


@query(
    "embedding_cache_join",
    """SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 4) AS head, vec_id % 3 = 0 AS cached FROM embeddings""",
)
def embedding_cache_join(t: Tables):
    rows = t.embeddings.select("vec_id", "label", F.sha1(F.array_join(F.transform("embedding", lambda x: x.cast("string")), ",")).alias("key"), F.col("embedding").alias("raw"))
    cache = rows.filter("vec_id % 3 = 0").select("key", F.col("raw").alias("vector"))
    joined = J.encode_once(rows.select("vec_id", "label", "key", "raw"), "key", cache, lambda missing: missing.withColumn("vector", F.col("raw")))
    return joined.select("vec_id", "label", F.round(F.get("vector", F.lit(0)).cast("double"), 4).alias("head"), (F.col("vec_id") % 3 == 0).alias("cached"))


@query(
    "name_dictionary_build",
    """SELECT p_partkey AS entity, 'en' AS lang, p_name AS name, 'names' AS source FROM part UNION ALL SELECT p_partkey, 'de', p_type, 'names' FROM part UNION ALL SELECT p_partkey, 'la', p_brand, 'titles' FROM part WHERE p_size % 4 <> 0""",
)
def name_dictionary_build(t: Tables):
    names = F.to_json(F.create_map(F.lit("en"), F.col("p_name"), F.lit("de"), F.col("p_type")))
    titles = F.when(F.col("p_size") % 4 == 0, F.lit("{broken")).otherwise(F.to_json(F.create_map(F.lit("la"), F.col("p_brand"))))
    rows = t.part.select(F.col("p_partkey").alias("entity"), names.alias("names"), titles.alias("titles"))
    return J.name_rows(rows, "entity", {"names": F.from_json("names", "map<string,string>"), "titles": F.from_json("titles", "map<string,string>")})


@query(
    "idea_sync_anti",
    cte("facts") + """ SELECT fact_id, 'fact:' || fact_id AS key, c_name AS name FROM facts LEFT JOIN customer ON c_custkey = entity WHERE status = 'verified' AND section IN ('sec1', 'sec3') AND fact_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def idea_sync_anti(t: Tables):
    ideas = t.orders.filter("o_orderstatus = 'F'").select(F.concat(F.lit("fact:"), F.col("o_orderkey").cast("string")).alias("key"))
    wanted = (F.col("status") == "verified") & F.col("section").isin("sec1", "sec3")
    new = J.new_ideas(standin(t, "facts"), "fact_id", wanted, ideas, "key")
    return new.join(t.customer, F.col("entity") == F.col("c_custkey"), "left").select("fact_id", "key", F.col("c_name").alias("name"))


@query(
    "first_word_match",
    """WITH e AS (SELECT split_part(p_name, ' ', 1) AS w, min(p_partkey) AS entity FROM part WHERE p_size > 40 GROUP BY 1) SELECT p_partkey AS row_id, e.entity FROM part LEFT JOIN e ON split_part(p_name, ' ', 1) = w""",
)
def first_word_match(t: Tables):
    entities = t.part.filter("p_size > 40").select(F.col("p_partkey").alias("entity"), F.col("p_partkey").alias("ord"), "p_name")
    return J.first_word_match(t.part.withColumnRenamed("p_partkey", "row_id"), "row_id", F.concat(F.upper("p_name"), F.lit("!")), entities, "entity", F.col("p_name"), "ord")


@query(
    "resolve_source_numbers",
    """WITH o AS (SELECT l_orderkey, list_sort(list_distinct(list(l_linenumber))) AS nums, list_sort(list_distinct(list(l_linenumber) FILTER (l_linenumber <> 3))) AS known FROM lineitem GROUP BY 1)
    SELECT l_orderkey, array_to_string(list_transform(list_filter(nums, lambda n: list_contains(known, n)), lambda n: 's' || n), ',') AS sources FROM o""",
)
def resolve_source_numbers(t: Tables):
    o = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("numbers"))
    table = F.transform(F.filter("numbers", lambda n: n != 3), lambda n: F.struct(n, F.concat(F.lit("s"), n.cast("string"))))
    out = J.resolve_numbers(o, "numbers", table)
    return out.select("l_orderkey", F.array_join("numbers", ",").alias("sources"))
