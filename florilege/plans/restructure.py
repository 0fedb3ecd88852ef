"""Registered restructuring queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.functions import text as X
from florilege.operators import restructure as K
from florilege.operators.primitives import few
from florilege.plans.registry import Tables, query
from florilege.plans.text_functions import norm_sql, stems_sql, turn_pairs


def point_rows(t: Tables):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"), F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"), F.min("l_quantity").alias("l_quantity")
    )


LINES_SQL = "li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)"


@query(
    "number_sources",
    """WITH s AS (SELECT DISTINCT l_partkey AS entity, CASE WHEN l_suppkey % 9 = 0 THEN 'https://pl.wikipedia.org/' ELSE 'https://s.example/' END || l_suppkey AS url, CASE WHEN l_suppkey % 4 = 0 THEN 'pl' ELSE 'en' END AS lang FROM lineitem)
    SELECT entity, url, lang, row_number() OVER (PARTITION BY entity ORDER BY CASE WHEN contains(url, 'wikipedia.org') THEN 0 ELSE 1 END, CASE WHEN lang = 'pl' THEN 0 ELSE 1 END, url) AS nr FROM s""",
)
def number_sources(t: Tables):
    url = F.concat(F.when(F.col("l_suppkey") % 9 == 0, "https://pl.wikipedia.org/").otherwise("https://s.example/"), F.col("l_suppkey").cast("string"))
    facts = t.lineitem.select(F.col("l_partkey").alias("entity"), url.alias("url"), F.when(F.col("l_suppkey") % 4 == 0, "pl").otherwise("en").alias("lang"))
    return K.number_sources(facts, "entity", "url", "lang")


@query(
    "section_layout",
    f"""WITH {LINES_SQL} SELECT l_orderkey AS entity, l_linenumber AS fact, CASE l_returnflag WHEN 'N' THEN 'R' ELSE l_returnflag END AS section, l_linestatus AS part, l_suppkey AS source,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'A' THEN 2 ELSE 1 END, l_linestatus, l_suppkey, l_linenumber) AS place FROM li""",
)
def section_layout(t: Tables):
    facts = point_rows(t).select(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("fact"), F.col("l_returnflag").alias("section"), F.col("l_linestatus").alias("part"), F.col("l_suppkey").alias("source"))
    return K.section_layout(facts, "entity", "fact", ["R", "A"], "R")


@query(
    "collect_points",
    f"WITH {LINES_SQL} SELECT l_partkey AS entity, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS pid FROM li WHERE l_quantity > 2",
)
def collect_points(t: Tables):
    p = point_rows(t).select(F.col("l_partkey").alias("entity"), "l_orderkey", "l_linenumber", F.when(F.col("l_quantity") > 2, "text").alias("text"), F.col("l_suppkey").alias("source"))
    return K.collect_points(p, "entity", ["l_orderkey", "l_linenumber"], F.floor(F.col("l_orderkey") / 4096)).drop("text", "source")


@query(
    "default_route",
    """SELECT p_partkey, CASE WHEN p_size > 30 AND p_type = 'LARGE' THEN 'parts.' || p_brand || '.properties' WHEN p_type = 'PROMO' AND p_name LIKE '%ring%' THEN 'needs.soil' WHEN p_type = 'PROMO' THEN 'needs' WHEN p_type = 'LARGE' THEN 'uses.medical' WHEN p_type = 'SMALL' THEN 'notes' END AS slot FROM part""",
)
def default_route(t: Tables):
    part = F.when(F.col("p_size") > 30, F.col("p_brand"))
    slot = K.default_route(F.col("p_type"), part, F.col("p_name"), {"LARGE": "properties"}, {"PROMO": "needs", "LARGE": "uses.medical", "SMALL": "notes"}, [("PROMO", "ring", "needs.soil")])
    return t.part.select("p_partkey", slot.alias("slot"))


@query(
    "route_override",
    "SELECT p_partkey, CASE WHEN p_size % 3 = 0 AND p_brand <> 'Brand#1' THEN 'uses' ELSE 'rule' END AS route FROM part",
)
def route_override(t: Tables):
    routes = t.part.filter("p_size % 3 = 0").select("p_partkey", F.when(F.col("p_brand") != "Brand#1", "uses").otherwise("unheard").alias("slot"))
    return K.route_override(t.part.select("p_partkey", F.lit("rule").alias("rule_slot")), "p_partkey", routes, ["uses"]).drop("rule_slot")


@query("merge_points")
def merge_points(t: Tables):
    """What users say joins what the assistant said, which is there first."""
    rows = t.conversations.select((F.col("conv_id") * 100 + F.col("turn") + F.when(F.col("role") == "user", 50).otherwise(0)).alias("nr"), F.col("conv_id").cast("string").alias("slot"), "role", "text")
    return K.merge_points(rows.filter("role = 'user'"), ["slot"], "nr", "text", originals=rows.filter("role <> 'user'"))


@query("merge_answers")
def merge_answers(t: Tables):
    """Each document's answer is its own first sentence, a mixed one and one of another document, cited by number."""
    docs = t.documents.select(F.col("doc_id").cast("string").alias("slot"), "doc_id", X.sentences(F.regexp_replace("text", r"\s+", " ")).alias("s")).filter(F.size("s") >= 3)
    originals = docs.select("slot", F.posexplode(F.slice("s", 1, 2)).alias("unit", "text"))
    points = docs.select("slot", F.posexplode(F.slice("s", F.lit(3), F.size("s"))).alias("_p", "text")).select("slot", (F.col("_p") + 1).alias("point"), "text")
    said = lambda text, z: F.struct(text.alias("tekst"), F.array(z).alias("z"))
    strange = F.when(F.col("doc_id") % 3 == 0, F.lit("Entirely other words about 12345678901 quite unrelated matters here.")).otherwise(F.get("s", F.lit(2)))
    rows = F.array(said(F.get("s", F.lit(0)), F.lit("7")), said(F.concat(F.get("s", F.lit(0)), F.lit(" "), F.get("s", F.lit(2))), F.lit("P1")), said(strange, F.lit("1")))
    answer = F.to_json(F.struct(rows.alias("zdania"), F.array(F.lit(2)).alias("nie_pasuje")))
    answers = docs.select("slot", F.when(F.col("doc_id") % 7 == 0, "no answer").otherwise(answer).alias("answer"))
    _, slots = K.apply_merge_answers(answers, originals, points, "slot")
    return slots.select("slot", "state", "sentences", "dropped", "lost", "missing", F.size("aside").alias("aside"))


@query(
    "merge_repair",
    f"""WITH s AS (SELECT conv_id, turn AS sentence, unnest({stems_sql('text', 5)}) AS k FROM conversations WHERE role = 'assistant'), p AS (SELECT conv_id, turn AS point, unnest({stems_sql('text', 5)}) AS k FROM conversations WHERE role = 'user'),
    z AS (SELECT conv_id, point, count(*) AS size FROM p GROUP BY 1, 2), c AS (SELECT s.conv_id, sentence, p.point FROM s JOIN p ON s.conv_id = p.conv_id AND s.k = p.k JOIN z ON z.conv_id = p.conv_id AND z.point = p.point GROUP BY s.conv_id, sentence, p.point, size HAVING count(*) >= 0.25 * size)
    SELECT conv_id, sentence, point, 'cited' AS how FROM c UNION ALL SELECT conv_id, NULL, turn, 'added' FROM conversations x WHERE role = 'user' AND NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = x.conv_id AND c.point = x.turn)""",
)
def merge_repair(t: Tables):
    s = t.conversations.filter("role = 'assistant'").select("conv_id", F.col("turn").alias("sentence"), "text")
    p = t.conversations.filter("role = 'user'").select("conv_id", F.col("turn").alias("point"), "text")
    return K.merge_repair(s, p, "conv_id", 0.25)


@query(
    "incremental_merge",
    "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'new ' || p_name ELSE 'old' END AS result, CASE WHEN p_size % 4 = 0 THEN 'computed' ELSE 'reused' END AS how FROM part",
)
def incremental_merge(t: Tables):
    now = t.part.select("p_partkey", "p_name", "p_brand")
    before = t.part.select("p_partkey", "p_name", F.when(F.col("p_size") % 4 == 0, "other").otherwise(F.col("p_brand")).alias("p_brand"))
    old = before.withColumn("hash", X.short_sha(F.to_json(F.struct("p_name", "p_brand")))).withColumn("result", F.lit("old"))
    out = K.incremental_merge(now, old, ["p_partkey"], ["p_name", "p_brand"], lambda rows: rows.withColumn("result", F.concat(F.lit("new "), "p_name")))
    return out.drop("hash")


@query(
    "place_scores",
    f"""WITH n AS (SELECT doc_id, lang, ' ' || {norm_sql('text')} || ' ' AS t FROM documents), s AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 1.5 ELSE 0 END + least(3, CASE WHEN contains(t, ' the') THEN 1 ELSE 0 END + CASE WHEN contains(t, ' ing') THEN 1 ELSE 0 END) AS a,
    CASE WHEN lang = 'fr' THEN 1.0 ELSE 0 END + least(3, CASE WHEN contains(t, ' que') THEN 1 ELSE 0 END) + CASE WHEN contains(t, ' elle') THEN 2 ELSE 0 END AS b FROM n) SELECT doc_id, CASE WHEN greatest(a, b) >= 2 THEN CASE WHEN a >= b THEN 'alpha' ELSE 'beta' END ELSE 'rest' END AS place, CAST(greatest(a, b) AS DOUBLE) AS score FROM s""",
)
def place_scores(t: Tables):
    places = [("alpha", {"en": 1.5}, ["the", "ing"], []), ("beta", {"fr": 1.0}, ["que"], ["elle"])]
    return K.place_scores(t.documents, "doc_id", "lang", "text", places, 2.0, "rest")


@query("place_inserts")
def place_inserts(t: Tables):
    """Every fourth document stands for a text that is on the page already."""
    rows = t.documents.select("source", F.col("lang").alias("place"), "doc_id", "text", F.col("doc_id").alias("fact"), F.concat(F.lit("https://x.example/"), F.col("doc_id") % 7).alias("url"))
    there = rows.filter("doc_id % 4 = 0").select("source", "place", "text")
    out = K.place_inserts(rows.filter("doc_id % 4 <> 0"), "source", "place", "doc_id", "text", "fact", "url", there)
    return out.select("source", "place", "doc_id", "merged", F.size("fact").alias("facts"), F.array_join("url", " ").alias("urls"))


@query("fact_store")
def fact_store(t: Tables):
    rows = t.documents.withColumn("quote", F.substring("text", 1, 80))
    labelled = few(t.labels.select("doc_id").distinct(), K.MOST_NUMBERS)
    new = rows.join(labelled, "doc_id", "left_anti").select("source", "doc_id", "text", "quote")
    stored = rows.join(labelled, "doc_id", "left_semi").select("source", "text", "quote")
    return K.store_facts(new, stored, "source", "doc_id", "text", "quote").select("source", "doc_id", "fingerprint")


@query("dedup_topk")
def dedup_topk(t: Tables):
    return K.dedup_topk(t.documents.select("source", "doc_id", "text"), "source", "doc_id", "text", 20).select("source", "doc_id", "rank")


@query(
    "translation_apply",
    """WITH p AS (SELECT a.conv_id * 100 + a.turn AS fact, a.turn % 4 AS m, a.text AS quote, b.text AS tr FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1), r AS (SELECT fact, m, CASE WHEN m = 0 THEN quote ELSE trim(tr) END AS text FROM p)
    SELECT fact, CASE WHEN m = 1 THEN 'untranslated' WHEN m = 2 THEN 'rejected' WHEN length(text) NOT BETWEEN 12 AND 700 THEN 'rejected' ELSE 'new' END AS status FROM r""",
)
def translation_apply(t: Tables):
    p = turn_pairs(t).withColumn("fact", F.col("conv_id") * 100 + F.col("turn")).withColumn("m", F.col("turn") % 4)
    pending = p.select("fact", F.col("conv_id").alias("entity"), F.col("before").alias("quote"), F.when(F.col("m") == 0, "pl").otherwise("en").alias("language"), F.lit("untranslated").alias("status"))
    results = p.select("fact", F.when(F.col("m") != 1, F.col("after")).alias("translated"), F.when(F.col("m") == 2, "loop").alias("problem"))
    return K.apply_translations(pending, "fact", results).select("fact", "status")


@query(
    "child_records",
    """WITH r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS pos FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)), u AS (SELECT 'https://r.example/' || l_orderkey || CASE WHEN pos = 0 THEN '' ELSE '#przepis-' || (pos + 1) END AS url, pos, l_linenumber AS record FROM r)
    SELECT * FROM u WHERE NOT (pos > 0 AND url IN (SELECT 'https://r.example/' || o_orderkey || '#przepis-2' FROM orders WHERE o_orderstatus = 'F'))""",
)
def child_records(t: Tables):
    pages = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("records"))  # lines of one order
    pages = pages.withColumn("page", F.concat(F.lit("https://r.example/"), F.col("l_orderkey").cast("string")))
    taken = t.orders.select(F.concat(F.lit("https://r.example/"), F.col("o_orderkey").cast("string"), F.lit("#przepis-2")).alias("url"), F.when(F.col("o_orderstatus") == "F", "approved").otherwise("raw").alias("status"))
    return K.child_records(pages, "page", "records", taken).select("url", "pos", "record")


@query(
    "scanned_urls_sample",
    """WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents) SELECT * FROM r WHERE rank <= CASE lang WHEN 'en' THEN 8 WHEN 'fr' THEN 4 WHEN 'de' THEN 2 ELSE 0 END""",
)
def scanned_urls_sample(t: Tables):
    rows = t.documents.select("doc_id", "source", "lang", "n_chars")
    return K.class_samples(rows, "source", "lang", "n_chars", "doc_id", {"en": 8, "fr": 4, "de": 2}).drop("n_chars")


@query("point_kind_mode", "SELECT l_orderkey, l_returnflag FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, l_returnflag) = 1")
def point_kind_mode(t: Tables):
    return K.kind_mode(t.lineitem, "l_orderkey", "l_returnflag")


@query(
    "derived_slots",
    """WITH o AS (SELECT DISTINCT p_brand AS entity, p_type AS part FROM part WHERE p_size > 20), w AS (SELECT DISTINCT p_brand AS entity, p_type AS part FROM part EXCEPT SELECT * FROM o), u AS (SELECT *, 'own' AS origin FROM o UNION ALL SELECT *, 'web' FROM w)
    SELECT entity, origin, 'parts.' || part || '.' || f AS slot FROM u, (SELECT unnest(['look', 'uses']) AS f)""",
)
def derived_slots(t: Tables):
    p = t.part.select(F.col("p_brand").alias("entity"), F.col("p_type").alias("part"), "p_size")
    return K.derived_slots(p.filter("p_size > 20"), "entity", "part", p, ["look", "uses"])


@query("palette_build")
def palette_build(t: Tables):
    items = t.supplier.select(F.col("s_suppkey").alias("item"))
    mapping = items.select("item", F.concat(F.lit("src"), F.col("item").cast("string")).alias("source"))
    return K.palette_build(items, "item", mapping, t.documents.select("source", "doc_id", "text"), "source", "doc_id", "text", F.contains("text", F.lit("!!")), 5).select("item", "kind", "doc_id")


@query("fact_entry_projection", """SELECT doc_id, '{"id":"f' || doc_id || '","jezyk":"' || lang || '"' || CASE WHEN quality = 1 THEN ',"jakosc":1' ELSE '' END || '}' AS entry FROM documents LEFT JOIN labels USING (doc_id)""")
def fact_entry_projection(t: Tables):
    rows = t.documents.join(t.labels, "doc_id", "left")
    entry = K.fact_entry({"id": F.concat(F.lit("f"), F.col("doc_id").cast("string")), "jezyk": F.col("lang"), "jakosc": F.when(F.col("quality") == 1, 1)})
    return rows.select("doc_id", entry.alias("entry"))


@query(
    "suggested_moves",
    """WITH p AS (SELECT p_partkey AS point, p_brand AS entity, 'rule' AS place FROM part), m AS (SELECT p_partkey AS point, CASE WHEN p_size % 4 = 0 THEN 'known' ELSE 'fresh' || p_type END AS move, p_brand AS entity FROM part WHERE p_size > 25),
    a AS (SELECT entity, move FROM (SELECT DISTINCT entity, move FROM m WHERE move <> 'known') QUALIFY row_number() OVER (PARTITION BY entity ORDER BY move) <= 2)
    SELECT point, p.entity, coalesce(g.move, place) AS place FROM p LEFT JOIN (SELECT m.point, m.move FROM m LEFT JOIN a ON a.entity = m.entity AND a.move = m.move WHERE m.move = 'known' OR a.move IS NOT NULL) g USING (point)""",
)
def suggested_moves(t: Tables):
    points = t.part.select(F.col("p_partkey").alias("point"), F.col("p_brand").alias("entity"), F.lit("rule").alias("place"))
    moves = t.part.filter("p_size > 25").select(F.col("p_partkey").alias("point"), F.when(F.col("p_size") % 4 == 0, "known").otherwise(F.concat(F.lit("fresh"), "p_type")).alias("place"))
    return K.suggested_moves(points, "point", "entity", moves, ["known"], 2)


