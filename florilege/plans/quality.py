"""Registered data-quality rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.operators import quality as J
from florilege.plans.registry import Tables, query
from florilege.plans.text_functions import norm_sql


@query(
    "candidate_checks",
    """WITH o AS (SELECT p_partkey AS entity, p_name AS name, p_brand AS brand FROM part WHERE p_size > 5), n AS (SELECT p_partkey AS entity, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_name END AS name, CASE WHEN p_size % 5 = 0 THEN 'x' ELSE p_brand END AS brand FROM part),
    fo AS (SELECT l_partkey AS entity, l_suppkey AS fact FROM lineitem WHERE l_returnflag = 'A'), fn AS (SELECT l_partkey AS entity, l_suppkey AS fact, l_linestatus, l_quantity, l_tax FROM lineitem WHERE l_returnflag <> 'R')
    SELECT n.entity, 'removed:name' AS error FROM n JOIN o USING (entity) WHERE n.name IS NULL UNION ALL SELECT n.entity, 'changed:brand' FROM n JOIN o USING (entity) WHERE n.brand <> o.brand UNION ALL SELECT entity, 'missing:name' FROM n WHERE name IS NULL AND entity NOT IN (SELECT entity FROM o)
    UNION ALL SELECT DISTINCT fo.entity, 'lost_facts' FROM fo WHERE NOT EXISTS (SELECT 1 FROM fn WHERE fn.entity = fo.entity AND fn.fact = fo.fact) UNION ALL SELECT DISTINCT entity, 'repeated_fact' FROM (SELECT entity, fact FROM fn GROUP BY 1, 2 HAVING count(*) > 1)
    UNION ALL SELECT DISTINCT entity, 'section' FROM fn WHERE l_linestatus = 'F' UNION ALL SELECT DISTINCT entity, 'length' FROM fn WHERE l_quantity < 3 UNION ALL SELECT DISTINCT entity, 'source' FROM fn WHERE l_tax > 0.07""",
)
def candidate_checks(t: Tables):
    p = t.part.withColumnRenamed("p_partkey", "entity")
    old = p.filter("p_size > 5").select("entity", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    new = p.select("entity", F.when(F.col("p_size") % 7 != 0, F.col("p_name")).alias("name"), F.when(F.col("p_size") % 5 == 0, "x").otherwise(F.col("p_brand")).alias("brand"))
    li = t.lineitem.select(
        F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("fact"), "l_returnflag", F.when(F.col("l_linestatus") == "F", "odd").otherwise("uprawa").alias("section"),
        F.when(F.col("l_quantity") < 3, "short").otherwise("a statement of fitting length").alias("text"), F.when(F.col("l_tax") > 0.07, "ftp:x").otherwise("https://a.example/x").alias("url"),
    )
    facts = li.filter("l_returnflag = 'A'").withColumn("version", F.lit("old")).unionByName(li.filter("l_returnflag <> 'R'").withColumn("version", F.lit("new")))
    return J.candidate_checks(old, new, "entity", ["name", "brand"], ["name"], facts, ["uprawa"])


@query(
    "layout_checks",
    """WITH p AS (SELECT l_orderkey AS entity, l_linenumber AS fact, l_returnflag, l_quantity, CAST(l_suppkey % 5 AS INT) AS source FROM lineitem), s AS (SELECT DISTINCT entity, source AS nr FROM p WHERE source < 4), f AS (SELECT o_orderkey AS entity, unnest([1, 2, 3]) AS fact FROM orders),
    n AS (SELECT entity, fact, count(*) AS n FROM p GROUP BY 1, 2), e AS (SELECT entity, 'section' AS error FROM p WHERE l_returnflag = 'N' UNION ALL SELECT entity, 'length' FROM p WHERE l_quantity < 5 UNION ALL SELECT entity, 'unknown_source' FROM p WHERE source >= 4
    UNION ALL SELECT entity, 'fact_twice' FROM n WHERE n > 1 UNION ALL SELECT entity, 'unknown_fact' FROM n WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.entity = n.entity AND f.fact = n.fact) UNION ALL SELECT entity, 'fact_left_out' FROM f WHERE NOT EXISTS (SELECT 1 FROM n WHERE f.entity = n.entity AND f.fact = n.fact))
    SELECT entity, error, count(*) AS n FROM e GROUP BY 1, 2""",
)
def layout_checks(t: Tables):
    p = t.lineitem.select(
        F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("fact"), F.when(F.col("l_returnflag") == "N", "odd").otherwise("opis").alias("section"),
        F.when(F.col("l_quantity") < 5, "short").otherwise("a statement of fitting length").alias("text"), (F.col("l_suppkey") % 5).cast("int").alias("source"),
    )
    sources = p.filter("source < 4").select("entity", F.col("source").alias("nr")).repartition("entity", "nr").distinct()
    facts = t.orders.select(F.col("o_orderkey").alias("entity"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("fact"))
    return J.layout_checks(facts, p, sources, "entity", ["opis"])


@query(
    "merged_checks",
    """WITH r AS (SELECT l_orderkey AS entity, l_linenumber, l_returnflag AS slot, l_linestatus, l_quantity, l_suppkey % 6 AS s, l_tax FROM lineitem)
    SELECT entity, slot, 'unknown_slot' AS error FROM r WHERE slot = 'N' UNION ALL SELECT entity, slot, 'original_changed' FROM r WHERE l_linestatus = 'F' AND l_tax > 0.05 UNION ALL SELECT entity, slot, 'bad_text' FROM r WHERE l_quantity = 1 UNION ALL SELECT entity, slot, 'unknown_source' FROM r WHERE s = 5""",
)
def merged_checks(t: Tables):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("entity"), F.col("l_returnflag").alias("slot"), F.when(F.col("l_linestatus") == "F", "text").alias("original"), F.when(F.col("l_tax") > 0.05, "other").otherwise("text").alias("live"),
        F.when(F.col("l_quantity") == 1, "<b>x</b>").otherwise("fine text").alias("text"), F.array((F.col("l_suppkey") % 6).cast("int")).alias("nums"), F.array(*[F.lit(i) for i in range(5)]).alias("known"),
    )
    return J.merged_checks(rows, "entity", "slot", ["A", "R"], "original", "live", "nums", "known")


@query(
    "placement_checks",
    """WITH r AS (SELECT l_orderkey AS entity, l_linenumber AS block, l_returnflag AS place, l_partkey AS fact, l_quantity, l_suppkey % 6 AS s FROM lineitem), m AS (SELECT DISTINCT l_orderkey AS entity, l_partkey AS fact FROM lineitem WHERE l_discount > 0.08),
    e AS (SELECT entity, 'unknown_place' AS error FROM r WHERE place = 'N' UNION ALL SELECT entity, 'empty' FROM r WHERE l_quantity = 1 UNION ALL SELECT entity, 'unknown_source' FROM r WHERE s = 5 UNION ALL SELECT entity, 'place_twice' FROM r GROUP BY entity, place HAVING count(DISTINCT block) > 1
    UNION ALL SELECT r.entity, 'already_merged' FROM r JOIN m ON m.entity = r.entity AND m.fact = r.fact) SELECT entity, error, count(*) AS n FROM e GROUP BY 1, 2""",
)
def placement_checks(t: Tables):
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("block"), F.col("l_returnflag").alias("place"), F.col("l_partkey").alias("fact"), F.when(F.col("l_quantity") == 1, " ").otherwise("fine").alias("text"),
        F.array((F.col("l_suppkey") % 6).cast("int")).alias("sources"), F.array(*[F.lit(i) for i in range(5)]).alias("known"),
    )
    merged = t.lineitem.filter("l_discount > 0.08").select(F.col("l_orderkey").alias("entity"), F.col("l_partkey").alias("fact"))
    return J.placement_checks(rows, "entity", "place", ["A", "R"], merged)


@query(
    "media_checks",
    "SELECT p_partkey, 'label' AS error FROM part WHERE p_size % 5 = 0 UNION ALL SELECT p_partkey, 'host' FROM part WHERE p_size % 3 = 0 UNION ALL SELECT p_partkey, 'author' FROM part WHERE p_size > 45",
)
def media_checks(t: Tables):
    label = F.when(F.col("p_size") % 5 == 0, F.lit("<b>")).otherwise(F.col("p_name"))
    url = F.when(F.col("p_size") % 3 == 0, F.lit("https://other.example/x.jpg")).otherwise(F.lit("https://upload.example/x.jpg"))
    rows = t.part.select("p_partkey", F.create_map(label, url).alias("gallery"), F.when(F.col("p_size") <= 45, F.col("p_brand")).alias("author"), F.lit("CC0").alias("licence"))
    return J.media_checks(rows, "p_partkey", "gallery", r"^https://upload\.example/")


@query(
    "identity_align",
    """WITH r AS (SELECT c_custkey AS file, CASE WHEN c_acctbal < 0 THEN c_custkey + 100000 WHEN c_acctbal > 9000 THEN c_custkey - 1 ELSE c_custkey END AS stored FROM customer), j AS (SELECT *, CASE WHEN stored = file THEN 'kept' WHEN stored IN (SELECT file FROM r) THEN 'refused' ELSE 'aligned' END AS action FROM r)
    SELECT file, CASE WHEN action = 'refused' THEN stored ELSE file END AS stored, action, CASE WHEN action = 'aligned' THEN stored END AS alias FROM j""",
)
def identity_align(t: Tables):
    stored = F.when(F.col("c_acctbal") < 0, F.col("c_custkey") + 100000).when(F.col("c_acctbal") > 9000, F.col("c_custkey") - 1).otherwise(F.col("c_custkey"))
    return J.identity_align(t.customer.select(F.col("c_custkey").alias("file"), stored.alias("stored")), "file", "stored")


@query(
    "layout_answer_checks",
    """WITH i AS (SELECT DISTINCT l_orderkey AS entity, l_linenumber AS fact FROM lineitem), a AS (SELECT l_orderkey AS entity, CASE WHEN l_quantity = 50 THEN 99 ELSE l_linenumber END AS fact, l_tax < 0.08 AS ok FROM lineitem WHERE l_discount < 0.1), n AS (SELECT entity, fact, count(*) AS n, bool_and(ok) AS ok FROM a GROUP BY 1, 2),
    j AS (SELECT coalesce(i.entity, n.entity) AS entity, i.fact AS f, n, ok FROM i FULL JOIN n ON i.entity = n.entity AND i.fact = n.fact), g AS (SELECT entity, count(*) FILTER (n IS NULL) AS left_out, count(*) FILTER (n > 1) AS twice, count(*) FILTER (f IS NULL) AS unknown, count(*) FILTER (NOT ok) AS unfaithful FROM j GROUP BY 1)
    SELECT *, left_out + twice + unknown + unfaithful = 0 AS accepted FROM g""",
)
def layout_answer_checks(t: Tables):
    inputs = t.lineitem.select(F.col("l_orderkey").alias("entity"), F.col("l_linenumber").alias("fact")).repartition("entity", "fact").distinct()
    answers = t.lineitem.filter("l_discount < 0.1").select(F.col("l_orderkey").alias("entity"), F.when(F.col("l_quantity") == 50, 99).otherwise(F.col("l_linenumber")).alias("fact"), (F.col("l_tax") < 0.08).alias("ok"))
    return J.layout_answer_checks(inputs, answers, "entity", "fact", F.col("ok"))


@query(
    "verdict_parse",
    """SELECT doc_id, CASE WHEN n_chars % 4 = 0 THEN 'new' WHEN n_chars % 3 = 0 THEN 'verified' ELSE 'rejected' END AS status, CASE WHEN n_chars % 4 = 0 THEN '' ELSE 'because ' || lang END AS reason FROM documents""",
)
def verdict_parse(t: Tables):
    item = F.struct(F.col("doc_id").alias("id"), (F.col("n_chars") % 3 == 0).alias("ok"), F.concat(F.lit("because "), F.col("lang")).alias("powod"))
    odd = F.struct((F.col("doc_id") + 10**9).alias("id"), F.lit(True).alias("ok"), F.lit("unknown").alias("powod"))
    answers = t.documents.filter("n_chars % 4 <> 0").select(F.to_json(F.struct(F.array(item, odd).alias("oceny"))).alias("raw"))
    return J.parse_verdicts(answers, "raw", t.documents.select("doc_id", F.lit("new").alias("status")), "doc_id")


@query(
    "review_parse",
    f"""WITH c AS (SELECT conv_id, turn, {norm_sql("split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2)")} AS q FROM conversations) SELECT conv_id, turn, 10 AS facts, 1 AS style, CASE WHEN length(q) >= 4 THEN 1 ELSE 0 END AS kept, CASE WHEN length(q) >= 4 THEN 1 ELSE 2 END AS dropped FROM c""",
)
def review_parse(t: Tables):
    head = F.concat_ws(" ", F.slice(F.split("text", " "), 1, 2))
    claims = F.array(F.struct(head.alias("cytat"), F.lit("a").alias("problem")), F.struct(F.lit("never said zzzqqq").alias("cytat"), F.lit("b").alias("problem")))
    raw = F.to_json(F.struct(F.create_map(F.lit("facts"), F.lit(14.0), F.lit("style"), F.lit(-3.0), F.lit("other"), F.lit(5.0)).alias("oceny"), claims.alias("bledy")))
    rows = t.conversations.select(F.struct("conv_id", "turn").alias("k"), "text", raw.alias("raw"))
    out = J.parse_review(rows, "k", "raw", "text", ["facts", "style"])
    return out.select("k.conv_id", "k.turn", F.try_element_at("marks", F.lit("facts")).alias("facts"), F.try_element_at("marks", F.lit("style")).alias("style"), "kept", "dropped")


@query("fact_answer_checks")
def fact_answer_checks(t: Tables):
    """Two true quotes of each turn, one repeated and one invented."""
    start = F.substring("text", 1, 60)
    made = F.array(*[F.struct(q.alias("cytat"), F.lit("uprawa").alias("sekcja"), F.lit("liście").alias("czesc")) for q in (start, start, F.lit("an invented quote that nobody wrote"))])
    rows = t.conversations.select(F.struct("conv_id", "turn").alias("k"), "text", F.to_json(F.struct(made.alias("fakty"))).alias("raw"))
    out = J.fact_answer_checks(rows.select("k", "raw"), "k", "raw", rows.select("k", "text"), "text", ["uprawa"])
    return out.select("k.conv_id", "k.turn", "pos", "section", "part", "reason")


@query(
    "idea_answer_checks",
    """WITH d AS (SELECT doc_id, text FROM documents), k AS (SELECT doc_id, 0 AS pos, 'an idea of more than thirty letters ' || doc_id AS idea FROM d WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars % 2 = 0) AND regexp_matches(text, '[a-zA-Z]'))
    SELECT * FROM k UNION ALL SELECT doc_id, NULL, '' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM k)""",
)
def idea_answer_checks(t: Tables):
    idea = F.concat(F.lit("an idea of more than thirty letters "), F.col("doc_id").cast("string"))
    quote = F.when(F.col("n_chars") % 2 == 0, F.regexp_extract("text", "([a-zA-Z]+)", 1)).otherwise("zzzqqq")
    made = F.array(F.struct(idea.alias("tekst"), quote.alias("cytat")), F.struct(F.lit("short").alias("tekst"), quote.alias("cytat")))
    return J.idea_answer_checks(t.documents, "doc_id", "text", t.documents.select("doc_id", F.to_json(made).alias("raw")), "raw")
