"""Registered queries over ordered rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.operators import sequences as S
from florilege.operators.primitives import newest_per_key, top_per_key
from florilege.plans.registry import Tables, query
from florilege.plans.standins import NOW, cte, standin


def ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


@query(
    "latest_per_key",
    """SELECT o_custkey, o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE)::VARCHAR AS day FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def latest_per_key(t: Tables):
    newest = newest_per_key(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return newest.select("o_custkey", "o_orderkey", "o_orderstatus", F.to_date("o_orderdate").cast("string").alias("day"))


@query(
    "threshold_search",
    cte("decisions")
    + """, c AS (SELECT confidence AS conf, count(*) AS n, count(*) FILTER (predicted = label) AS ok FROM decisions GROUP BY 1),
    r AS (SELECT conf, sum(n) OVER (ORDER BY conf DESC) AS cn, sum(ok) OVER (ORDER BY conf DESC) AS cok, (SELECT sum(n) FROM c) AS total FROM c),
    b AS (SELECT * FROM r WHERE cn >= 20 AND cok / cn >= 0.9 ORDER BY conf LIMIT 1)
    SELECT coalesce((SELECT round(conf, 4) FROM b), 1.01) AS threshold, coalesce((SELECT round(cn / total, 6) FROM b), 0) AS coverage,
    (SELECT round(cok / cn, 6) FROM b) AS accuracy, CAST(coalesce((SELECT cn FROM b), 0) AS BIGINT) AS n""",
)
def threshold_search(t: Tables):
    return S.choose_threshold(standin(t, "decisions"), F.col("confidence"), F.col("predicted") == F.col("label"), 0.9)


@query(
    "coverage_curve",
    cte("decisions")
    + """, p AS (SELECT i, i / 20.0 AS thr FROM range(21) r(i))
    SELECT round(CAST(i / 20 AS DOUBLE), 2) AS threshold, round(count(ref) / (SELECT count(*) FROM decisions), 6) AS coverage,
    round(count(*) FILTER (predicted = label) / nullif(count(ref), 0), 6) AS accuracy, count(ref) AS n
    FROM p LEFT JOIN decisions ON confidence >= CAST(thr AS DOUBLE) GROUP BY i""",
)
def coverage_curve(t: Tables):
    return S.coverage_curve(standin(t, "decisions"), F.col("confidence"), F.col("predicted") == F.col("label"))


@query(
    "repeated_failures",
    cte("runs")
    + """, f AS (SELECT job, run_id, "at", CASE WHEN value < 40 THEN 'failed' ELSE 'done' END AS status, CASE WHEN value < 40 THEN 'E' || CAST(floor(value / 30) AS INT) END AS signature FROM runs),
    l AS (SELECT * FROM f WHERE "at" >= TIMESTAMP '2024-01-10 00:00:00' QUALIFY row_number() OVER (PARTITION BY job ORDER BY "at" DESC, run_id DESC) <= 3)
    SELECT job, min(signature) AS signature FROM l GROUP BY job HAVING count(*) = 3 AND count(*) FILTER (status = 'failed') = 3 AND count(signature) = 3 AND min(signature) = max(signature)""",
)
def repeated_failures(t: Tables):
    failed = F.col("value") < 40
    runs = standin(t, "runs").select(
        "job", "run_id", "at",
        F.when(failed, "failed").otherwise("done").alias("status"),
        F.when(failed, F.concat(F.lit("E"), F.floor(F.col("value") / 30).cast("string"))).alias("signature"),
    )
    return S.repeated_failures(runs, "job", ["at", "run_id"], ntz("2024-01-10 00:00:00"))


@query(
    "low_yield_backoff",
    cte("runs")
    + """, s AS (SELECT job, count(*) FILTER (yielded < 2) AS low_runs, max("at") FILTER (yielded < 2) AS last FROM (SELECT r.*, coalesce(max(CASE WHEN yielded >= 2 THEN rn END) OVER (PARTITION BY job), 0) AS good
    FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY "at", run_id) AS rn FROM runs) r) WHERE rn > good GROUP BY job)
    SELECT j.job, coalesce(low_runs, 0) AS low_runs, coalesce(CASE WHEN low_runs = 2 THEN 7 WHEN low_runs = 3 THEN 14 WHEN low_runs > 3 THEN 30 END, 0) AS pause_days,
    CAST(CASE WHEN low_runs >= 2 THEN last + to_days(CASE WHEN low_runs = 2 THEN 7 WHEN low_runs = 3 THEN 14 ELSE 30 END) END AS VARCHAR) AS paused_until
    FROM (SELECT DISTINCT job FROM runs) j LEFT JOIN s ON s.job = j.job""",
)
def low_yield_backoff(t: Tables):
    out = S.low_yield_backoff(standin(t, "runs"), "job", ["at", "run_id"], F.col("yielded"))
    return out.withColumn("paused_until", F.col("paused_until").cast("string"))


@query(
    "block_backoff",
    cte("runs")
    + """, s AS (SELECT job, count(*) FILTER (kind = 'error') AS blocks, max("at") FILTER (kind = 'error') AS last FROM (SELECT *, coalesce(max(CASE WHEN kind = 'view' THEN rn END) OVER (PARTITION BY job), 0) AS good
    FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY "at", run_id) AS rn FROM runs)) WHERE rn > good GROUP BY job)
    SELECT j.job, coalesce(blocks, 0) AS blocks, coalesce(blocks, 0) > 3 AS switched_off, CAST(CASE blocks WHEN 1 THEN last + to_hours(1) WHEN 2 THEN last + to_hours(6) WHEN 3 THEN last + to_hours(24) END AS VARCHAR) AS paused_until
    FROM (SELECT DISTINCT job FROM runs) j LEFT JOIN s ON s.job = j.job""",
)
def block_backoff(t: Tables):
    out = S.block_backoff(standin(t, "runs"), "job", ["at", "run_id"], F.col("kind") == "view", F.col("kind") == "error")
    return out.withColumn("paused_until", F.col("paused_until").cast("string"))


@query(
    "circuit_breaker",
    cte("runs")
    + """, r AS (SELECT job, "at", run_id, CASE WHEN kind IN ('error', 'click') THEN 'bad' WHEN kind = 'signup' THEN 'odd' END AS reason, CASE WHEN value > 5 THEN 'v2' ELSE 'v1' END AS sig FROM runs),
    n AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY "at" DESC, run_id DESC) AS rn FROM r), l AS (SELECT job, reason, sig FROM n WHERE rn = 1),
    d AS (SELECT n.*, l.reason AS lr, l.sig AS ls, min(CASE WHEN n.reason IS NULL OR n.reason IS DISTINCT FROM l.reason OR n.sig <> l.sig THEN rn END) OVER (PARTITION BY n.job) AS stop FROM n JOIN l USING (job)),
    c AS (SELECT job, min(lr) AS reason, min(ls) AS sig, count(*) FILTER (rn < coalesce(stop, 1000000000)) AS repeats, max("at") AS last FROM d GROUP BY job)
    SELECT job, reason, sig, repeats, repeats >= 2 AND last >= TIMESTAMP '2024-01-28 00:00:00' AS blocked FROM c""",
)
def circuit_breaker(t: Tables):
    rows = standin(t, "runs").select(
        "job", "at", "run_id",
        F.when(F.col("kind").isin("error", "click"), "bad").when(F.col("kind") == "signup", "odd").alias("reason"),
        F.when(F.col("value") > 5, "v2").otherwise("v1").alias("sig"),
    )
    return S.circuit_breaker(rows, "job", ["at", "run_id"], ["reason", "sig"], 2, 72, ntz(NOW))


@query(
    "retry_chain_depth",
    """WITH RECURSIVE j AS (SELECT o_orderkey AS job, CASE WHEN o_orderkey % 97 <> 0 THEN o_orderkey - 1 END AS retry_of FROM orders),
    d AS (SELECT job, 0 AS depth FROM j WHERE retry_of IS NULL UNION ALL SELECT j.job, d.depth + 1 FROM j JOIN d ON j.retry_of = d.job)
    SELECT job, least(50, depth) AS depth FROM d""",
)
def retry_chain_depth(t: Tables):
    jobs = t.orders.select(F.col("o_orderkey").alias("job"), F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderkey") - 1).alias("retry_of"))
    return S.retry_depth(jobs, "job", "retry_of")


@query(
    "entity_history",
    """SELECT o_custkey AS entity, o_orderkey AS run, o_totalprice AS score, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 6) AS delta FROM orders""",
)
def entity_history(t: Tables):
    scores = t.orders.select(F.col("o_custkey").alias("entity"), "o_orderdate", F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("score"))
    return S.entity_history(scores, "entity", ["o_orderdate", "run"], "score", F.year("o_orderdate")).drop("o_orderdate")


@query(
    "best_label_per_ref",
    """WITH l AS (SELECT doc_id AS ref, quality AS label, 3 AS rank, 1.0 AS weight, doc_id * 10 AS id FROM labels UNION ALL SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END, CASE WHEN doc_id % 4 = 0 THEN 4 WHEN doc_id % 4 = 1 THEN 1 ELSE 2 END,
    CASE WHEN doc_id % 4 = 1 THEN 0.5 ELSE 1.0 END, doc_id * 10 + 1 FROM documents)
    SELECT ref, label, CAST(weight AS DOUBLE) AS weight FROM l QUALIFY row_number() OVER (PARTITION BY ref ORDER BY rank DESC, id DESC) = 1""",
)
def best_label_per_ref(t: Tables):
    cloud = t.labels.select(F.col("doc_id").alias("ref"), F.col("quality").alias("label"), F.lit("cloud").alias("origin"), (F.col("doc_id") * 10).alias("id"))
    origin = F.when(F.col("doc_id") % 4 == 0, "jsonld").when(F.col("doc_id") % 4 == 1, "local").otherwise("rules")
    rules = t.documents.select(F.col("doc_id").alias("ref"), F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("label"), origin.alias("origin"), (F.col("doc_id") * 10 + 1).alias("id"))
    rank = F.when(F.col("origin") == "jsonld", 4).when(F.col("origin") == "cloud", 3).when(F.col("origin") == "local", 1).otherwise(2)
    weight = F.when(F.col("origin") == "local", 0.5).otherwise(1.0)
    return S.best_label_per_ref(cloud.unionByName(rules), "ref", "label", rank, "id", weight)


@query(
    "cap_groups",
    """WITH c AS (SELECT greatest(10, CAST(floor(count(*) * 0.02) AS BIGINT)) AS cap FROM documents), n AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS k FROM documents)
    SELECT doc_id, source, CASE WHEN k < cap THEN source ELSE source || '#' || CAST(floor(k / cap) AS BIGINT) END AS capped_group FROM n, c""",
)
def cap_groups(t: Tables):
    return S.cap_groups(t.documents.select("doc_id", "source"), "source", "doc_id", F.floor(F.col("doc_id") / 4096), max_share=0.02)


@query(
    "keep_newest_k",
    """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 200 = user_id THEN 0 ELSE 1 END, ts DESC, event_id DESC) AS rank FROM events QUALIFY rank <= 14""",
)
def keep_newest_k(t: Tables):
    return S.keep_newest(t.events.select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], 14, F.col("event_id") % 200 == F.col("user_id")).drop("ts")


@query(
    "section_cohesion",
    """WITH li AS MATERIALIZED (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_discount) AS l_discount, max(l_tax) AS l_tax FROM lineitem GROUP BY ALL),
    p AS MATERIALIZED (SELECT l_orderkey AS e, l_linenumber AS n, l_returnflag AS section, CASE WHEN l_discount < 0.06 THEN 'A' WHEN l_discount < 0.09 THEN 'B' END AS place, l_orderkey * 10 + l_linenumber AS point FROM li),
    sc AS (SELECT l_orderkey * 10 + l_linenumber AS point, 'A' AS place, l_tax * 40 AS score FROM li UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'B', l_discount * 30 FROM li),
    sz AS (SELECT e, section, count(*) AS n FROM p GROUP BY ALL), v AS (SELECT e, section, place, count(*) AS votes FROM p WHERE place IS NOT NULL GROUP BY e, section, place QUALIFY row_number() OVER (PARTITION BY e, section ORDER BY votes DESC, place DESC) = 1),
    ld AS MATERIALIZED (SELECT sz.e, sz.section, v.place AS lead FROM sz JOIN v ON sz.e = v.e AND sz.section = v.section WHERE sz.n >= 3 AND votes / sz.n >= 0.6),
    w AS MATERIALIZED (SELECT p.point, p.place, ld.lead FROM p LEFT JOIN ld ON p.e = ld.e AND p.section = ld.section),
    s AS (SELECT w.point, any_value(w.place) AS place, any_value(lead) AS lead, max(score) FILTER (sc.place = lead) AS ls, max(score) FILTER (sc.place = w.place) AS os FROM w JOIN sc ON sc.point = w.point GROUP BY w.point)
    SELECT point, place, CASE WHEN coalesce(ls >= 1.0 AND ls >= coalesce(os, 0) - 0.5, false) THEN lead ELSE place END AS final_place FROM s""",
)
def section_cohesion(t: Tables):
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_discount").alias("l_discount"), F.max("l_tax").alias("l_tax"))
    base = lines.withColumn("point", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    place = F.when(F.col("l_discount") < 0.06, "A").when(F.col("l_discount") < 0.09, "B")
    points = base.select("point", F.col("l_orderkey").alias("e"), F.col("l_returnflag").alias("section"), place.alias("place"))
    pairs = F.array(
        F.struct(F.lit("A").alias("place"), (F.col("l_tax") * 40).alias("score")), F.struct(F.lit("B").alias("place"), (F.col("l_discount") * 30).alias("score"))
    )
    scores = base.select("point", F.inline(pairs))
    return S.section_cohesion(points, ["e", "section"], "place", scores, "point", 0.6, 0.5, 1.0).drop("e", "section")


@query(
    "champion_challenger",
    cte("decisions")
    + """, m AS (SELECT task, CAST(substr(source, 4) AS INT) AS version, avg(CASE WHEN predicted = label THEN 1.0 ELSE 0.0 END) / 2 + avg(confidence) / 2 AS score FROM decisions GROUP BY 1, 2),
    c AS (SELECT task, max(score) FILTER (version = 3) AS champ, max(score) FILTER (version <> 3) AS best FROM m GROUP BY task),
    b AS (SELECT m.task, version AS bv FROM m WHERE version <> 3 QUALIFY row_number() OVER (PARTITION BY task ORDER BY score DESC, version) = 1)
    SELECT m.task, version, round(score, 6) AS score, CASE WHEN version = 3 THEN CASE WHEN best >= champ - 0.01 THEN 'retired' ELSE 'current' END
    WHEN version = bv AND (champ IS NULL OR best >= champ - 0.01) THEN 'current' ELSE 'rejected' END AS status FROM m JOIN c USING (task) JOIN b USING (task)""",
)
def champion_challenger(t: Tables):
    ok = F.when(F.col("predicted") == F.col("label"), 1.0).otherwise(0.0)
    m = standin(t, "decisions").groupBy("task", F.substring("source", 4, 9).cast("int").alias("version")).agg(F.avg(ok).alias("f1"), F.avg("confidence").alias("coverage"))
    return S.champion_challenger(m, "task", "version", F.col("f1") / 2 + F.col("coverage") / 2, F.col("version") == 3)


@query(
    "least_recent_rotation",
    """WITH u AS (SELECT event_type AS kind, max(event_id) AS last_used FROM events WHERE event_type <> 'signup' GROUP BY 1), k AS (SELECT unnest(['view', 'click', 'error', 'purchase', 'story']) AS kind)
    SELECT k.kind, last_used, row_number() OVER (ORDER BY last_used NULLS FIRST, k.kind) AS turn FROM k LEFT JOIN u ON k.kind = u.kind""",
)
def least_recent_rotation(t: Tables):
    kinds = t.spark.createDataFrame([("view",), ("click",), ("error",), ("purchase",), ("story",)], "kind string")
    posts = t.events.filter("event_type <> 'signup'").withColumnRenamed("event_type", "kind")
    return S.least_recent_rotation(posts, kinds, "kind", "event_id", "view", 5)


@query(
    "silence_detection",
    """SELECT user_id, m AS silent_minutes, CASE WHEN user_id % 9 = 0 THEN 'dead' WHEN m >= 360 THEN 'stalled' ELSE 'alive' END AS state FROM
    (SELECT user_id, CAST(floor(epoch(TIMESTAMP '2024-01-31 00:00:00' - max(ts)) / 60) AS BIGINT) AS m FROM events GROUP BY 1)""",
)
def silence_detection(t: Tables):
    live = t.events.select("user_id").distinct().filter("user_id % 9 <> 0")
    return S.silence(t.events, "user_id", "ts", live, ntz(NOW), 360)


@query(
    "outage_window",
    """WITH f AS (SELECT DISTINCT user_id % 4 AS provider, user_id % 12 AS model, ts FROM events WHERE value < 15),
    s AS (SELECT *, lag(ts) OVER (PARTITION BY provider, model ORDER BY ts) AS prev FROM f),
    c AS (SELECT a.provider, a.model, a.ts, (SELECT count(DISTINCT b.model) FROM f b WHERE b.provider = a.provider AND b.ts BETWEEN a.ts - INTERVAL 3600 SECOND AND a.ts) AS models_down FROM s a WHERE prev IS NULL OR ts - prev > INTERVAL 3600 SECOND)
    SELECT provider, CAST(ts AS VARCHAR) AS ts, models_down FROM c WHERE models_down >= 2""",
)
def outage_window(t: Tables):
    f = t.events.filter("value < 15").select((F.col("user_id") % 4).alias("provider"), (F.col("user_id") % 12).alias("model"), "ts")
    return S.outages(f, "provider", "model", "ts", 3600, 2).withColumn("ts", F.col("ts").cast("string"))


@query(
    "query_variant_cap",
    """SELECT page_id, url FROM pages QUALIFY row_number() OVER (PARTITION BY CASE WHEN contains(url, '?') THEN split_part(url, '?', 1) ELSE CAST(page_id AS VARCHAR) END ORDER BY page_id) <= 3""",
)
def query_variant_cap(t: Tables):
    return S.cap_variants(t.pages.select("page_id", "url"), "url", "page_id", 3)


@query(
    "last_read_per_language",
    """SELECT source, lang AS language, max(CASE WHEN doc_id % 3 <> 0 AND source <> 'src4' THEN n_chars END) AS read_at FROM documents WHERE lang <> 'de' GROUP BY 1, 2""",
)
def last_read_per_language(t: Tables):
    url = F.when(F.col("lang") != "de", F.concat(F.lit("https://"), "lang", F.lit(".wikipedia.org/wiki/"), F.col("doc_id").cast("string"))).otherwise("https://example.org/")
    reads = t.documents.select("source", url.alias("url"), F.when((F.col("doc_id") % 3 != 0) & (F.col("source") != "src4"), F.col("n_chars")).alias("at"))
    language = F.nullif(F.regexp_extract("url", r"^https?://([a-z-]+)\.wikipedia\.org/", 1), F.lit(""))
    return S.last_read(reads, "source", language, "at")


@query(
    "recent_main_entities",
    "SELECT DISTINCT o_custkey AS entity FROM (SELECT * FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 40)",
)
def recent_main_entities(t: Tables):
    return S.recent_mains(t.orders.filter("o_orderstatus <> 'P'"), ["o_orderdate", "o_orderkey"], F.col("o_custkey"), 40)
