"""Registered queries over training sets, features and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.functions import urls as U
from florilege.operators import models as M
from florilege.plans.pages import STATS_SQL, pattern_stats, visits
from florilege.plans.registry import Tables, query
from florilege.plans.standins import cte, standin


SET_SQL = """tset AS (SELECT ref, label, weight, grp, origin FROM (SELECT doc_id AS ref, CAST(quality AS VARCHAR) AS label, 3.0 AS weight, source AS grp, 'human' AS origin FROM labels JOIN documents USING (doc_id) UNION ALL
SELECT doc_id, CASE WHEN n_chars > 600 THEN '1' ELSE '0' END, 0.5, source, 'rules' FROM documents) QUALIFY row_number() OVER (PARTITION BY ref ORDER BY CASE WHEN origin = 'human' THEN 1 ELSE 0 END DESC, weight DESC) = 1)"""


def samples(t: Tables):
    human = t.labels.join(t.documents, "doc_id").select(F.col("doc_id").alias("ref"), "text", F.col("quality").cast("string").alias("label"), F.lit(3.0).alias("weight"), F.col("source").alias("group"), F.lit("human").alias("origin"))
    rules = t.documents.select(F.col("doc_id").alias("ref"), "text", F.when(F.col("n_chars") > 600, "1").otherwise("0").alias("label"), F.lit(0.5).alias("weight"), F.col("source").alias("group"), F.lit("rules").alias("origin"))
    return M.training_set([human, rules])


@query("training_set", f"WITH {SET_SQL} SELECT ref, label, CAST(weight AS DOUBLE) AS weight, grp AS \"group\", origin FROM tset")
def training_set(t: Tables):
    return samples(t).drop("text")


@query("merge_rare", "WITH n AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT doc_id, CASE WHEN n < 8 THEN '_inne' ELSE d.source || d.lang END AS label FROM documents d JOIN n ON n.source = d.source AND n.lang = d.lang")
def merge_rare(t: Tables):
    return M.merge_rare(t.documents.select("doc_id", F.concat("source", "lang").alias("label")), "label", 8)


@query("hashed_ngrams")
def hashed_ngrams(t: Tables):
    f = M.hashed_ngrams(t.documents, "doc_id", F.col("text"), longest=None)
    return f.groupBy("doc_id").agg(F.count("*").alias("features"), F.round(F.sum(F.col("value") * F.col("value")), 6).alias("length"))


@query(
    "pooled_embedding",
    """WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), m AS (SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM e GROUP BY 1, 2)
    SELECT label, CAST(pos AS INT) AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 5) AS value FROM m""",
)
def pooled_embedding(t: Tables):
    e = t.embeddings.select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return M.pooled_vectors(e, "label", "v").withColumn("value", F.round("value", 5))


@query(
    "group_kfold",
    f"""WITH {SET_SQL}, per AS MATERIALIZED (SELECT grp, label, count(*) AS n FROM tset GROUP BY 1, 2), mix AS (SELECT grp, label AS main, sum(n) OVER (PARTITION BY grp) AS n FROM per QUALIFY row_number() OVER (PARTITION BY grp ORDER BY per.n DESC, label DESC) = 1),
    placed AS (SELECT grp, main, row_number() OVER (PARTITION BY main ORDER BY -floor(log2(n)), left(md5(grp), 2), n DESC, md5(grp)) - 1 AS place FROM mix), k AS (SELECT greatest(2, least(5, count(*))) AS k FROM mix),
    f AS (SELECT grp, CAST((least(place % (2 * k), 2 * k - 1 - place % (2 * k)) + CAST('0x' || left(md5(coalesce(main, '')), 4) AS INT)) % k AS INT) AS fold FROM placed, k)
    SELECT fold, count(*) AS rows, count(DISTINCT tset.grp) AS groups FROM tset JOIN f ON f.grp = tset.grp GROUP BY fold""",
)
def group_kfold(t: Tables):
    folds = M.group_folds(samples(t), "group", "label", 5)
    sizes = samples(t).join(folds, "group").groupBy("fold").agg(F.count("*").alias("rows"), F.countDistinct("group").alias("groups"))
    return sizes


@query("classifier_fit")
def classifier_fit(t: Tables):
    """Recall per class of a language classifier over hashed features, each fold by a model that has not seen its sources."""
    rows = t.documents.join(t.labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", "lang", "source", (1 + F.coalesce("quality", F.lit(0))).alias("importance"))
    folds = M.group_folds(rows, "source", "lang", 2)
    features = M.hashed_vectors(t.documents, "doc_id", F.col("text"), size=4096)
    out = M.fit_folds(features, rows.join(folds, "source"), "doc_id", "lang", "fold", 2, size=4096, epochs=5, group="source", weight="importance")
    return out.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("lang") == F.col("predicted"), 1.0).otherwise(0.0)), 2).alias("recall"))


@query(
    "temperature_fit",
    """WITH d AS (SELECT [(doc_id * 37 % 100) / 25.0, (n_chars % 100) / 25.0, (doc_id * 11 % 100) / 25.0] AS z, CAST(doc_id % 3 AS INT) AS y FROM documents), t AS (SELECT 0.25 * pow(32.0, i / 79.0) AS t FROM range(80) r(i)),
    n AS (SELECT t, avg(ln(exp(z[1] / t) + exp(z[2] / t) + exp(z[3] / t)) - z[y + 1] / t) AS nll FROM d, t GROUP BY t) SELECT round(min_by(t, nll), 4) AS temperature, round(min(nll), 4) AS nll FROM n""",
)
def temperature_fit(t: Tables):
    logits = F.array((F.col("doc_id") * 37 % 100) / 25.0, (F.col("n_chars") % 100) / 25.0, (F.col("doc_id") * 11 % 100) / 25.0)
    out = M.fit_temperature(t.documents, logits, (F.col("doc_id") % 3).cast("int"), M.temperature_grid())
    return out.select(F.round("temperature", 4).alias("temperature"), F.round("nll", 4).alias("nll"))


CLASS_SQL = """c AS (SELECT x AS class, count(*) FILTER (label = x AND predicted = x) AS tp, count(*) FILTER (label = x) AS support, count(*) FILTER (predicted = x) AS given FROM decisions, (SELECT DISTINCT label AS x FROM decisions UNION SELECT DISTINCT predicted FROM decisions) GROUP BY x),
pr AS (SELECT class, support, CASE WHEN given = 0 THEN 0 ELSE tp / given END AS p, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS r FROM c), pc AS (SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, support FROM pr)"""


@query("eval_per_class", cte("decisions") + f", {CLASS_SQL} SELECT * FROM pc")
def eval_per_class(t: Tables):
    return M.per_class(standin(t, "decisions"), "label", "predicted")


@query("confusion", cte("decisions") + " SELECT label, predicted, count(*) AS n FROM decisions GROUP BY 1, 2")
def confusion(t: Tables):
    return M.confusion(standin(t, "decisions"), "label", "predicted")


RELIABILITY_SQL = "rel AS (SELECT CAST(ceil(confidence * 10 - 1e-12) AS INT) AS bin, count(*) AS n, avg(confidence) AS confidence, avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END) AS accuracy FROM decisions WHERE confidence > 0 GROUP BY 1)"


@query("reliability", cte("decisions") + f", {RELIABILITY_SQL} SELECT bin, n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM rel")
def reliability(t: Tables):
    out = M.reliability(standin(t, "decisions"), F.col("confidence"), F.col("label") == F.col("predicted"))
    return out.select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


@query(
    "eval_summary",
    cte("decisions")
    + f""", {CLASS_SQL}, {RELIABILITY_SQL}, q AS (SELECT confidence AS conf, count(*) AS n, count(*) FILTER (predicted = label) AS ok FROM decisions GROUP BY 1),
    r AS (SELECT conf, sum(n) OVER (ORDER BY conf DESC) AS cn, sum(ok) OVER (ORDER BY conf DESC) AS cok FROM q), b AS (SELECT * FROM r WHERE cn >= 20 AND cok / cn >= 0.88 ORDER BY conf LIMIT 1), tot AS (SELECT count(*) AS n, avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END) AS acc FROM decisions)
    SELECT n, round(acc, 6) AS accuracy, (SELECT round(avg(f1), 4) FROM pc WHERE support > 0) AS macro_f1, (SELECT round(sum(rel.n / tot.n * abs(accuracy - confidence)), 6) FROM rel) AS ece, coalesce((SELECT round(conf, 4) FROM b), 1.01) AS threshold,
    coalesce((SELECT round(cn / tot.n, 6) FROM b), 0) AS coverage FROM tot""",
)
def eval_summary(t: Tables):
    return M.eval_summary(standin(t, "decisions"), "label", "predicted", "confidence", 0.88)


@query(
    "selective_gate",
    cte("decisions") + """, m AS (SELECT unnest(['task0', 'task1']) AS task, unnest([0.3, 0.6]) AS threshold, unnest([['en', 'de'], ['en']]) AS allowed, unnest([TRUE, FALSE]) AS active)
    SELECT ref, d.task, predicted, CASE WHEN threshold IS NULL THEN 'no_model' WHEN NOT (confidence >= threshold AND list_contains(allowed, predicted)) THEN 'defer' WHEN NOT active THEN 'shadow'
    WHEN CAST('0x' || left(md5('11|' || ref), 8) AS BIGINT) % 10000 < 1000 THEN 'audit' ELSE 'accept' END AS decision FROM decisions d LEFT JOIN m ON m.task = d.task""",
)
def selective_gate(t: Tables):
    models = t.spark.createDataFrame([("task0", 0.3, ["en", "de"], True), ("task1", 0.6, ["en"], False)], "task string, threshold double, allowed array<string>, active boolean")
    return M.selective_gate(standin(t, "decisions"), "ref", "predicted", F.col("confidence"), models, "task", 0.1)


@query(
    "selective_check",
    cte("decisions") + " SELECT ref, CASE WHEN confidence < 0.5 THEN 'unsure' WHEN NOT known THEN 'fill' WHEN label = predicted THEN 'agree' ELSE 'conflict' END AS outcome FROM decisions",
)
def selective_check(t: Tables):
    d = standin(t, "decisions")
    return d.select("ref", M.check_given(F.when(F.col("known"), F.col("label")), F.col("predicted"), F.col("confidence"), 0.5).alias("outcome"))


@query(
    "allowed_classes",
    cte("decisions") + " SELECT predicted, count(*) AS n, round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 6) AS precision FROM decisions WHERE confidence >= 0.4 AND predicted <> 'es' GROUP BY 1 HAVING count(*) >= 5 AND avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END) >= 0.75",
)
def allowed_classes(t: Tables):
    return M.allowed_classes(standin(t, "decisions"), "label", "predicted", F.col("confidence"), 0.4, 0.8, ["es"])


@query(
    "active_classes",
    cte("decisions")
    + """, q AS (SELECT predicted, count(*) AS n, count(*) FILTER (predicted = label) AS k FROM decisions WHERE known AND confidence >= 0.2 AND predicted <> 'es' GROUP BY 1), w AS (SELECT predicted, n, round(greatest(0, (k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS lower FROM q)
    SELECT predicted, n, lower, CASE WHEN n >= 60 AND lower >= 0.85 THEN 'promoted' ELSE 'kept' END AS why FROM w WHERE (n >= 60 AND lower >= 0.85) OR (predicted IN ('de', 'fr') AND lower >= 0.5)""",
)
def active_classes(t: Tables):
    before = t.spark.createDataFrame([("de",), ("fr",)], "predicted string")
    agree = F.when(F.col("known"), F.col("label") == F.col("predicted"))
    return M.active_classes(standin(t, "decisions"), "predicted", agree, F.col("confidence"), 0.2, before, ["es"], 60, 0.85, 0.5)


@query(
    "decision_feedback",
    cte("decisions")
    + """, j AS (SELECT ref, predicted, CASE WHEN known THEN label END AS teacher_label, CASE WHEN quality = 1 THEN label WHEN quality = 0 THEN 'xx' END AS human_label FROM decisions LEFT JOIN labels ON doc_id = ref)
    SELECT ref, predicted, teacher_label, human_label, CASE WHEN human_label IS NOT NULL THEN predicted = human_label WHEN teacher_label IS NOT NULL THEN predicted = teacher_label END AS agree, CASE WHEN human_label IS NOT NULL THEN 3.0 WHEN teacher_label IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS weight FROM j""",
)
def decision_feedback(t: Tables):
    d = standin(t, "decisions")
    log = d.select("ref", "predicted", F.lit(None).cast("string").alias("teacher_label"), F.lit(None).cast("string").alias("human_label"))
    teachers = d.filter("known").select("ref", F.col("label").alias("teacher"))
    humans = t.labels.join(t.documents, "doc_id").select(F.col("doc_id").alias("ref"), F.when(F.col("quality") == 1, F.col("lang")).otherwise("xx").alias("human"))
    return M.fold_feedback(log, "ref", teachers, humans)


@query(
    "pattern_regex",
    f"""WITH {STATS_SQL}, g AS (SELECT site, '^(' || string_agg(DISTINCT replace(replace(replace(replace(pattern, '.', '\\.'), '{{n}}', '\\d+'), '{{id}}', '[\\w-]+'), '{{slug}}', '[\\w-]+'), '|') || ')/?$' AS regex FROM st WHERE hits > 0 GROUP BY 1),
    h AS (SELECT v.site, regexp_matches(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), regex) AS hit, v.hit AS u FROM v JOIN g ON g.site = v.site), n AS (SELECT site, count(*) FILTER (hit AND u) AS tp, count(*) FILTER (hit) AS given, count(*) FILTER (u) AS useful FROM h GROUP BY 1),
    s AS (SELECT *, CASE WHEN given = 0 THEN 0 ELSE tp / given END AS p, CASE WHEN useful = 0 THEN 0 ELSE tp / useful END AS r FROM n) SELECT site, tp, given, useful, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1 FROM s""",
)
def pattern_regex(t: Tables):
    regexes = M.pattern_regex(pattern_stats(t), "site", "pattern", F.col("hits") > 0)
    return M.score_regex(visits(t), "site", F.lower(U.path(F.col("url"))), F.col("hit"), regexes)


@query(
    "extraction_coverage",
    r"""WITH e AS (SELECT regexp_extract(url, '([^./]+\.[^./]+)(/|$|\?|#)', 1) AS site, contains(html, '<h1>') AS title, contains(html, '<article>') AS body, contains(html, '<li>') AS list FROM pages)
    SELECT site, count(*) AS pages, count(*) FILTER (title AND body AND list) AS complete, count(*) FILTER (title) AS n_title, count(*) FILTER (body) AS n_body, count(*) FILTER (list) AS n_list, round(count(*) FILTER (title AND body AND list) / count(*), 6) AS coverage,
    count(*) FILTER (title AND body AND list) / count(*) >= 0.6 AND count(*) FILTER (title AND body AND list) >= 2 AS passes FROM e GROUP BY 1""",
)
def extraction_coverage(t: Tables):
    p = t.pages.withColumn("site", U.registrable_domain(F.col("url")))
    fields = {"title": F.contains("html", F.lit("<h1>")), "body": F.contains("html", F.lit("<article>")), "list": F.contains("html", F.lit("<li>"))}
    return M.extraction_coverage(p, "site", fields, fields["title"] & fields["body"] & fields["list"])


