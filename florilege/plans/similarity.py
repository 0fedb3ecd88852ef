"""Registered near-copy queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.functions import text as X
from florilege.operators import similarity as S
from florilege.plans.registry import Tables, query
from florilege.plans.text_functions import jaccard_sql, polish_tokens_sql, tokens_sql


def records(t: Tables, some=None):
    """Documents, or those of some ids, as records: the first line is the title, the rest the content."""
    title = F.substring_index("text", "\n", 1)
    docs = t.documents if some is None else t.documents.join(some, "doc_id", "left_semi")
    return docs.select("doc_id", "source", X.title_tokens(title).alias("t"), X.title_tokens(F.expr("substring(text, length(substring_index(text, '\n', 1)) + 1)")).alias("i"))


RECORDS_SQL = f"""recs AS MATERIALIZED (SELECT doc_id, source, {tokens_sql("split_part(text, chr(10), 1)")} AS t, {tokens_sql("substr(text, length(split_part(text, chr(10), 1)) + 1)")} AS i FROM documents),
tt AS MATERIALIZED (SELECT doc_id, len(t) AS nt, unnest(t) AS w FROM recs), tp AS MATERIALIZED (SELECT a, b, t, nb FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) / (min(x.nt) + min(y.nt) - count(*)) AS t, min(y.nt) AS nb
FROM tt x JOIN tt y ON x.w = y.w AND x.doc_id < y.doc_id GROUP BY 1, 2) WHERE t >= 0.34),
pairs AS MATERIALIZED (SELECT a, b, t + i AS score FROM (SELECT a, b, tp.t, {jaccard_sql('x.i', 'y.i')} AS i, len(x.i) > 0 AND len(y.i) > 0 AS two, nb FROM tp JOIN recs x ON x.doc_id = a JOIN recs y ON y.doc_id = b)
WHERE CASE WHEN two THEN (t >= 0.5 AND i >= 0.5) OR (i >= 0.9 AND t >= 0.34) ELSE t >= 0.8 AND nb >= 2 END),
near AS MATERIALIZED (SELECT doc_id, (row_number() OVER (ORDER BY doc_id)) AS rn, coalesce(list(a) FILTER (a IS NOT NULL), []) AS before FROM recs LEFT JOIN pairs ON b = doc_id GROUP BY doc_id),
walk AS (SELECT 0::BIGINT AS rn, []::BIGINT[] AS kept UNION ALL SELECT n.rn, CASE WHEN list_has_any(kept, n.before) THEN kept ELSE list_append(kept, n.doc_id) END FROM walk w JOIN near n ON n.rn = w.rn + 1),
kept AS MATERIALIZED (SELECT unnest(kept) AS k FROM (SELECT kept FROM walk ORDER BY rn DESC LIMIT 1)),
dups AS MATERIALIZED (SELECT doc_id, a AS duplicate_of, round(score, 6) AS score FROM recs LEFT JOIN (SELECT a, b, score FROM pairs WHERE a IN (SELECT k FROM kept)) p ON b = doc_id AND doc_id NOT IN (SELECT k FROM kept)
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, a) = 1)"""


@query("near_dup_join", f"WITH RECURSIVE {RECORDS_SQL} SELECT doc_id, duplicate_of, score FROM dups")
def near_dup_join(t: Tables):
    return copies(t)


def copies(t: Tables):
    """The best earlier primary of each document; only documents that may be copies are cut into tokens again."""
    return S.near_duplicates(records(t), "doc_id", again=lambda ids: records(t, ids))


def deduplicated(t: Tables):
    dups = copies(t)
    url = F.concat(F.lit("https://"), "source", F.lit(".example/"), (F.col("doc_id") % 4).cast("string"))
    return t.documents.select("doc_id", url.alias("url")).join(dups, "doc_id")


@query(
    "group_sources",
    f"""WITH RECURSIVE {RECORDS_SQL}, u AS (SELECT coalesce(duplicate_of, d.doc_id) AS "primary", 'https://' || source || '.example/' || d.doc_id % 4 AS url, duplicate_of IS NULL AS prim, d.doc_id FROM documents d JOIN dups ON dups.doc_id = d.doc_id)
    SELECT "primary", url, bool_or(prim) AS is_primary, coalesce(min(doc_id) FILTER (prim), min(doc_id)) AS first_item FROM u GROUP BY 1, 2""",
)
def group_sources(t: Tables):
    return S.group_sources(deduplicated(t), "doc_id", "duplicate_of", "url")


@query("dup_extra_sources", f"WITH RECURSIVE {RECORDS_SQL} SELECT duplicate_of, count(*) AS extra FROM dups WHERE duplicate_of IS NOT NULL GROUP BY 1")
def dup_extra_sources(t: Tables):
    return copies(t).filter("duplicate_of IS NOT NULL").groupBy("duplicate_of").agg(F.count("*").alias("extra"))


@query(
    "cross_corpus_match",
    f"""WITH b AS (SELECT item_id AS id, {polish_tokens_sql("split_part(text, '.', 1)")} AS t, {polish_tokens_sql('text')} AS i FROM benchmark), c AS (SELECT t, i, min(id) AS id FROM b GROUP BY ALL),
    d AS (SELECT doc_id AS id, {polish_tokens_sql("split_part(text, '.', 1)")} AS t, {polish_tokens_sql('text')} AS i FROM documents),
    s AS (SELECT d.id, c.id AS match, {jaccard_sql('c.t', 'd.t')} AS t, {jaccard_sql('c.i', 'd.i')} AS i FROM d, c), v AS (SELECT *, CASE WHEN (t >= 0.5 AND i >= 0.5) OR (i >= 0.8 AND t >= 0.3) THEN 'same' WHEN (t >= 0.3 AND i >= 0.25) OR t >= 0.6 OR i >= 0.6 THEN 'maybe' ELSE 'no' END AS verdict FROM s)
    SELECT id, match, verdict, round(t, 6) AS t, round(i, 6) AS i FROM v WHERE verdict <> 'no' QUALIFY row_number() OVER (PARTITION BY id ORDER BY v.t + v.i DESC, match) = 1""",
)
def cross_corpus_match(t: Tables):
    def side(rows, key):
        return rows.select(F.col(key).alias("id"), X.polish_tokens(F.substring_index("text", ".", 1)).alias("t"), X.polish_tokens(F.col("text")).alias("i"))

    return S.cross_match(side(t.documents, "doc_id"), side(t.benchmark, "item_id"), "id")


@query(
    "dup_reparent",
    """SELECT doc_id, CASE WHEN doc_id % 32 <> 0 THEN doc_id - doc_id % 32 END AS duplicate_of FROM documents""",
)
def dup_reparent(t: Tables):
    parent = F.when(F.col("doc_id") % 32 != 0, F.col("doc_id") - 1)
    return S.reparent(t.documents.select("doc_id", parent.alias("duplicate_of")), "doc_id", "duplicate_of")
