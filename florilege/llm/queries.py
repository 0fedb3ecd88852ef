"""One registered query for each operator of this package, over its whole table, and the SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.llm import centroids, decontaminate, forest, language, lines, merkle, packing, pages_crf, quality, redirects, secrets, simhash, toxicity
from florilege.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``."""

    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


@query("op1_forest")
def op1_forest(spark: SparkSession, folder: str) -> DataFrame:
    return forest.link_vectors(table(spark, folder, "embeddings"))


_UNITS = ", ".join(f"'{u}'" for u in decontaminate.UNITS)
_TEMPLATE = f"""list_transform(w, lambda x, i: CASE WHEN x BETWEEN '0' AND '9~' THEN '<1>' WHEN i > 1 AND w[i - 1] BETWEEN '0' AND '9~' AND lower(x) IN ({_UNITS}) THEN '<2>'
WHEN (x < 'a' OR x >= chr(128)) AND length(x) > 1 AND x <> lower(x) AND substr(x, 2) = substr(lower(x), 2) THEN '<3>' ELSE lower(x) END)"""
_SAME = "t.it[{k}:{k} + 4] = t.dt[{k} + {by}:{k} + {by} + 4] AND {k} >= 1 AND {k} + {by} >= 1 AND len(t.it[{k}:{k} + 4]) = 5"
OP2_SQL = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, w, {_TEMPLATE} AS t FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{decontaminate.TOKEN}') AS w FROM documents WHERE doc_id IS NOT NULL)),
b AS MATERIALIZED (SELECT row_number() OVER () AS r, item_id, w, {_TEMPLATE} AS t, least(len(w), 5) AS n FROM (SELECT DISTINCT item_id, regexp_extract_all(coalesce(text, ''), '{decontaminate.TOKEN}') AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
widths AS MATERIALIZED (SELECT DISTINCT n FROM b),
asked AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT item_id, 0 AS kind, i, array_to_string(t[i:i + 4], ' ') AS k FROM (SELECT item_id, t, unnest(range(1, len(t) - 3)) AS i FROM b) WHERE len(list_filter(t[i:i + 4], lambda x: NOT starts_with(x, '<'))) >= {decontaminate.LITERALS}
UNION ALL SELECT item_id, n AS kind, i, lower(array_to_string(w[i:i + n - 1], ' ')) AS k FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b))),
seen AS (SELECT doc_id, 0 AS kind, i, array_to_string(t[i:i + 4], ' ') AS k FROM (SELECT doc_id, t, unnest(range(1, len(t) - 3)) AS i FROM d)
UNION ALL SELECT doc_id, n AS kind, i, lower(array_to_string(w[i:i + n - 1], ' ')) AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN widths)),
once AS MATERIALIZED (SELECT DISTINCT doc_id, item_id, seen.kind, seen.i - asked.i AS shift, asked.i, seen.k FROM seen JOIN asked ON asked.kind = seen.kind AND asked.k = seen.k),
enough AS MATERIALIZED (SELECT f.doc_id, f.item_id, f.kind, windows, found FROM (SELECT doc_id, item_id, kind, count(DISTINCT k) AS found FROM once GROUP BY 1, 2, 3) f JOIN (SELECT item_id, kind, count(DISTINCT k) AS windows FROM asked GROUP BY 1, 2) z ON z.item_id = f.item_id AND z.kind = f.kind WHERE found >= {decontaminate.SHARE} * windows),
best AS (SELECT doc_id, item_id, shift AS best FROM once WHERE kind = 0 GROUP BY 1, 2, 3 QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY count(DISTINCT k) DESC, shift) = 1),
texts AS MATERIALIZED (SELECT row_number() OVER () AS c, e.doc_id, e.item_id, windows, found, best, b.w AS iw, b.t AS it, d.w AS dw, d.t AS dt FROM enough e JOIN best ON best.doc_id = e.doc_id AND best.item_id = e.item_id JOIN b ON b.item_id = e.item_id JOIN d ON d.doc_id = e.doc_id WHERE kind = 0),
held AS MATERIALIZED (SELECT t.c, o.shift, o.i, abs(o.shift - t.best) AS away FROM texts t JOIN once o ON o.kind = 0 AND o.doc_id = t.doc_id AND o.item_id = t.item_id WHERE {_SAME.format(k='o.i', by='o.shift')}),
slots AS MATERIALIZED (SELECT * FROM (SELECT *, unnest(range(1, len(it) + 1)) AS i FROM texts WHERE c IN (SELECT c FROM held)) WHERE it[i] IN ('<1>', '<2>', '<3>')),
covered AS (SELECT s.c, s.i, h.shift AS via FROM slots s JOIN held h ON h.c = s.c AND h.i BETWEEN s.i - 4 AND s.i QUALIFY row_number() OVER (PARTITION BY s.c, s.i ORDER BY h.away, h.shift, h.i) = 1),
beside AS (SELECT DISTINCT t.c, t.i FROM (SELECT *, unnest(range(greatest(i - 4, 1), i + 1)) AS k FROM slots) t WHERE {_SAME.format(k='t.k', by='t.best')}),
placed AS (SELECT s.c, s.iw[s.i] AS a, s.dw[s.i + coalesce(covered.via, s.best)] AS v FROM slots s LEFT JOIN covered ON covered.c = s.c AND covered.i = s.i LEFT JOIN beside ON beside.c = s.c AND beside.i = s.i WHERE covered.c IS NOT NULL OR beside.c IS NOT NULL),
judged AS (SELECT t.doc_id, t.item_id, t.windows, t.found, coalesce(n.slots, 0) AS slots, coalesce(n.changed, 0) AS changed FROM texts t LEFT JOIN (SELECT c, count(*) AS p, count(DISTINCT a) AS slots, count(*) FILTER (a IS DISTINCT FROM v) AS changed FROM (SELECT DISTINCT c, a, v FROM placed) GROUP BY c) n ON n.c = t.c WHERE t.c IN (SELECT c FROM held) AND coalesce(n.p - n.slots, 0) <= (1 - {decontaminate.SHARE}) * coalesce(n.slots, 0)),
filled AS MATERIALIZED (SELECT doc_id, item_id, max(windows) AS windows, max(found) AS found, max(slots) AS slots, min(changed) AS changed FROM judged GROUP BY 1, 2),
known AS (SELECT item_id, count(DISTINCT v) FILTER (x IN ('<1>', '<2>', '<3>')) AS slots FROM (SELECT item_id, unnest(w) AS v, unnest(t) AS x FROM b) GROUP BY item_id)
SELECT doc_id, item_id, windows, found, CAST(slots AS INT) AS slots, CAST(changed AS INT) AS changed FROM filled
UNION ALL SELECT e.doc_id, e.item_id, max(e.windows), max(e.found), CAST(any_value(known.slots) AS INT), 0 FROM enough e JOIN known ON known.item_id = e.item_id ANTI JOIN filled ON filled.doc_id = e.doc_id AND filled.item_id = e.item_id WHERE e.kind > 0 GROUP BY 1, 2"""


@query("op2_decontamination", OP2_SQL)
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_quality")
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels")).select("doc_id", "held_out", "score", "predicted")


@query("op4_secrets")
def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.col("spans")
    n = {f"n_{kind}": secrets.counted(spans, kind) for kind in secrets.KINDS[:3]}
    base = F.sha2(secrets.spelt(spans, secrets.KINDS[:3]).cast("binary"), 256)
    scanned = secrets.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return scanned.select("doc_id", *[c.alias(k) for k, c in n.items()], base.alias("base_sha256"), secrets.spelt(spans).alias("spans"))


@query("op5_simhash")
def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_language")
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.languages(table(spark, folder, "documents"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_packing")
def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, folder, "documents")))


def _address_sql(url: str) -> str:
    pattern = r"^\s*([A-Za-z][A-Za-z0-9+.-]*://)([^/?#\s]*)([^?#\s]*)([^#\s]*)"
    part = lambda i: f"regexp_extract({url}, '{pattern}', {i})"
    root = f"translate({part(1)} || {part(2)}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = f"string_split(regexp_replace({part(3)}, '(/\\.{{1,2}})$', '\\1/'), '/')[2:]"
    step = "CASE WHEN x[1] = '.' THEN acc WHEN x[1] = '..' THEN acc[1:greatest(len(acc) - 1, 1)] ELSE acc || x END"
    kept = f"array_to_string(list_reduce(list_prepend([''], list_transform({parts}, lambda s: [s])), lambda acc, x: {step}), '/')"
    path = f"CASE WHEN {part(3)} = '' THEN '/' WHEN regexp_matches({part(3)}, '/\\.{{1,2}}(?:/|$)') THEN {kept} ELSE {part(3)} END"
    return f"CASE WHEN {root} <> '' THEN {root} || {path} || {part(4)} END"


def _rule_sql(host: str, path: str, what: int) -> str:
    fits = [
        f"WHEN ({host} = '{r.split('/', 1)[0]}' OR {host} LIKE '%.{r.split('/', 1)[0]}') AND starts_with({path}, '/{r.split('/', 1)[1]}') THEN '{(v, r)[what]}'"
        for v, r in sorted(redirects.RULES, key=lambda x: -len(x[1]))
    ]
    return f"CASE {' '.join(fits)} END"


_HOST = lambda u: f"translate(regexp_extract(CASE WHEN contains({u}, '://') THEN {u}[instr({u}, '://') + 3:] ELSE '' END, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PATH = lambda u: f"regexp_extract(CASE WHEN contains({u}, '://') THEN {u}[instr({u}, '://') + 3:] ELSE '' END, '^[^/?#]*([^?#]*)', 1)"

_UNSEEN = "(?is)<!--.*?(?:-->|\\z)|" + "|".join(rf"<{t}\b.*?(?:</{t}\s*>|\z)" for t in ("script", "style", "template"))
_HREF = "concat(" + ", ".join(rf"""regexp_extract(tag, '(?is)\bhref\s*=\s*(?:"\s*([^"]*?)\s*"|''\s*([^'']*?)\s*''|([^\s"''>]+))', {i})""" for i in (1, 2, 3)) + ")"
OP9_SQL = rf"""WITH RECURSIVE tags AS (SELECT source, unnest(regexp_extract_all(regexp_replace(html, '{_UNSEEN}', ' ', 'g'), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM (SELECT {_address_sql('url')} AS source, html FROM pages) WHERE source IS NOT NULL),
refs AS (SELECT source, CASE WHEN regexp_matches(tag, '(?is)^<link\b.*\brel\s*=\s*["'']?canonical\b') THEN {_HREF} WHEN regexp_matches(tag, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']?[^"''>]*?url\s*=\s*[''"]?\s*([^"''>\s]+)', 1) END AS ref FROM tags),
whole AS (SELECT source, CASE WHEN regexp_matches(r, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN r WHEN starts_with(r, '//') THEN regexp_extract(source, '^[^/]*') || r WHEN starts_with(r, '/') THEN regexp_extract(source, '^[^/]*//[^/]*') || r ELSE regexp_extract(source, '^[^?]*/') || r END AS target FROM (SELECT source, replace(trim(ref), '&amp;', '&') AS r FROM refs WHERE ref <> '')),
links AS MATERIALIZED (SELECT DISTINCT source AS a, t AS b FROM (SELECT source, {_address_sql('target')} AS t FROM whole) WHERE t IS NOT NULL AND t <> source), ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS node, a AS seen FROM ways UNION SELECT ways.b, reach.seen FROM reach JOIN ways ON ways.a = reach.node), groups AS MATERIALIZED (SELECT node, min(seen) AS alias_of FROM reach GROUP BY node),
own AS (SELECT alias_of, {_rule_sql(_HOST('node'), _PATH('node'), 0)} AS v FROM groups), carried AS (SELECT alias_of, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS v FROM own GROUP BY 1),
seen AS (SELECT page_id, coalesce({_HOST('url')}, '') AS host, coalesce({_PATH('url')}, '') AS path, {_address_sql('url')} AS address FROM pages)
SELECT page_id, host, path, {_rule_sql('host', 'path', 1)} AS rule, coalesce({_rule_sql('host', 'path', 0)}, carried.v, 'allow') AS verdict, groups.alias_of FROM seen LEFT JOIN groups ON groups.node = seen.address LEFT JOIN carried ON carried.alias_of = groups.alias_of"""


@query("op9_redirects", OP9_SQL)
def op9_redirects(spark: SparkSession, folder: str) -> DataFrame:
    return redirects.judge(table(spark, folder, "pages"))


@query("op10_extraction")
def op10_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return pages_crf.main_texts(table(spark, folder, "pages"))


_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP11_SQL = rf"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS MATERIALIZED (SELECT r, doc_id, p, l[p] AS line, {_ASCII_LOWER.format("trim(l[p], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS k FROM (SELECT r, doc_id, l, unnest(range(1, len(l) + 1)) AS p FROM d)),
keys AS (SELECT k, min(doc_id) AS first FROM x WHERE length(k) >= {lines.SHORTEST} GROUP BY k HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INT)) >= {lines.LEAST_DOCS}),
judged AS (SELECT x.*, keys.k IS NOT NULL AND x.doc_id IS DISTINCT FROM keys.first AS gone FROM x LEFT JOIN keys ON keys.k = x.k)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256 FROM judged GROUP BY r"""


@query("op11_lines", OP11_SQL)
def op11_lines(spark: SparkSession, folder: str) -> DataFrame:
    done = lines.drop_shared(table(spark, folder, "documents"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


_FIELD = "coalesce(CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD.format(f) for f in ("doc_id", "source", "lang", "n_chars", text)) + ")"
# bit by bit, over the ASCII codes of the decimal id
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST(range(8) AS BIGINT[])), lambda v, i: xor(v >> 1, (v & 1) * 3988292384::BIGINT))), 4294967295::BIGINT)"""
# levels 0 to 9 hold a group of up to 8^9 rows; a group of one node passes a level as it is
_LEVELS = range(9)
_UP = "\n".join(
    f"""a{k} AS MATERIALIZED (SELECT g, p // 8 AS p, count(*) OVER (PARTITION BY g) AS n, sha256(string_agg(h, '' ORDER BY p)) AS up, min(h) AS own, max(n) AS was FROM l{k} GROUP BY g, p // 8),
l{k + 1} AS MATERIALIZED (SELECT g, p, n, CASE WHEN was = 1 THEN own ELSE up END AS h FROM a{k}),"""
    for k in _LEVELS
)
_LEAVES = f"""leaves AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, {_LEAF('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {_CRC32} % 3 = 0 THEN {_LEAF(_ASCII_LOWER.format('text'))} END AS low FROM documents),
rows AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
langs AS MATERIALIZED (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) AS g FROM (SELECT DISTINCT lang FROM leaves)),
l0 AS MATERIALIZED (SELECT g, p, n, leaf AS h FROM rows JOIN langs ON langs.lang IS NOT DISTINCT FROM rows.lang),"""


def _fold_sql(levels: str, last: int, proof: str, node: str, top: str) -> str:
    """Steps that fold (r, g, p, proof, node) over ``levels``0 to ``last``."""
    return "\n".join(
        f"""{top}{k + 1} AS MATERIALIZED (SELECT s.r, s.g, s.p // 8 AS p, s.{proof} || CASE WHEN max(x.n) = 1 THEN '' ELSE coalesce(string_agg(x.h, '' ORDER BY x.p) FILTER (x.p <> s.p), '') END AS {proof},
CASE WHEN max(x.n) = 1 THEN s.{node} ELSE sha256(string_agg(CASE WHEN x.p = s.p THEN s.{node} ELSE x.h END, '' ORDER BY x.p)) END AS {node} FROM {top}{k} s JOIN {levels}{k} x ON x.g = s.g AND x.p // 8 = s.p // 8 GROUP BY s.r, s.g, s.p, s.{proof}, s.{node}),"""
        for k in range(last)
    )


_TOP_LEVELS = range(3)
_TOP = "\n".join(
    f"""b{k} AS MATERIALIZED (SELECT 0 AS g, p // 8 AS p, count(*) OVER () AS n, sha256(string_agg(h, '' ORDER BY p)) AS up, min(h) AS own, max(n) AS was FROM t{k} GROUP BY p // 8),
t{k + 1} AS MATERIALIZED (SELECT g, p, n, CASE WHEN was = 1 THEN own ELSE up END AS h FROM b{k}),"""
    for k in _TOP_LEVELS
)
OP12_SQL = f"""WITH {_LEAVES}
{_UP}
t0 AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n, h, g AS lang_g FROM l{len(_LEVELS)}),
{_TOP}
f0 AS (SELECT r, g, p, '' AS proof, coalesce(low, leaf) AS node FROM rows JOIN langs ON langs.lang IS NOT DISTINCT FROM rows.lang),
{_fold_sql('l', len(_LEVELS), 'proof', 'node', 'f')}
s0 AS (SELECT f.r, 0 AS g, t0.p, proof, node FROM f{len(_LEVELS)} f JOIN t0 ON t0.lang_g = f.g),
{_fold_sql('t', len(_TOP_LEVELS), 'proof', 'node', 's')}
subroots AS (SELECT lang, h AS subroot FROM l{len(_LEVELS)} l JOIN langs ON langs.g = l.g), top AS (SELECT h AS root FROM t{len(_TOP_LEVELS)})
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM rows JOIN s{len(_TOP_LEVELS)} s ON s.r = rows.r JOIN subroots ON subroots.lang IS NOT DISTINCT FROM rows.lang CROSS JOIN top"""


@query("op12_merkle", OP12_SQL)
def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.verified(merkle.manifest(table(spark, folder, "documents")))


_ROUND = """a{t} AS MATERIALIZED (SELECT r, x, d, c FROM (SELECT v.r, v.x, m.c, list_sum(list_transform(list_zip(v.x, m.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d, row_number() OVER (PARTITION BY v.r ORDER BY d, m.c) AS place FROM v CROSS JOIN m{t} m) WHERE place = 1),
s{t} AS (SELECT c, list(s ORDER BY i) AS x FROM (SELECT c, i, floor_div(sum(x[i]), count(*)) AS s FROM (SELECT c, x, unnest(range(1, 65)) AS i FROM a{t}) GROUP BY c, i) GROUP BY c),
m{u} AS MATERIALIZED (SELECT m.c, coalesce(s.x, m.x) AS x FROM m{t} m LEFT JOIN s{t} s ON s.c = m.c),
"""
_FLOOR = "CAST((sum(x[i]) - ((sum(x[i]) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
OP13_SQL = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY k NULLS LAST, x) - 1 AS c, x FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS k, x FROM v ORDER BY k NULLS LAST, x LIMIT 8)),
{"".join(_ROUND.format(t=t, u=t + 1) for t in range(centroids.ROUNDS)).replace("floor_div(sum(x[i]), count(*))", _FLOOR)}
{_ROUND.format(t=centroids.ROUNDS, u=centroids.ROUNDS + 1).split("s10 AS")[0]}
inertias AS (SELECT c, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a{centroids.ROUNDS} GROUP BY c)
SELECT vec_id, CAST(a.c AS INT) AS cluster, d AS distance, cluster_inertia, CAST((SELECT sum(d) FROM a{centroids.ROUNDS}) AS BIGINT) AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM a{centroids.ROUNDS} a JOIN v ON v.r = a.r JOIN m{centroids.ROUNDS} m ON m.c = a.c JOIN inertias ON inertias.c = a.c"""


@query("op13_centroids", OP13_SQL)
def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.clusters(table(spark, folder, "embeddings"))
