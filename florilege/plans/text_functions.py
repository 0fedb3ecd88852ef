"""Registered text and address expressions over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.functions import amounts, arrow, rules
from florilege.functions import text as X
from florilege.functions import urls as U
from florilege.plans.registry import Tables, query

NORM = r"trim(regexp_replace(strip_accents(replace(lower({}), 'ł', 'l')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'))"


def norm_sql(column: str) -> str:
    return NORM.format(column)


def stems_sql(column: str, size: int = 6) -> str:
    return f"list_distinct(list_transform(list_filter(string_split({norm_sql(column)}, ' '), lambda w: length(w) > 3), lambda w: w[1:{size}]))"


def jaccard_sql(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"


PAIRS_SQL = "(SELECT a.conv_id, a.turn, a.role, a.text AS before, b.text AS after FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"


def turn_pairs(t: Tables):
    a = t.conversations.select("conv_id", "turn", "role", F.col("text").alias("before"))
    b = t.conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("after"))
    return a.join(b, ["conv_id", "turn"])


@query("norm_text", f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents")
def norm_text(t: Tables):
    return t.documents.select("doc_id", X.norm_text(F.col("text")).alias("norm"))


@query("norm_text_exact", f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents")
def norm_text_exact(t: Tables):
    return t.documents.select("doc_id", arrow.norm_text_exact(F.col("text")).alias("norm"))


@query(
    "fingerprints",
    f"""SELECT doc_id, substr(sha1(source || '|' || array_to_string(list_sort({stems_sql('text')}), ' ')), 1, 16) AS fingerprint, substr(sha1({norm_sql('text')}), 1, 16) AS para_hash FROM documents""",
)
def fingerprints(t: Tables):
    return t.documents.select("doc_id", X.fingerprint(F.col("source"), F.col("text")).alias("fingerprint"), X.text_hash(F.col("text")).alias("para_hash"))


@query(
    "stem_jaccard",
    f"SELECT conv_id, turn, round({jaccard_sql('a', 'b')}, 6) AS similarity FROM (SELECT conv_id, turn, {stems_sql('before')} AS a, {stems_sql('after')} AS b FROM {PAIRS_SQL})",
)
def stem_jaccard(t: Tables):
    return turn_pairs(t).select("conv_id", "turn", F.round(X.stem_similarity(F.col("before"), F.col("after")), 6).alias("similarity"))


def tokens_sql(column: str) -> str:
    stop = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(rules.TITLE_STOP)) + "]"
    words = f"list_filter(regexp_extract_all(strip_accents(lower({column})), '[a-z]+'), lambda w: length(w) > 2 AND NOT list_contains({stop}, w))"
    return f"list_sort(list_distinct(list_transform({words}, lambda w: CASE WHEN length(w) > 4 THEN rtrim(w, 's') ELSE w END)))"


def polish_tokens_sql(column: str) -> str:
    stop = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(rules.POLISH_STOP)) + "]"
    words = f"list_filter(regexp_extract_all(strip_accents(replace(lower({column}), 'ł', 'l')), '[a-z]+'), lambda w: length(w) > 2 AND NOT list_contains({stop}, w))"
    return f"list_sort(list_distinct(list_transform({words}, lambda w: w[1:least(4, length(w) - 1)])))"


@query(
    "tokens",
    f"SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS title_tokens, array_to_string({polish_tokens_sql('text')}, ' ') AS polish_tokens FROM documents",
)
def tokens(t: Tables):
    return t.documents.select(
        "doc_id",
        F.array_join(F.array_sort(X.title_tokens(F.col("text"))), " ").alias("title_tokens"),
        F.array_join(F.array_sort(X.polish_tokens(F.col("text"))), " ").alias("polish_tokens"),
    )


PART_WORDS = ["liście", "młode pędy", "korzeń suszony", "cała roślina", "kora", "świeży sok", "null", "toksyczność"]


@query(
    "norm_part",
    """SELECT p_partkey, CASE WHEN p_partkey % 8 = 0 THEN 'liście' WHEN p_partkey % 8 = 1 THEN 'ziele' WHEN p_partkey % 8 = 2 THEN 'korzeń' WHEN p_partkey % 8 = 4 THEN 'kora' WHEN p_partkey % 8 = 5 THEN 'sok' END AS part FROM part""",
)
def norm_part(t: Tables):
    raw = F.element_at(F.array(*[F.lit(w) for w in PART_WORDS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return t.part.select("p_partkey", X.norm_part(raw).alias("part"))


@query("slugify", "SELECT p_partkey, regexp_replace(lower(p_name || p_brand), '[^a-z0-9]+', '_', 'g') AS slug FROM part")
def slugify(t: Tables):
    return t.part.select("p_partkey", X.slugify(F.concat("p_name", F.lit(""), "p_brand")).alias("slug"))


@query(
    "normalize_url",
    r"""WITH u AS (SELECT page_id, url, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS s, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS p,
    list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: regexp_matches(x, '^[^=]+=.+') AND NOT regexp_matches(x, '(?i)^(utm_|fbclid|gclid|mc_|ref|share|replytocom|amp)')) AS q FROM pages)
    SELECT page_id, CASE WHEN s IN ('http', 'https') AND h <> '' THEN s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS normal, regexp_replace(h, '^www\.', '') AS site FROM u""",
)
def normalize_url(t: Tables):
    return t.pages.select("page_id", U.normalize_url(F.col("url")).alias("normal"), U.site_key(F.col("url")).alias("site"))


@query(
    "registrable_domain",
    r"""SELECT page_id, array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') AS domain FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS h FROM pages)""",
)
def registrable_domain(t: Tables):
    return t.pages.select("page_id", U.registrable_domain(F.col("url")).alias("domain"))


PATTERN_SQL = r"""(SELECT page_id, CASE WHEN c = '' THEN '/' ELSE '/' || array_to_string(list_transform(string_split(lower(c), '/'), lambda s, i: CASE WHEN regexp_full_match(s, '[0-9]+') THEN '{n}'
    WHEN regexp_full_match(s, '[\p{L}\p{N}_-]*[0-9]{3,}[\p{L}\p{N}_-]*') OR length(s) > 40 THEN '{id}'
    WHEN length(s) - length(replace(replace(s, '-', ''), '_', '')) >= 2 OR (length(s) - length(replace(replace(s, '-', ''), '_', '')) >= 1 AND i = len(string_split(c, '/'))) THEN '{slug}' ELSE s END), '/') END AS pattern
    FROM (SELECT page_id, trim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/') AS c FROM pages))"""


@query("url_pattern", f"SELECT page_id, pattern FROM {PATTERN_SQL}")
def url_pattern(t: Tables):
    return t.pages.select("page_id", U.url_pattern(F.col("url")).alias("pattern"))


TOKENS_SQL = r"""(SELECT page_id, list_concat(list_filter(regexp_split_to_array(lower(p), '[^\p{L}\p{N}]+'), lambda w: length(w) >= 3 AND NOT regexp_full_match(w, '[0-9]+')),
    list_concat(CASE WHEN regexp_extract(url, '\?([^#]*)', 1) <> '' THEN ['?query'] ELSE [] END, ['#depth' || least(4, len(string_split(trim(p, '/'), '/')))])) AS tokens
    FROM (SELECT page_id, url, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS p FROM pages))"""


@query("url_tokens", f"SELECT page_id, array_to_string(tokens, ' ') AS tokens FROM {TOKENS_SQL}")
def url_tokens(t: Tables):
    return t.pages.select("page_id", F.array_join(U.url_tokens(F.col("url")), " ").alias("tokens"))


@query(
    "keyword_score",
    r"""SELECT page_id, least(1.0, (CASE WHEN contains(p, 'en') THEN 1 ELSE 0 END + CASE WHEN contains(p, '/7') THEN 1 ELSE 0 END + CASE WHEN contains(p, 'html') THEN 1 ELSE 0 END) / 2) AS score
    FROM (SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)) AS p FROM pages)""",
)
def keyword_score(t: Tables):
    return t.pages.select("page_id", U.keyword_score(F.col("url"), F.lit(""), ["en", "/7", "html"]).alias("score"))


STEMS = ["the", "=token", "ciez", "=ring", "ver", "étr"]


@query(
    "purpose_scores",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_''’]+') AS w FROM documents), h AS (SELECT doc_id, len(list_filter(w, lambda x: list_contains(['token', 'ring'], x) OR list_contains(['token', 'ring'], rtrim(x, 's'))
    OR list_contains(['token', 'ring'], regexp_replace(rtrim(x, 's'), 'e$', '')) OR regexp_matches(x, '^(the|ciez|ver|étr)'))) AS purpose, len(list_filter(w, lambda x: regexp_matches(x, '^(an|un)'))) AS culinary FROM w)
    SELECT *, (culinary >= 3 AND culinary >= 3 * greatest(purpose, 1)) OR (purpose = 0 AND culinary >= 2) AS is_culinary FROM h""",
)
def purpose_scores(t: Tables):
    w = X.plain_words(F.col("text"))
    h = t.documents.select("doc_id", X.hits(w, STEMS).alias("purpose"), X.hits(w, ["an", "un"]).alias("culinary"))
    return h.withColumn("is_culinary", X.is_culinary(F.col("purpose"), F.col("culinary")))


@query(
    "topic_scores",
    r"""SELECT doc_id, round(least(1.0, len(list_filter(regexp_split_to_array(lower(substr(text, 1, 6000)), '[^\p{L}\p{N}_]+'), lambda w: regexp_matches(w, '^(the|la|un|ver)'))) / 15), 3) AS topic FROM documents""",
)
def topic_scores(t: Tables):
    return t.documents.select("doc_id", X.topic_score(F.lit(""), F.col("text"), ["the", "la", "un", "ver"]).alias("topic"))


@query("numbers_in_text")
def numbers_in_text(t: Tables):
    return t.documents.select("doc_id", F.array_join(F.transform(amounts.numbers(F.col("text")), lambda x: x.cast("string")), " ").alias("numbers"))


@query("number_check")
def number_check(t: Tables):
    """Numbers added and lost between two texts, with a small tolerance."""
    n = turn_pairs(t).select("conv_id", "turn", amounts.numbers(F.col("before")).alias("a"), amounts.numbers(F.col("after")).alias("b"))

    def missing(mine: str, other: str):
        near = F.filter(mine, lambda x: ~F.exists(other, lambda y: F.abs(x - y) < 0.011))
        whole = F.filter(near, lambda x: ~F.exists(mine, lambda y: (y != x) & (F.least(x, y) < 1) & F.exists(other, lambda z: F.abs(x + y - z) < 0.011)))
        return F.size(whole)

    return n.select("conv_id", "turn", missing("b", "a").alias("added"), missing("a", "b").alias("lost"))


@query(
    "segment_check",
    f"""WITH p AS (SELECT conv_id, turn, before AS a, after AS b, length(after) / length(before) AS r FROM {PAIRS_SQL}), q AS (SELECT *, string_split(lower(trim(b)), ' ') AS w FROM p),
    f AS (SELECT conv_id, turn, len(list_filter(range(1, len(w2) - 2), lambda i: w2[i] = w2[i + 1] AND w2[i] = w2[i + 2] AND w2[i] = w2[i + 3])) > 0
    OR len(list_filter(list_distinct(s), lambda x: len(list_filter(s, lambda y: y = x)) >= 3)) > 0 AS loop, length(a) >= 40 AS long, r, trim(a) AS a, trim(b) AS b
    FROM (SELECT *, regexp_split_to_array(lower(trim(b)), '\\s+') AS w2, list_filter(list_transform(regexp_split_to_array(lower(b), '[.!?]+'), lambda s: trim(s, ' ' || chr(10))), lambda s: length(s) > 8) AS s FROM q))
    SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN loop THEN 'loop' END, CASE WHEN long AND r < 0.3 THEN 'cut_short' WHEN long AND r > 3 THEN 'too_long' WHEN long AND (r < 0.5 OR r > 2.2) THEN 'warn:length' END], lambda x: x IS NOT NULL), ',') AS problems FROM f""",
)
def segment_check(t: Tables):
    return turn_pairs(t).select("conv_id", "turn", F.array_join(X.segment_problems(F.col("before"), F.col("after"), F.lit("en")), ",").alias("problems"))


@query("report_rollup")
def report_rollup(t: Tables):
    """Errors and warnings per conversation over all its segments."""
    rows = turn_pairs(t).select("conv_id", "turn", X.segment_problems(F.col("before"), F.col("after"), F.lit("en")).alias("problems"))
    codes = rows.select("conv_id", F.explode("problems").alias("code")).groupBy("conv_id", "code").agg(F.count("*").alias("n"))
    listed = codes.groupBy("conv_id").agg(F.array_sort(F.collect_list("code")).alias("codes"), F.sum("n").alias("problems"))  # a fixed list of codes
    return listed.select("conv_id", "problems", X.report_summary(F.col("codes")).alias("summary"))


@query(
    "support_checks",
    f"""WITH p AS (SELECT conv_id, turn, before, after, list_distinct(regexp_extract_all(before, '[0-9]+([.,][0-9]+)?')) AS n, ' ' || {norm_sql('after')} || ' ' AS s, string_split({norm_sql('before')}, ' ') AS w FROM {PAIRS_SQL}),
    l AS (SELECT *, list_filter(w, lambda x: regexp_full_match(x, '[ivxlcdm]+|[0-9]+')) AS nums, list_filter(w, lambda x: length(x) >= 4 AND NOT regexp_full_match(x, '[ivxlcdm]+|[0-9]+')) AS ws FROM p)
    SELECT conv_id, turn, len(list_filter(n, lambda x: NOT contains(replace(after, ',', '.'), replace(x, ',', '.')))) = 0 AS numbers_ok,
    len(list_filter(nums, lambda x: NOT contains(s, x))) = 0 AND CASE WHEN len(ws) = 0 THEN len(nums) > 0 ELSE len(list_filter(ws, lambda x: contains(s, ' ' || x[1:5]))) * 2 >= len(ws) END AS label_ok FROM l""",
)
def support_checks(t: Tables):
    return turn_pairs(t).select(
        "conv_id", "turn", X.numbers_supported(F.col("before"), F.col("after")).alias("numbers_ok"), X.supported_label(F.col("before"), F.col("after")).alias("label_ok")
    )


@query(
    "faithfulness",
    f"""WITH p AS (SELECT conv_id, turn, before, after, {stems_sql('after', 5)} AS ns, {stems_sql('before', 5)} AS os, list_distinct(regexp_extract_all(after, '[0-9]+([.,][0-9]+)?')) AS n FROM {PAIRS_SQL})
    SELECT conv_id, turn, len(list_filter(n, lambda x: NOT contains(replace(before, ',', '.'), replace(x, ',', '.')))) = 0 AND len(list_filter(ns, lambda x: NOT list_contains(os, x))) <= greatest(1.0, 0.4 * len(ns)) AS faithful,
    round(CASE WHEN len(os) = 0 THEN 1 ELSE len(list_intersect(os, ns)) / len(os) END, 6) AS kept FROM p""",
)
def faithfulness(t: Tables):
    return turn_pairs(t).select(
        "conv_id", "turn", X.faithful(F.col("after"), F.col("before")).alias("faithful"), F.round(X.stem_cover(F.col("before"), F.col("after")), 6).alias("kept")
    )


@query("metric_units")
def metric_units(t: Tables):
    line = F.concat((F.col("l_quantity").cast("int")).cast("string"), F.lit(" cups water, bake at "), (F.col("l_quantity").cast("int") + 300).cast("string"), F.lit("°F"))
    distinct = t.lineitem.select("l_quantity", line.alias("line")).groupBy("l_quantity", "line").agg(F.count("*").alias("n"))
    return distinct.select("l_quantity", "n", amounts.metric_units(F.col("line")).alias("metric"))


@query(
    "split_quantity",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS INT) AS VARCHAR) || ' ml' AS quantity, p_name AS name FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
def split_quantity(t: Tables):
    line = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" ml "), "p_name", F.lit(", "))
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", X.split_quantity(line).alias("q")).select("l_orderkey", "l_linenumber", "l_partkey", "q.quantity", "q.name")


@query(
    "iso_duration",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_quantity AS INT) + 24 * CAST(l_discount * 100 AS INT) AS VARCHAR) || ' godz.' || CASE WHEN round(l_tax * 100) > 0 THEN ' ' || CAST(CAST(round(l_tax * 100) AS INT) AS VARCHAR) || ' min' ELSE '' END AS spoken FROM lineitem""",
)
def iso_duration(t: Tables):
    days = F.round(F.col("l_discount") * 100).cast("int").cast("string")
    value = F.concat(F.lit("P"), days, F.lit("DT"), F.col("l_quantity").cast("int").cast("string"), F.lit("H"), F.round(F.col("l_tax") * 100).cast("int").cast("string"), F.lit("M"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", X.iso_duration(value).alias("spoken"))


@query(
    "type_rules",
    """SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'tion') THEN 'tincture' WHEN regexp_matches(lower(text), 'ung') THEN 'ointment' WHEN regexp_matches(lower(text), 'eau|ción') THEN 'bath' ELSE 'other' END AS kind FROM documents""",
)
def type_rules(t: Tables):
    return t.documents.select("doc_id", X.first_rule(F.lower("text"), [("tion", "tincture"), ("ung", "ointment"), ("eau|ción", "bath")], "other").alias("kind"))


@query(
    "json_path_tools",
    """SELECT event_id, regexp_extract(props, '[0-9]+', 0) AS value, regexp_extract(props, '[0-9]+', 0) <> '0' AND props IS NOT NULL AS is_filled FROM events""",
)
def json_path_tools(t: Tables):
    doc = F.try_parse_json("props")
    value = F.try_variant_get(doc, "$.k", "string")
    return t.events.select("event_id", value.alias("value"), (X.filled(value) & (value != "0")).alias("is_filled"))


@query(
    "profile_text_parse",
    """WITH p AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'lekko gorzki, słodki' WHEN p_size % 3 = 1 THEN 'nieco ostry' ELSE 'neutralny' END AS note, CASE WHEN p_size % 2 = 0 THEN 'ciepły' ELSE 'zimny, gorący' END AS warm FROM part)
    SELECT p_partkey, CASE WHEN note LIKE 'lekko%' THEN 'słodki' WHEN note LIKE 'nieco%' THEN 'ostry' END AS taste, CASE WHEN warm = 'ciepły' THEN 'warm' END AS heat, CASE WHEN p_partkey % 2 = 0 THEN 'słodki' ELSE 'gorzki' END AS picked FROM p""",
)
def profile_text_parse(t: Tables):
    from florilege.functions.profile import axis, pick_segment, taste

    note = F.when(F.col("p_size") % 3 == 0, "lekko gorzki, słodki").when(F.col("p_size") % 3 == 1, "nieco ostry").otherwise("neutralny")
    warm = F.when(F.col("p_size") % 2 == 0, "ciepły").otherwise("zimny, gorący")
    part = F.when(F.col("p_partkey") % 2 == 0, "sok").otherwise("liście")
    text = F.concat(F.lit("Słodki (sok), gorzki (liście, pąki)"), F.lit(""))
    return t.part.select("p_partkey", taste(note).alias("taste"), axis(warm, "warm", "cold").alias("heat"), F.lower(pick_segment(text, part)).alias("picked"))


@query(
    "text_metrics",
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS w, list_filter(regexp_extract_all(replace(text, chr(10), ' '), '[^.!?…]+[.!?…]*'), lambda s: regexp_matches(s, '\p{L}')) AS s,
    len(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda p: trim(p) <> '')) AS paragraphs FROM documents),
    m AS (SELECT doc_id, len(w) AS words, len(s) AS sentences, paragraphs, coalesce(list_max(list_transform(s, lambda x: len(regexp_extract_all(x, '\p{L}+')))), 0) AS longest_sentence,
    round(len(list_distinct(w)) / greatest(len(w), 1), 2) AS ttr, 0.4 * (greatest(len(w), 1) / greatest(len(s), 1) + 100.0 * len(list_filter(w, lambda x: len(regexp_extract_all(x, '(?i)[aeiouyąęóäöüéèêàáíúâîô]+')) >= 4)) / greatest(len(w), 1)) AS f FROM w)
    SELECT doc_id, words, sentences, paragraphs, longest_sentence, CASE WHEN words < 120 THEN greatest(0, 100 - (120 - words) * 2) WHEN words > 200 THEN greatest(0, 100 - (words - 200) * 2) ELSE 100 END AS length_score, round(f, 1) > 11 AS hard FROM m""",
)
def text_metrics(t: Tables):
    m = t.documents.select("doc_id", X.text_metrics(F.col("text")).alias("m"))
    return m.select("doc_id", "m.words", "m.sentences", "m.paragraphs", "m.longest_sentence", F.col("m.length_score").cast("long").alias("length_score"), (F.col("m.fog") > 11).alias("hard"))


@query("repeated_words", r"""SELECT doc_id, w AS word FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{L}+')) AS w FROM documents) WHERE length(w) > 3 GROUP BY doc_id, w HAVING count(*) >= 3""")
def repeated_words(t: Tables):
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)[^\W\d_]+"), F.lit(0))
    return t.documents.select("doc_id", F.explode(X.repeated_words(w)).alias("word"))


@query(
    "idea_scores",
    r"""WITH s AS (SELECT doc_id, quality, least(100, CASE WHEN lang <> 'pl' THEN 25 ELSE 0 END + CASE source WHEN 'src1' THEN 25 WHEN 'src2' THEN 20 ELSE 10 END + CASE WHEN regexp_matches(text, '[0-9]') THEN 8 ELSE 0 END
    + CASE WHEN n_chars BETWEEN 60 AND 350 THEN 15 ELSE 5 END) AS rule FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, CAST(rule AS DOUBLE) AS rule, round(CASE WHEN quality IS NULL THEN 0.8 * rule ELSE 0.4 * rule + 60.0 * quality END, 1) AS final FROM s""",
)
def idea_scores(t: Tables):
    rows = t.documents.join(t.labels, "doc_id", "left")
    kind = F.when(F.col("source") == "src1", 25).when(F.col("source") == "src2", 20).otherwise(10)
    rule = (
        F.when(~F.lower("lang").startswith("pl"), 25).otherwise(0) + kind + F.when(F.col("text").rlike(r"[0-9]"), 8).otherwise(0)
        + F.when(F.length("text").between(60, 350), 15).otherwise(5)
    )
    rule = F.least(F.lit(100.0), rule.cast("double"))
    final = F.when(F.col("quality").isNull(), 0.8 * rule).otherwise(0.4 * rule + 0.6 * 100 * F.col("quality"))
    return rows.select("doc_id", rule.alias("rule"), F.round(final, 1).alias("final"))


@query(
    "weighted_verdict",
    """WITH s AS (SELECT doc_id, 1 + doc_id % 10 AS facts, 1 + n_chars % 10 AS style, 1 + (doc_id + n_chars) % 10 AS safety, coalesce(quality, 1) AS q, n_chars % 3 AS n, n_chars % 7 = 0 AS strange FROM documents LEFT JOIN labels USING (doc_id)),
    e AS (SELECT *, round(((facts - 1) / 9 * 100 * 3 + (style - 1) / 9 * 100 * 2 + (safety - 1) / 9 * 100 * 1) / 6, 1) AS score FROM s),
    r AS (SELECT *, greatest(own, CASE WHEN q = 0 THEN 2 ELSE 0 END) AS rank FROM (SELECT *, greatest(CASE WHEN score >= 72 THEN 0 WHEN score >= 45 THEN 1 ELSE 2 END, CASE WHEN least(facts, safety) <= 2 THEN 2 WHEN least(facts, safety) <= 4 THEN 1 ELSE 0 END, CASE WHEN n > 0 OR strange THEN 1 ELSE 0 END) AS own FROM e))
    SELECT doc_id, score, ['publish', 'improve', 'reject'][rank + 1] AS verdict, array_to_string(list_filter([CASE WHEN score < 72 THEN 'score ' || CAST(round_even(score, 0) AS INT) || '/100' END, CASE WHEN facts <= 4 THEN 'facts: ' || facts || '/10' END,
    CASE WHEN safety <= 4 THEN 'safety: ' || safety || '/10' END, CASE WHEN n > 0 THEN 'errors: ' || n END, CASE WHEN strange THEN 'numbers not in the data' END, CASE WHEN q = 0 AND own < 2 THEN 'reviewer: reject' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM r""",
)
def weighted_verdict(t: Tables):
    from florilege.functions.scoring import expert_score, stricter_verdict, verdict_reasons

    rows = t.documents.join(t.labels, "doc_id", "left").withColumn(
        "scores",
        F.create_map(F.lit("facts"), 1 + F.col("doc_id") % 10, F.lit("style"), 1 + F.col("n_chars") % 10, F.lit("safety"), 1 + (F.col("doc_id") + F.col("n_chars")) % 10),
    )
    rows = rows.withColumn("score", expert_score(F.col("scores"), {"facts": 3, "style": 2, "safety": 1}))
    model = F.when(F.col("quality") == 0, "reject")
    given = (F.col("score"), F.col("scores"), ["facts", "safety"], model, F.col("n_chars") % 7 == 0, F.col("n_chars") % 3)
    return rows.select("doc_id", "score", stricter_verdict(*given).alias("verdict"), F.array_join(verdict_reasons(*given), "; ").alias("reasons"))


@query("line_diff_counts")
def line_diff_counts(t: Tables):
    """Lines that join and go around the longest common subsequence; a moved line counts on both sides."""
    from florilege.operators.versions import line_changes

    return line_changes(turn_pairs(t), ["conv_id", "turn"], "before", "after")


@query(
    "line_multiset_counts",
    f"""WITH l AS (SELECT conv_id, turn, unnest(string_split(before, chr(10))) AS line, 1 AS a, 0 AS b FROM {PAIRS_SQL} UNION ALL SELECT conv_id, turn, unnest(string_split(after, chr(10))), 0, 1 FROM {PAIRS_SQL}),
    g AS (SELECT conv_id, turn, line, sum(a) AS a, sum(b) AS b FROM l GROUP BY ALL) SELECT conv_id, turn, CAST(sum(greatest(b - a, 0)) AS BIGINT) AS added, CAST(sum(greatest(a - b, 0)) AS BIGINT) AS removed FROM g GROUP BY ALL""",
)
def line_multiset_counts(t: Tables):
    """Lines that one side has more often than the other, wherever they stand."""
    from florilege.operators.versions import line_surplus

    return line_surplus(turn_pairs(t), ["conv_id", "turn"], "before", "after")


@query("focus_windows")
def focus_windows(t: Tables):
    return t.documents.select("doc_id", F.length(X.focus_windows(F.col("text"), ["hand", "eau"], window=200, limit=1000)).alias("chars"))


@query(
    "sentence_split",
    r"""SELECT doc_id, len(list_filter(list_transform(string_split(regexp_replace(trim(text, ' ' || chr(10)), '([.!?])\s+([A-ZĄĆĘŁŃÓŚŹŻ0-9"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')) AS sentences FROM documents""",
)
def sentence_split(t: Tables):
    return t.documents.select("doc_id", F.size(X.sentences(F.col("text"))).alias("sentences"))


@query("paragraph_split")
def paragraph_split(t: Tables):
    p = t.documents.select("doc_id", X.paragraphs(F.col("text")).alias("p"))
    return p.select("doc_id", F.size("p").alias("paragraphs"), F.coalesce(F.array_max(F.transform("p", lambda x: F.length(x))), F.lit(0)).alias("longest"))


@query(
    "name_phrase",
    r"""SELECT p_partkey, regexp_replace(p_name, 'x', 'x') AS phrase, p_name AS clean FROM part""",
)
def name_phrase(t: Tables):
    raw = F.concat(F.lit("2 łyżki suszonych kwiatów "), "p_name", F.lit(" (do smaku)"))
    phrase = F.replace(X.name_phrase(raw), F.lit(" smaku"), F.lit(""))
    clean = X.clean_name(F.concat(F.lit("2 łyżki "), "p_name", F.lit(" (świeży), 10 g.")))
    return t.part.select("p_partkey", phrase.alias("phrase"), clean.alias("clean"))


@query(
    "error_signature",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'bad value N.N in N' END AS signature FROM events""",
)
def error_signature(t: Tables):
    log = F.concat(F.lit("start\nFAULT: old 7\n"), F.when(F.col("event_type") == "error", F.concat(F.lit("FAULT: bad value "), F.format_string("%.2f", "value"), F.lit(" in "), F.col("user_id").cast("string"))).otherwise("done"))
    log = F.when(F.col("event_type") == "error", log).otherwise("start\ndone")
    return t.events.select("event_id", X.error_signature(log, "FAULT:").alias("signature"))


@query(
    "lang_functions",
    """SELECT doc_id, lang AS lang2, CASE WHEN doc_id % 2 = 0 THEN lang <> 'pl' ELSE regexp_matches(text, '[Ѐ-ӿ]') END AS is_foreign, CASE WHEN doc_id % 3 = 0 THEN lang END AS wiki FROM documents""".replace("\\u0400-\\u04FF", "Ѐ-ӿ"),
)
def lang_functions(t: Tables):
    from florilege.functions.lang import is_foreign, lang2, wiki_lang_of

    code = F.concat(F.upper("lang"), F.lit("_XX"))
    url = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://"), "lang", F.lit(".wikipedia.org/wiki/X"))).otherwise("https://example.org/wiki/X")
    return t.documents.select("doc_id", lang2(code).alias("lang2"), is_foreign(F.when(F.col("doc_id") % 2 == 0, code), F.col("text")).alias("is_foreign"), wiki_lang_of(url).alias("wiki"))


@query(
    "label_maps",
    """SELECT p_partkey, p_brand || ' hans' AS zh, p_name AS en, CASE WHEN p_size > 20 THEN p_type END AS de FROM part""",
)
def label_maps(t: Tables):
    from florilege.functions.lang import labels_by_lang

    labels = F.create_map(
        F.lit("zh"), F.col("p_brand"), F.lit("zh-cn"), F.concat("p_brand", F.lit(" cn")), F.lit("zh-hans"), F.concat("p_brand", F.lit(" hans")),
        F.lit("en"), F.col("p_name"), F.lit("de"), F.when(F.col("p_size") > 20, F.col("p_type")).otherwise(""),
    )
    m = t.part.select("p_partkey", labels_by_lang(labels).alias("m"))
    return m.select("p_partkey", *[F.try_element_at("m", F.lit(x)).alias(x) for x in ("zh", "en", "de")])


@query(
    "engagement",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax > 0.04 OR l_discount > 0.05 OR l_quantity > 25 THEN coalesce(CASE WHEN l_quantity > 25 THEN l_quantity END, 0) + 2 * coalesce(CASE WHEN l_tax > 0.04 THEN l_linenumber END, 0)
    + 3 * coalesce(CASE WHEN l_discount > 0.05 THEN l_suppkey END, 0) END AS engagement FROM lineitem""",
)
def engagement(t: Tables):
    from florilege.functions.scoring import engagement as weighted

    value = weighted(F.when(F.col("l_quantity") > 25, F.col("l_quantity")), F.when(F.col("l_tax") > 0.04, F.col("l_linenumber")), F.when(F.col("l_discount") > 0.05, F.col("l_suppkey")))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", value.alias("engagement"))


@query(
    "season_phase",
    """SELECT o_orderkey, CASE WHEN day(o_orderdate) <= 10 THEN 'początek' WHEN day(o_orderdate) <= 20 THEN 'połowa' ELSE 'koniec' END AS phase,
    ['zima', 'zima', 'przedwiośnie', 'wiosna', 'wiosna', 'lato', 'lato', 'lato', 'jesień', 'jesień', 'późna jesień', 'zima'][month(o_orderdate)] AS season,
    CASE WHEN (month(o_orderdate) = 12 AND day(o_orderdate) BETWEEN 17 AND 27) THEN true ELSE false END AS near_christmas, (month(o_orderdate) = 1 AND day(o_orderdate) <= 9) OR (month(o_orderdate) = 12 AND day(o_orderdate) >= 30) AS near_kings FROM orders""",
)
def season_phase(t: Tables):
    from florilege.functions.dates import folk_days_near, phase, season

    day = F.to_date("o_orderdate")
    rows = t.orders.select("o_orderkey", phase(day).alias("phase"), season(day).alias("season"), folk_days_near(day).alias("folk"))
    return rows.select("o_orderkey", "phase", "season", F.exists("folk", lambda x: x.startswith("Wigilia")).alias("near_christmas"), F.exists("folk", lambda x: x.startswith("Trzech Króli")).alias("near_kings"))


@query(
    "token_estimate",
    """SELECT conv_id, turn, greatest(1, length(text) // 4) AS tokens, CASE role WHEN 'user' THEN 'wiedza' WHEN 'assistant' THEN 'marketing' ELSE 'inne' END AS purpose FROM conversations""",
)
def token_estimate(t: Tables):
    from florilege.functions.scoring import purpose_of, token_estimate as estimate

    system = F.when(F.col("role") == "user", "Ty WSKAZUJESZ fragmenty tekstu").when(F.col("role") == "assistant", "Napisz post na Facebook").otherwise("hello")
    return t.conversations.select("conv_id", "turn", estimate(F.col("text")).alias("tokens"), purpose_of(system).alias("purpose"))


@query(
    "metadata_clean",
    """SELECT event_id, event_type AS kind, CASE WHEN user_id % 4 <> 0 THEN 'c' || user_id END AS country, user_id % 2 = 0 AS toxic FROM events""",
)
def metadata_clean(t: Tables):
    from florilege.functions.json_fields import clean_meta

    raw = F.to_json(F.struct(
        F.concat(F.lit("  "), "event_type", F.lit(" ")).alias("rodzaj"), F.when(F.col("user_id") % 4 == 0, F.lit("<b>")).otherwise(F.concat(F.lit("c"), F.col("user_id").cast("string"))).alias("kraj"),
        (F.col("user_id") % 2 == 0).alias("toksyczne"), F.lit("x").alias("obce"),
    ))
    m = t.events.select("event_id", clean_meta(raw).alias("m"))
    return m.select("event_id", F.col("m.rodzaj").alias("kind"), F.col("m.kraj").alias("country"), F.col("m.toksyczne").alias("toxic"))


@query(
    "query_text",
    """SELECT p_partkey, array_to_string(CASE WHEN p_size % 2 = 0 THEN [p_name || ' recipe', p_brand || ' recipe'] ELSE [p_name || ' recipe'] END, '|') AS queries FROM part""",
)
def query_text(t: Tables):
    phrases = F.array(
        F.concat("p_name", F.lit(" recipe")), F.when(F.col("p_size") % 2 == 0, F.concat("p_brand", F.lit(" recipe"))), F.concat("p_name", F.lit(" recipe")), F.lit(None).cast("string"),
    )
    return t.part.select("p_partkey", F.array_join(F.slice(F.array_distinct(F.array_compact(phrases)), 1, 4), "|").alias("queries"))


@query(
    "limit_text_parse",
    """SELECT event_id, CASE user_id % 3 WHEN 0 THEN 34.0 WHEN 1 THEN 60.0 * (user_id % 7) + 1.5 END AS retry_seconds, CASE WHEN user_id % 3 = 2 THEN 'quota' ELSE 'minute' END AS kind FROM events""",
)
def limit_text_parse(t: Tables):
    from florilege.functions.scoring import limit_kind, retry_seconds

    text = (
        F.when(F.col("user_id") % 3 == 0, F.lit('"retryDelay": "34s" limit per minute'))
        .when(F.col("user_id") % 3 == 1, F.concat(F.lit("Rate limit. Please try again in "), (F.col("user_id") % 7).cast("string"), F.lit("m1.5s per minute")))
        .otherwise("tokens per day (TPD) exceeded")
    )
    return t.events.select("event_id", retry_seconds(text).alias("retry_seconds"), limit_kind(text).alias("kind"))


@query(
    "answer_json_clean",
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN role WHEN 1 THEN role END AS role_read, turn % 4 IN (0, 1) AS usable, CASE WHEN turn % 4 = 1 THEN 1 ELSE 0 END AS more FROM conversations""",
)
def answer_json_clean(t: Tables):
    from florilege.functions.json_fields import answer_object

    one = F.to_json(F.struct("role", "text"))
    raw = (
        F.when(F.col("turn") % 4 == 0, F.concat(F.lit("```json\n"), one, F.lit("\n```")))
        .when(F.col("turn") % 4 == 1, F.concat(F.lit("["), one, F.lit(","), one, F.lit("]")))
        .when(F.col("turn") % 4 == 2, F.lit('{"error": "x", "code": 5}'))
        .otherwise("no json {")
    )
    a = t.conversations.select("conv_id", "turn", answer_object(raw).alias("a"))
    return a.select("conv_id", "turn", F.try_variant_get("a.first", "$.role", "string").alias("role_read"), F.col("a.first").isNotNull().alias("usable"), F.col("a.more").alias("more"))


@query(
    "media_name_parse",
    r"""SELECT page_id, 'File:' || upper(substr(h, 1, 1)) || substr(h, 2) || ' x.jpg' AS title, regexp_extract(html, '<title>([^<]*)</title>', 1) <> '' AS has_title FROM (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS h FROM pages)""",
)
def media_name_parse(t: Tables):
    return t.pages.select("page_id", U.media_title(F.concat(F.lit("Plik:"), U.netloc(F.col("url")), F.lit("_x.jpg"))).alias("title"), (F.regexp_extract("html", "<title>([^<]*)</title>", 1) != "").alias("has_title"))


@query(
    "review_notes",
    """SELECT doc_id, array_to_string(list_concat(CASE WHEN coalesce(toxic, 0) = 1 THEN ['error: toxic'] ELSE [] END, list_transform(list_sort(list_filter([{'v': 1 + doc_id % 10, 'k': 'facts'}, {'v': 1 + n_chars % 10, 'k': 'style'}], lambda s: s.v < 8)), lambda s: s.k || ' ' || s.v)), '; ') AS notes
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def review_notes(t: Tables):
    from florilege.functions.scoring import review_notes as notes

    rows = t.documents.join(t.labels, "doc_id", "left")
    none = F.array().cast("array<string>")
    errors = F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(none)
    scores = F.create_map(F.lit("facts"), 1 + F.col("doc_id") % 10, F.lit("style"), 1 + F.col("n_chars") % 10)
    return rows.select("doc_id", F.array_join(notes(errors, none, scores, none), "; ").alias("notes"))
