"""Rebuilding nested knowledge: numbering, routes, greedy merges, placements and exports.

Points, facts and sources are rows until the last step, because an entity may own a large share of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions import rules
from florilege.functions.json_fields import strip_fences
from florilege.functions.text import fingerprint, jaccard, norm_text, short_sha, stem_cover, stems
from florilege.operators.alike import Relation, Units, all_alike, best_primary, chosen, greedy_primaries, signed, some_alike
from florilege.operators.primitives import few, newest_per_key, numbered, quantile_bucket, running, top_per_key
from florilege.session import cut_lineage, written


def number_sources(facts: DataFrame, entity: str, url: str, lang: str) -> DataFrame:
    """Distinct sources of each entity numbered from 1: encyclopedia first, Polish first, then by address."""
    wiki = F.when(F.contains(F.col(url), F.lit("wikipedia.org")), 0).otherwise(1)
    first = facts.filter(F.coalesce(url, F.lit("")) != "").groupBy(entity, url).agg(F.min(lang).alias(lang))
    keyed = cut_lineage(first.withColumns({"_w": wiki, "_p": F.when(F.col(lang) == "pl", 0).otherwise(1)}))
    order = ["_w", "_p", url]
    return numbered(keyed, [entity], [F.asc(c) for c in order], quantile_bucket(keyed, order), "nr").drop("_w", "_p")


def section_layout(facts: DataFrame, entity: str, fact: str, sections: Sequence[str], default: str) -> DataFrame:
    """Facts in page order: fixed section order, then part and first source; unknown sections fall to a default."""
    known = F.when(F.col("section").isin(*sections), F.col("section")).otherwise(default)
    place = F.array_position(F.array(*[F.lit(s) for s in sections]), known)
    rows = cut_lineage(facts.withColumn("section", known).withColumns({"_s": place, "_p": F.coalesce("part", F.lit(""))}))
    order = ["_s", "_p", "source", fact]
    return numbered(rows, [entity], [F.asc(c) for c in order], quantile_bucket(rows, order), "place").drop("_s", "_p")


def collect_points(points: DataFrame, entity: str, order: Sequence[str], bucket: Column) -> DataFrame:
    """Points with text and sources numbered per entity."""
    usable = points.filter((F.coalesce("text", F.lit("")) != "") & F.col("source").isNotNull())
    return numbered(usable, [entity], [F.asc(c) for c in order], bucket, "pid")


def default_route(section: Column, part: Column, text: Column, part_fields: dict[str, str], slots: dict[str, str], keywords: Sequence[tuple[str, str, str]]) -> Column:
    """Target slot of a point: the field of its part, else the slot of its section or of a keyword in its text.

    ``keywords`` are ``(section, pattern, slot)`` tried in order before the plain slot of the section.
    """
    field = F.coalesce(*[F.when(section == s, F.lit(f)) for s, f in part_fields.items()])
    by_part = F.when(part.isNotNull() & field.isNotNull(), F.concat(F.lit("parts."), part, F.lit("."), field))
    low = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    by_word = F.coalesce(*[F.when((section == s) & low.rlike(p), F.lit(slot)) for s, p, slot in keywords])
    plain = F.coalesce(*[F.when(section == s, F.lit(slot)) for s, slot in slots.items()])
    return F.coalesce(by_part, by_word, plain)


def route_override(points: DataFrame, point: str, routes: DataFrame, slots: Sequence[str]) -> DataFrame:
    """Suggested routes for known slots only; the rest keep the rule. Core parts keep one point at least."""
    good = routes.filter(F.col("slot").isin(*slots)).select(point, F.col("slot").alias("_s"))
    return points.join(good, point, "left").withColumn("route", F.coalesce("_s", "rule_slot")).drop("_s")


def _same_text(threshold: float) -> Callable:
    def score(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
        j = jaccard(a("s"), b("s"))
        same_quote = (a("q") != "") & (a("q") == b("q"))
        same_print = a("s") == b("s")
        hit = (a("owner") == b("owner")) & ((j >= threshold) | same_quote | same_print)
        return F.when(hit, F.when(same_quote | same_print, F.lit(1.0)).otherwise(j))

    return score


def _text_units(rows: DataFrame, owner: Sequence[str], order: str, text: str, quote: str | None, threshold: float) -> tuple[DataFrame, Units]:
    """Rows as ``(ord, unit)`` and their units of equal owner and stems."""
    said = norm_text(F.col(quote)) if quote else F.lit("")

    def marked(part: DataFrame) -> DataFrame:
        r = part.select(F.concat_ws("|", *owner).alias("owner"), F.col(order).alias("ord"), F.array_sort(stems(F.col(text))).alias("s"), said.alias("q"))
        same = F.unhex(F.sha2(F.array_join("s", " "), 256)).alias("same")
        return r.select("owner", "ord", same, F.transform("s", lambda w: F.xxhash64(w)).alias("s"), F.when(F.col("q") != "", F.sha1("q")).otherwise("").alias("q"))

    def read(ids: DataFrame) -> DataFrame:
        # the ids first: no other text is cut into stems
        some = rows.join(ids.select(F.col("unit").cast(rows.schema[order].dataType).alias(order)), order, "left_semi")
        return chosen(marked(some).withColumnRenamed("ord", "unit"), ids)

    r = cut_lineage(signed(marked(rows), ["owner", "ord", "same", "q"], ["s"]))
    unit = F.min(F.struct("ord", "q")).alias("_m")
    units = r.groupBy("owner", "same").agg(unit, F.first("s_n").alias("s_n"), F.first("s_bits").alias("s_bits"))
    units = cut_lineage(units.select("owner", "same", F.col("_m.ord").alias("unit"), F.col("_m.q").alias("q"), "s_n", "s_bits"))
    members = r.join(units.select("owner", "same", "unit"), ["owner", "same"]).select("ord", "unit")
    return members, Units(units, read, (Relation("s", threshold),), ("owner", "s", "q"), _same_text(threshold), quoted=quote is not None)


def _beside(rows: DataFrame, owner: Sequence[str], order: str, text: str, threshold: float, known: DataFrame, quote: str | None = None) -> DataFrame:
    """Rows whose text is alike none of the ``known`` ones of their owner."""
    columns = [*owner, text, *([quote] if quote else [])]
    # known texts have no number; their hash is one that does not change when they are read again
    number = -1 - F.pmod(F.xxhash64(*columns), F.lit((1 << 62) - 1))
    both = known.select(*columns, number.alias(order)).unionByName(rows.select(*columns, F.col(order).cast("long").alias(order)))
    members, units = _text_units(both, owner, order, text, quote, threshold)
    members = cut_lineage(members)
    there = members.filter("ord < 0").select("unit").distinct()
    new = members.filter("ord >= 0").select("unit").distinct()
    hit = some_alike(units, units.of(there), units.of(new), False).select(F.col("b_unit").alias("unit"))
    gone = members.filter("ord >= 0").join(hit.unionByName(there).distinct(), "unit", "left_semi").select(F.col("ord").alias(order))
    return rows.join(few(gone.distinct(), MOST_NUMBERS), order, "left_anti")


#: Most numbers that are sent to all tasks at once.
MOST_NUMBERS = 2_000_000


def dedup_texts(rows: DataFrame, owner: Sequence[str], order: str, text: str, threshold: float, quote: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """Rows a first-come pass keeps within each owner: not near-equal to a known text or to a kept earlier row.

    ``order`` is a unique number that gives the sequence; ``known`` holds owner and text of what is there already.
    """
    fresh = rows if known is None else _beside(rows, owner, order, text, threshold, known, quote)
    _, units = _text_units(fresh, owner, order, text, quote, threshold)
    kept = greedy_primaries(units).select(F.col("unit").alias(order)).filter(F.col(order).isNotNull()).distinct()
    return fresh.join(few(kept, MOST_NUMBERS), order, "left_semi")


def dedup_topk(rows: DataFrame, owner: str, order: str, text: str, k: int, threshold: float = 0.55, known: DataFrame | None = None) -> DataFrame:
    """First ``k`` rows per owner without repeats; the limit comes after the whole set is known."""
    return top_per_key(dedup_texts(rows, [owner], order, text, threshold, known=known), [owner], [F.asc(order)], k)


def merge_points(rows: DataFrame, owner: Sequence[str], order: str, text: str, threshold: float = 0.45, originals: DataFrame | None = None) -> DataFrame:
    """Each point joins the most similar sentence there or becomes one: ``(order, sentence, merged)``.

    Sentences are the ``originals`` (owner, order, text) of the place, which all stay, and points kept before; of equally
    similar ones the first. ``order`` numbers originals and points, each owner's originals before its points.
    """
    if originals is None:
        members, units = _text_units(rows, owner, order, text, None, threshold)
        best = best_primary(cut_lineage(members), units, cut_lineage(greedy_primaries(units)), "ord")
        return best.select(F.col("ord").alias(order), F.coalesce("duplicate_of", "ord").alias("sentence"), F.col("duplicate_of").isNotNull().alias("merged"))
    columns = [*owner, order, text]
    members, units = _text_units(originals.select(*columns).unionByName(rows.select(*columns)), owner, order, text, None, threshold)
    first = originals.select(F.col(order).alias("ord"))
    members = cut_lineage(members)
    there = cut_lineage(members.join(first, "ord", "left_semi").select("unit").distinct())
    open_units = cut_lineage(units.rows.join(there, "unit", "left_anti"))
    struck = some_alike(units, units.of(there), open_units, False).select(F.col("b_unit").alias("unit")).distinct()
    free = replace(units, rows=cut_lineage(open_units.join(struck, "unit", "left_anti")))
    kept = cut_lineage(there.unionByName(greedy_primaries(free)))
    best = best_primary(members, units, kept, "ord").join(first, "ord", "left_anti")
    return best.select(F.col("ord").alias(order), F.coalesce("duplicate_of", "ord").alias("sentence"), F.col("duplicate_of").isNotNull().alias("merged"))


#: Lengths of a sentence, marks of markup, shares of stems: new ones a sentence may bring, of a point it cites
#: and is told to cite, of an original that must be kept.
SENTENCE_CHARS = (3, 700)
MARKUP = r"(?i)<[a-z/!]"
NOVEL, CITES, TOLD_CITES, KEEPS = 0.4, 0.5, 0.25, 0.6


def telling(text: Column) -> Column:
    """Stems of a text but those that only link a paraphrase."""
    return F.array_except(stems(text, 5), F.array(*[F.lit(x) for x in rules.LINKING_STEMS]))


def _numbers(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)), lambda n: F.replace(n, F.lit(","), F.lit("."))))


def _unsupported(sentences: DataFrame, base: DataFrame, slot: str) -> DataFrame:
    """(slot, sentence) of sentences that are not faithful to all texts ``base`` (slot, text) of their slot together.

    Stems and numbers of a slot are distinct rows, and sentences meet them on equality, so a slot may have any number
    of texts. A number counts as there if it is part of a run of digits and points of one of them.
    """
    said = sentences.select(slot, "sentence", F.explode_outer(telling(F.col("text"))).alias("k"))
    known = base.select(slot, F.explode(telling(F.col("text"))).alias("k")).distinct().withColumn("_there", F.lit(1))
    novel = said.join(known, [slot, "k"], "left").groupBy(slot, "sentence").agg(F.count("k").alias("_n"), F.count(F.when(F.col("k").isNotNull() & F.col("_there").isNull(), 1)).alias("_new"))
    far = novel.filter(F.col("_new") > F.greatest(F.lit(1.0), NOVEL * F.col("_n"))).select(slot, "sentence")
    runs = base.select(slot, F.explode(F.regexp_extract_all(F.replace("text", F.lit(","), F.lit(".")), F.lit("[0-9.]*[0-9][0-9.]*"), F.lit(0))).alias("run")).distinct()
    # a number is met by its first three signs at any place of a run, then compared
    starts = runs.select(slot, "run", F.explode(F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("run")), lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda w: F.substring("run", i, w)))))).alias("head"))
    asked = sentences.select(slot, "sentence", F.explode(_numbers(F.col("text"))).alias("n")).withColumn("head", F.left("n", F.lit(3)))
    found = asked.join(starts, [slot, "head"]).filter(F.col("run").contains(F.col("n"))).select(slot, "sentence", "n").distinct()
    strange = asked.join(found, [slot, "sentence", "n"], "left_anti").select(slot, "sentence")
    return far.unionByName(strange).distinct()


def apply_merge_answers(answers: DataFrame, originals: DataFrame, points: DataFrame, slot: str) -> tuple[DataFrame, DataFrame]:
    """A model's merged text repaired: rows ``(slot, place, kind, text, cited)``, and one row per slot.

    ``answers`` hold ``(slot, answer)``, JSON ``{"zdania": [{"tekst", "z"}], "nie_pasuje": [...]}``; ``originals`` ``(slot, unit,
    text)``; ``points`` ``(slot, point, text)``, numbered from 1 within the slot. A sentence with new stems or
    numbers, markup or an odd length goes. A sentence cites the points it is told to and shares stems with, and those it
    holds. Originals that the sentences together no longer hold come back, points neither cited nor set aside are
    added. The answer is ``refused`` where it is no JSON, no sentence is left or more than half of them go.

    The row of a slot is ``(slot, state, sentences, dropped, lost, missing, aside)``. ``kind`` is sentence, original or point.
    """
    whole = F.try_parse_json(strip_fences(F.col("answer")))
    read = cut_lineage(answers.select(slot, whole.alias("_v")))
    numbers = lambda v: F.transform(F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array_compact(F.array(F.try_variant_get(v, "$", "string"))), F.array().cast("array<string>")), lambda x: F.regexp_extract(x, r"^\s*[Pp]*(\d{1,9})\s*$", 1).try_cast("int"))
    listed = F.try_variant_get("_v", "$.zdania", "array<variant>")
    told = read.select(slot, F.posexplode(listed).alias("sentence", "_s")).filter(F.schema_of_variant("_s").startswith("OBJECT"))
    text = F.trim(F.regexp_replace(F.coalesce(F.try_variant_get("_s", "$.tekst", "string"), F.lit("")), r"\s+", " "))
    said = cut_lineage(told.select(slot, "sentence", text.alias("text"), F.array_compact(numbers(F.try_variant_get("_s", "$.z", "variant"))).alias("_z")))
    base = originals.select(slot, "text").unionByName(points.select(slot, "text"))
    well = F.length("text").between(*SENTENCE_CHARS) & ~F.col("text").rlike(MARKUP)
    kept = cut_lineage(said.filter(well).join(_unsupported(said, base, slot), [slot, "sentence"], "left_anti"))
    sizes = said.groupBy(slot).agg(F.count("*").alias("sentences"))
    left = kept.groupBy(slot).agg(F.count("*").alias("_left"))
    state = read.select(slot).join(sizes, slot, "left").join(left, slot, "left").fillna(0, ["sentences", "_left"])
    state = state.withColumn("dropped", F.col("sentences") - F.col("_left"))
    refused = (F.col("_left") == 0) | (2 * F.col("dropped") > F.col("sentences"))
    state = cut_lineage(state.select(slot, F.when(refused, "refused").otherwise("merged").alias("state"), "sentences", "dropped"))
    good = cut_lineage(kept.join(state.filter("state = 'merged'").select(slot), slot))
    # points held by a sentence, whatever it was told, and those it was told and shares a quarter of
    held = merge_repair(good, points, slot, CITES, telling).filter("how = 'cited'").select(slot, "sentence", "point")
    meant = good.select(slot, "sentence", F.explode("_z").alias("point")).distinct()
    both = meant.join(good.select(slot, "sentence", F.col("text").alias("_a")), [slot, "sentence"]).join(points.select(slot, "point", F.col("text").alias("_b")), [slot, "point"])
    cited = cut_lineage(held.unionByName(both.filter(F.size(F.array_intersect(telling(F.col("_a")), telling(F.col("_b")))) >= TOLD_CITES * F.size(telling(F.col("_b")))).select(slot, "sentence", "point")).distinct())
    # originals against all sentences together: distinct stems of the slot
    ours = originals.join(state.filter("state = 'merged'").select(slot), slot)
    spoken = good.select(slot, F.explode(telling(F.col("text"))).alias("k")).distinct().withColumn("_there", F.lit(1))
    each = ours.select(slot, "unit", F.explode(telling(F.col("text"))).alias("k")).join(spoken, [slot, "k"], "left")
    lost = each.groupBy(slot, "unit").agg(F.count("*").alias("_n"), F.count("_there").alias("_h")).filter(F.col("_h") < KEEPS * F.col("_n")).select(slot, "unit")
    lost = cut_lineage(ours.join(lost, [slot, "unit"]))
    aside = read.select(slot, F.explode(numbers(F.try_variant_get("_v", "$.nie_pasuje", "variant"))).alias("point")).distinct()
    unused = points.join(state.filter("state = 'merged'").select(slot), slot).join(cited.select(slot, "point").distinct(), [slot, "point"], "left_anti")
    missing = cut_lineage(unused.join(aside, [slot, "point"], "left_anti"))
    put = unused.join(aside, [slot, "point"], "left_semi").groupBy(slot).agg(F.array_sort(F.collect_list("point")).alias("aside"))
    lists = cited.groupBy(slot, "sentence").agg(F.array_sort(F.collect_list(F.col("point").cast("int"))).alias("cited"))
    none = F.array().cast("array<int>")
    rows = good.join(lists, [slot, "sentence"], "left").select(slot, F.col("sentence").cast("long").alias("place"), F.lit("sentence").alias("kind"), "text", F.coalesce("cited", none).alias("cited"))
    rows = rows.unionByName(lost.select(slot, F.col("unit").cast("long").alias("place"), F.lit("original").alias("kind"), "text", none.alias("cited")))
    rows = rows.unionByName(missing.select(slot, F.col("point").cast("long").alias("place"), F.lit("point").alias("kind"), "text", F.array(F.col("point").cast("int")).alias("cited")))
    count = lambda df, name: df.groupBy(slot).agg(F.count("*").alias(name))
    per = state.join(count(lost, "lost"), slot, "left").join(count(missing, "missing"), slot, "left").join(put, slot, "left").fillna(0, ["lost", "missing"])
    return rows, per.select(slot, "state", "sentences", "dropped", "lost", "missing", F.coalesce(F.col("aside").cast("array<int>"), none).alias("aside"))


def merge_repair(sentences: DataFrame, points: DataFrame, slot: str, least: float = 0.5, of: Callable[[Column], Column] = lambda text: stems(text, 5)) -> DataFrame:
    """Citations recomputed by coverage: sentences of a slot with the points they hold, and points left over.

    ``sentences`` holds ``(slot, sentence, text)``, ``points`` ``(slot, point, text)``. A sentence that holds the share
    ``least`` of a point's stems holds one of its rarest, so both meet on those only and are then counted.
    """
    s = cut_lineage(sentences.select(slot, "sentence", of(F.col("text")).alias("_s")))
    p = cut_lineage(points.select(slot, "point", of(F.col("text")).alias("_p")))
    each = s.select(slot, "sentence", F.explode("_s").alias("_k"))
    counts = each.groupBy(slot, "_k").agg(F.count("*").alias("_df"))
    ranked = p.select(slot, "point", F.explode("_p").alias("_k")).join(counts, [slot, "_k"], "left")
    ordered = ranked.groupBy(slot, "point").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), "_k"))).alias("_o"))
    n = F.size("_o")
    rare = ordered.select(slot, "point", F.explode(F.slice("_o", 1, (n - F.ceil(F.lit(least) * n - 1e-9) + 1).cast("int"))).alias("_r")).select(slot, "point", "_r._k")
    near = each.join(rare, [slot, "_k"]).select(slot, "sentence", "point").distinct()
    both = near.join(s, [slot, "sentence"]).join(p, [slot, "point"])
    cited = both.filter(F.size(F.array_intersect("_s", "_p")) >= least * F.size("_p")).select(slot, "sentence", "point", F.lit("cited").alias("how"))
    left = points.select(slot, "point").join(cited, [slot, "point"], "left_anti").select(slot, F.lit(None).cast(dict(sentences.dtypes)["sentence"]).alias("sentence"), "point", F.lit("added").alias("how"))
    return cited.unionByName(left)


def incremental_merge(inputs: DataFrame, previous: DataFrame, keys: Sequence[str], columns: Sequence[str], compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Only slots whose input hash changed are computed; the others keep their stored result."""
    hashed = inputs.withColumn("hash", short_sha(F.to_json(F.struct(*columns))))
    old = previous.select(*keys, "hash", "result")
    same = hashed.join(old, [*keys, "hash"]).select(*keys, "hash", "result", F.lit("reused").alias("how"))
    missing = hashed.join(old, [*keys, "hash"], "left_anti")
    return same.unionByName(compute(missing).select(*keys, "hash", "result", F.lit("computed").alias("how")))


def place_scores(points: DataFrame, point: str, section: str, text: str, places: Sequence[tuple[str, dict[str, float], Sequence[str], Sequence[str]]], least: float, fallback: str, word_weight: float = 1.0, strong_weight: float = 2.0, max_hits: int = 3) -> DataFrame:
    """Best place of each point: section prior, capped word hits and strong words; a fallback below the least score.

    ``places`` is a fixed list of ``(place, prior by section, words, strong words)``.
    """
    n = points.withColumn("_t", F.concat(F.lit(" "), norm_text(F.col(text)), F.lit(" ")))

    def hits(ws: Sequence[str]) -> Column:
        return F.size(F.filter(F.array(*[F.lit(f" {w}") for w in ws]), lambda w: F.contains(F.col("_t"), w))) if ws else F.lit(0)

    scored = []
    for i, (place, prior, ws, strong) in enumerate(places):
        base = F.coalesce(*[F.when(F.col(section) == s, F.lit(float(v))) for s, v in prior.items()], F.lit(0.0))
        score = base + word_weight * F.least(F.lit(max_hits), hits(ws)) + F.when(hits(strong) > 0, strong_weight).otherwise(0.0)
        scored.append(F.struct(F.round(score, 2).alias("score"), F.lit(-i).alias("o"), F.lit(place).alias("place")))
    best = F.array_max(F.array(*scored))
    out = n.withColumn("_b", best)
    return out.select(point, F.when(F.col("_b.score") >= least, F.col("_b.place")).otherwise(fallback).alias("place"), F.col("_b.score").alias("score"))


def _rounds(points: DataFrame, units: Units) -> tuple[DataFrame, DataFrame]:
    """The walk of :func:`place_inserts` in rounds: points as ``(ord, row)``, rows as ``(row, shown)``.

    ``points`` are ``(ord, unit, size)``: place in the walk, unit of equal owner and stems, length of the text. What a row
    shows is kept as versions, each good for the points after its own and up to the one that replaces it, so points may be
    decided out of order. A round decides every point that nothing undecided before it can touch any more:

    * A point like no row starts one if no undecided point before it is like it.
    * A point joins the first row like it, unless that row or an earlier one of its owner may change before: a row changes
      only at an undecided point like its open version and longer. Nor may an undecided point that could still start
      a row stand before that row.

    So a row takes all its points up to its next change in one round, and the number of rounds follows chains of changes
    and starts, not the size of a group. Every round is written to the checkpoint folder.
    """
    base = units.rows.filter("s_n > 0")
    undecided = cut_lineage(points.join(base.select("unit", "owner"), "unit").select("ord", "unit", "owner", "size"))
    none = undecided.limit(0)
    # unions add up the partitions of their sides, round after round
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = quantile_bucket(undecided.select(F.col("ord").alias("row")), ["row"])
    # an open version has no end
    versions = none.select(F.col("ord").alias("row"), F.col("ord").alias("shown"), "unit", "owner", "size", F.col("ord").alias("until"))
    like = none.select("unit", F.col("ord").alias("row"), F.col("ord").alias("shown"))
    joined = [none.select("ord", F.col("ord").alias("row"))]
    while not undecided.isEmpty():
        shows = versions.select("row", "shown", F.col("size").alias("_now"), "until")
        touching = undecided.join(like, "unit").join(shows, ["row", "shown"]).filter((F.col("shown") < F.col("ord")) & (F.col("until").isNull() | (F.col("ord") <= F.col("until"))))
        touching = cut_lineage(touching.select("ord", "row", "size", "_now", F.col("until").isNull().alias("_open")))
        now = cut_lineage(undecided.groupBy("unit").agg(F.min("ord").alias("at")).join(base, "unit"))
        behind = some_alike(units, now, None, True).select(F.col("b_unit").alias("unit")).distinct()
        starts = now.join(behind, "unit", "left_anti").select(F.col("at").alias("ord")).join(touching, "ord", "left_anti")
        fresh = cut_lineage(undecided.join(starts, "ord", "left_semi"))
        # where open versions end next, and the first such end in any earlier row of the owner
        ends = touching.filter("_open AND size > _now").groupBy("row").agg(F.min("ord").alias("_next"))
        change = versions.filter("until IS NULL").select("row", "owner").join(ends, "row", "left")
        earlier = running(change, ["owner"], [F.asc("row")], bucket, {"_before": ("min", F.col("_next"))}, inclusive=False)
        target = touching.groupBy("ord").agg(F.min_by(F.struct("row", "_open"), "row").alias("_t")).select("ord", "_t.*")
        steady = target.join(earlier.select("row", "_next", "_before"), "row")
        steady = steady.filter((~F.col("_open") | (F.col("ord") <= F.coalesce("_next", "ord"))) & (F.col("ord") <= F.coalesce("_before", "ord")))
        steady = cut_lineage(undecided.join(steady.select("ord", "row", (F.col("_open") & F.coalesce(F.col("ord") == F.col("_next"), F.lit(False))).alias("_change")), "ord"))
        waiting = undecided.join(steady, "ord", "left_anti").groupBy("owner").agg(F.min("ord").alias("_wait"))
        ready = cut_lineage(steady.join(waiting, "owner", "left").filter(F.col("row") < F.coalesce("_wait", F.col("row") + 1)).drop("_wait"))
        joined.append(written(ready.select("ord", "row").unionByName(fresh.select("ord", F.col("ord").alias("row"))).coalesce(parts)))
        changed = ready.filter("_change").select("row", F.col("ord").alias("shown"), "unit", "owner", "size")
        opened = cut_lineage(changed.unionByName(fresh.select(F.col("ord").alias("row"), F.col("ord").alias("shown"), "unit", "owner", "size")).withColumn("until", F.lit(None).cast(undecided.schema["ord"].dataType)).coalesce(parts))
        closed = versions.join(changed.select("row", F.col("shown").alias("_end")), "row", "left").withColumn("until", F.coalesce("until", "_end")).drop("_end")
        versions = written(closed.unionByName(opened).coalesce(parts))
        undecided = written(undecided.join(ready.select("ord").unionByName(fresh.select("ord")), "ord", "left_anti"))
        left = undecided.select("unit").distinct()
        new = all_alike(units, units.of(opened), base.join(left, "unit", "left_semi")).select("a_unit", F.col("b_unit").alias("unit"))
        new = new.join(opened.select(F.col("unit").alias("a_unit"), "row", "shown"), "a_unit").select("unit", "row", "shown")
        like = written(like.join(left, "unit", "left_semi").unionByName(new).coalesce(parts))
    return reduce(DataFrame.unionByName, joined), versions.filter("until IS NULL").select("row", "shown")


def place_inserts(
    points: DataFrame, entity: str, place: str, order: str, text: str, facts: str, sources: str, present: DataFrame | None = None, twin: float = 0.5, known: float = 0.6
) -> DataFrame:
    """Points of each place with twins merged: the longer text wins, sources and facts are united.

    Points at ``known`` similarity to a text of ``present`` (entity, place, text) are left out. In ``order`` (a unique number) a
    point joins the first row whose text of the moment is alike at ``twin``, and a longer point gives the row its
    text from then on; see :func:`_rounds`. A text without stems is like no other.
    """
    kept = points
    if present is not None:
        kept = dedup_texts_against(points, [entity, place], order, text, known, present)
    # texts are read again where they are needed, not kept beside
    kept = kept.select(entity, place, order, text, facts, sources)
    members, units = _text_units(kept, [entity, place], order, text, None, twin)
    sized = members.join(kept.select(F.col(order).alias("ord"), F.length(F.coalesce(text, F.lit(""))).alias("size")), "ord")
    joined, rows = _rounds(sized, units)
    at = kept.join(joined.withColumnRenamed("row", "_row"), F.col(order) == F.col("ord"), "left").withColumn("_row", F.coalesce("_row", order))
    # one entry per fact at its first point, so that copies are gone before anything is listed
    told = at.groupBy("_row", facts).agg(F.min(order).alias("_at"), F.collect_set(sources).alias("_s"), F.count("*").alias("_n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(facts).alias("f")))), lambda x: x["f"])
    united = told.groupBy("_row").agg(ordered.alias(facts), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_s")))).alias(sources), F.sum("_n").cast("int").alias("merged"))
    shown = united.join(rows, F.col("_row") == F.col("row"), "left").select("_row", facts, sources, "merged", F.coalesce("shown", "_row").alias("_shown"))
    spoken = kept.select(F.col(order).alias("_shown"), F.col(text).alias("_text"))
    heads = kept.select(entity, place, F.col(order).alias("_row"))
    out = shown.join(spoken, "_shown").join(heads, "_row")
    return out.select(entity, place, F.col("_row").alias(order), F.col("_text").alias(text), facts, sources, "merged")


def dedup_texts_against(rows: DataFrame, owner: Sequence[str], order: str, text: str, threshold: float, known: DataFrame) -> DataFrame:
    """Rows whose text is not alike any known text of their owner."""
    return _beside(rows, owner, order, text, threshold, known)


def store_facts(new: DataFrame, stored: DataFrame, entity: str, order: str, text: str, quote: str) -> DataFrame:
    """New facts without equal fingerprint, equal quote or a 0.6-similar text, stored or new; with their fingerprint."""
    kept = dedup_texts(new, [entity], order, text, 0.6, quote=quote, known=stored)
    return kept.withColumn("fingerprint", fingerprint(F.col(entity).cast("string"), F.col(text)))


def apply_translations(pending: DataFrame, fact: str, results: DataFrame, low: int = 12, high: int = 700) -> DataFrame:
    """Pending quotes with their result: same language kept, unknown rejected, no translator waits, bad ones rejected.

    ``results`` holds ``(fact, translated, problem)``.
    """
    j = pending.join(results, fact, "left")
    lang = F.left(F.lower(F.coalesce("language", F.lit(""))), F.lit(2))
    text = F.when(lang == "pl", F.col("quote")).otherwise(F.trim("translated"))
    state = (
        F.when(lang == "", "rejected")
        .when((lang != "pl") & F.col("translated").isNull() & F.col("problem").isNull(), "untranslated")
        .when((lang != "pl") & F.col("problem").isNotNull(), "rejected")
        .when(~F.length(text).between(low, high), "rejected")
        .when(F.col("status") == "applied", "verified")
        .otherwise("new")
    )
    live = ~state.isin("rejected", "untranslated")
    return j.select(fact, state.alias("status"), F.when(live, text).alias("text"), F.when(live, fingerprint(F.col("entity").cast("string"), text)).alias("fingerprint"))


def child_records(pages: DataFrame, url: str, records: str, taken: DataFrame) -> DataFrame:
    """Further records of a page as rows of their own; an existing child is replaced only while raw or in error.

    ``taken`` holds ``(url, status)`` of stored items.
    """
    each = pages.select(F.col(url).alias("parent"), F.posexplode(records).alias("pos", "record"))
    name = F.when(F.col("pos") == 0, F.col("parent")).otherwise(F.concat("parent", F.lit("#przepis-"), (F.col("pos") + 1).cast("string")))
    j = each.withColumn("url", name).join(taken.select("url", "status"), "url", "left")
    blocked = (F.col("pos") > 0) & ~F.coalesce(F.col("status"), F.lit("raw")).isin("raw", "error")
    return j.filter(~blocked).select("url", "parent", "pos", "record")


def class_samples(items: DataFrame, source: str, label: str, confidence: str, item: str, sizes: dict[str, int]) -> DataFrame:
    """Most confident addresses of each class per source, a fixed number of each."""
    top = top_per_key(items.filter(F.col(label).isin(*sizes)), [source, label], [F.desc(confidence), F.asc(item)], max(sizes.values()))
    size = F.coalesce(*[F.when(F.col(label) == c, F.lit(n)) for c, n in sizes.items()])
    return top.filter(F.col("rank") <= size)


def kind_mode(facts: DataFrame, point: str, kind: str) -> DataFrame:
    """Most frequent kind among the facts of a point, the smaller name on ties."""
    n = facts.filter(F.col(kind).isNotNull()).groupBy(point, kind).agg(F.count("*").alias("n"))
    low = n.groupBy(point).agg(F.max("n").alias("_top"))
    return n.join(low, point).filter("n = _top").groupBy(point).agg(F.min(kind).alias(kind))


def derived_slots(parts: DataFrame, entity: str, part: str, web_parts: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Slots of each part of an entity's own document and of parts known only from statements."""
    own = parts.select(entity, part).distinct().withColumn("origin", F.lit("own"))
    web = web_parts.select(entity, part).filter(F.col(part).isNotNull()).distinct().join(own.select(entity, part), [entity, part], "left_anti").withColumn("origin", F.lit("web"))
    each = F.explode(F.array(*[F.lit(f) for f in fields]))
    return own.unionByName(web).select(entity, part, "origin", each.alias("field")).select(entity, "origin", F.concat(F.lit("parts."), part, F.lit("."), "field").alias("slot"))


def palette_build(items: DataFrame, item: str, mapping: DataFrame, facts: DataFrame, entity: str, order: str, text: str, warning: Column, k: int) -> DataFrame:
    """Notes and warnings of each item without repeats, as rows; items without an entity are listed as such."""
    own = facts.join(few(mapping), entity).withColumn("kind", F.when(warning, "warning").otherwise("note"))
    own = own.withColumn("_owner", F.concat_ws(":", item, "kind"))
    # equal texts are found by their hash, and what they are found among holds no text
    prints = own.select("_owner", order, (-F.col(order)).alias("_neg"), F.sha2(text, 256).alias("_print"))
    first = newest_per_key(prints, ["_owner", "_print"], ["_neg"]).select("_owner", order)
    firsts = own.join(few(first), ["_owner", order], "left_semi").dropDuplicates(["_owner", order])
    kept = dedup_topk(firsts, "_owner", order, text, k)
    rows = kept.select(item, "kind", order, text)
    lone = items.select(item).join(mapping.select(item).distinct(), item, "left_anti")
    return rows.unionByName(lone.select(item, F.lit("no_entity").alias("kind"), F.lit(None).cast(dict(rows.dtypes)[order]).alias(order), F.lit(None).cast("string").alias(text)))


def fact_entry(columns: dict[str, Column]) -> Column:
    """A fact as the JSON entry of its file; NULL fields are left out."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]))


def suggested_moves(points: DataFrame, point: str, entity: str, moves: DataFrame, places: Sequence[str], new_places: int) -> DataFrame:
    """Suggested places for known points; new places are taken up to a number per entity, in order of their name."""
    m = moves.join(points.select(point, entity), point)
    fresh = m.filter(~F.col("place").isin(*places)).select(entity, "place").distinct()
    allowed = top_per_key(fresh, [entity], [F.asc("place")], new_places).select(entity, "place", F.lit(True).alias("_ok"))
    good = m.join(allowed, [entity, "place"], "left").filter(F.col("place").isin(*places) | F.coalesce("_ok", F.lit(False)))
    return points.join(good.select(point, F.col("place").alias("_move")), point, "left").withColumn("place", F.coalesce("_move", "place")).drop("_move")
