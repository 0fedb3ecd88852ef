"""Data-quality rules: error rows, never exceptions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions import arrow
from florilege.functions.text import norm_part, norm_text

HTML = r"(?i)<[a-z/!]"  # fixed value: a tag in a text
WEB = r"(?i)^https?://[^\s/]+"  # fixed value: an address


def error_rows(rows: DataFrame, keys: Sequence[str], checks: dict[str, Column]) -> DataFrame:
    """One row per key and failed check."""
    codes = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), code) for code, bad in checks.items()]))
    return rows.select(*keys, F.explode(codes).alias("error"))


def candidate_checks(old: DataFrame, new: DataFrame, entity: str, hand: Sequence[str], required: Sequence[str], facts: DataFrame, sections: Sequence[str]) -> DataFrame:
    """Errors of a new version: hand-written fields removed or changed, facts lost, fields missing, bad facts.

    ``facts`` holds ``(entity, fact, version, section, text, url)`` with versions old and new.
    """
    o = old.select(entity, F.lit(True).alias("_old"), *[F.col(c).alias(f"_o_{c}") for c in hand])
    j = new.withColumn("_new", F.lit(True)).join(o, entity, "left")
    checks: dict[str, Column] = {}
    for c in hand:
        checks[f"removed:{c}"] = F.col("_old") & F.col(f"_o_{c}").isNotNull() & F.col(c).isNull()
        checks[f"changed:{c}"] = F.col("_old") & (F.col(f"_o_{c}") != F.col(c))
    for c in required:
        checks[f"missing:{c}"] = F.col("_old").isNull() & F.col(c).isNull()
    fields = error_rows(j, [entity], checks)
    fresh = facts.filter("version = 'new'")
    lost = facts.filter("version = 'old'").join(fresh.select(entity, "fact"), [entity, "fact"], "left_anti")
    lost = lost.select(entity, F.lit("lost_facts").alias("error")).distinct()
    twice = fresh.groupBy(entity, "fact").agg(F.count("*").alias("n")).filter("n > 1").select(entity, F.lit("repeated_fact").alias("error")).distinct()
    bad = error_rows(
        fresh, [entity],
        {
            "section": ~F.col("section").isin(*sections), "length": ~F.length("text").between(20, 600),
            "html": F.col("text").rlike(HTML), "source": ~F.coalesce(F.col("url"), F.lit("")).rlike(WEB),
        },
    ).distinct()
    return fields.unionByName(lost).unionByName(twice).unionByName(bad)


def _tallied(a: DataFrame, b: DataFrame, entity: str, key: str, *more: Column) -> DataFrame:
    """Rows of ``a`` and of ``b`` per entity and key as ``_a`` and ``_b``, and whether they meet there; NULL meets nothing.

    Rows are dealt by key before they are counted: nearly every key is its own, so counts of a part of a file would hold all its rows.
    """
    one, none = F.lit(1), F.lit(0)
    both = a.withColumns({"_a": one, "_b": none}).unionByName(b.withColumns({"_a": none, "_b": one}), allowMissingColumns=True)
    n = both.repartition(entity, key).groupBy(entity, key).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"), *more)
    return n.withColumn("_met", F.col(entity).isNotNull() & F.col(key).isNotNull() & (F.col("_a") > 0) & (F.col("_b") > 0))


def layout_checks(facts: DataFrame, points: DataFrame, sources: DataFrame, entity: str, sections: Sequence[str], most: int = 600) -> DataFrame:
    """Errors of a layout: sections, lengths, source numbers, and every fact exactly once.

    ``points`` holds one row per point and fact with section, text and source number.
    """
    own = error_rows(points, [entity], {"section": ~F.col("section").isin(*sections), "length": ~F.length("text").between(20, most), "html": F.col("text").rlike(HTML)})
    by_fact = _tallied(points.select(entity, F.col("fact").alias("_k")), facts.select(entity, F.col("fact").alias("_k")), entity, "_k")
    by_source = _tallied(points.select(entity, F.col("source").alias("_k")), sources.select(entity, F.col("nr").alias("_k")), entity, "_k")

    def told(tallies: DataFrame, counts: dict[str, Column]) -> DataFrame:
        each = F.array(*[F.struct(F.lit(code).alias("error"), n.cast("long").alias("n")) for code, n in counts.items()])
        return tallies.select(entity, F.inline(each)).filter("n > 0")

    a, b, met = F.col("_a"), F.col("_b"), F.col("_met")
    rows = own.withColumn("n", F.lit(1).cast("long"))
    rows = rows.unionByName(told(by_fact, {"fact_twice": (a > 1).cast("int"), "unknown_fact": ((a > 0) & ~met).cast("int"), "fact_left_out": F.when(met, 0).otherwise(b)}))
    rows = rows.unionByName(told(by_source, {"unknown_source": F.when(met, 0).otherwise(a), "source_number_twice": (b > 1).cast("int")}))
    return rows.repartition(entity, "error").groupBy(entity, "error").agg(F.sum("n").alias("n"))


def merged_checks(rows: DataFrame, entity: str, slot: str, slots: Sequence[str], original: str, live: str, numbers: str, known: str, most: int = 700) -> DataFrame:
    """Errors of merged texts: unknown slot, changed original, bad text, sources off the list."""
    return error_rows(
        rows, [entity, slot],
        {
            "unknown_slot": ~F.col(slot).isin(*slots),
            "original_changed": F.col(original).isNotNull() & ~F.col(original).eqNullSafe(F.col(live)),
            "bad_text": ~F.length("text").between(3, most) | F.col("text").rlike(HTML),
            "unknown_source": F.size(F.array_except(numbers, known)) > 0,
        },
    )


def placement_checks(rows: DataFrame, entity: str, place: str, places: Sequence[str], merged: DataFrame) -> DataFrame:
    """Errors of placed points: unknown place, a place named twice, empty points, sources, already merged facts.

    ``rows`` hold ``(entity, block, place, point, fact, text, sources, known)``.
    """
    own = error_rows(
        rows, [entity],
        {"unknown_place": ~F.col(place).isin(*places), "empty": F.trim("text") == "", "unknown_source": F.size(F.array_except("sources", "known")) > 0},
    )
    twice = rows.groupBy(entity, place).agg(F.countDistinct("block").alias("n")).filter("n > 1").select(entity, F.lit("place_twice").alias("error"))
    already = rows.join(merged.select(entity, "fact").distinct(), [entity, "fact"], "left_semi").select(entity, F.lit("already_merged").alias("error"))
    return own.unionByName(twice).unionByName(already).groupBy(entity, "error").agg(F.count("*").alias("n"))


def media_checks(rows: DataFrame, entity: str, gallery: str, host: str) -> DataFrame:
    """Errors of a gallery map ``label -> address``: size, labels, hosts, author and licence."""
    keys, values = F.map_keys(gallery), F.map_values(gallery)
    return error_rows(
        rows, [entity],
        {
            "gallery_size": ~F.size(gallery).between(1, 8),
            "label": F.exists(keys, lambda k: ~F.length(k).between(1, 80) | k.rlike("[<>\"'`]")),
            "host": F.exists(values, lambda v: ~v.rlike(host)),
            "author": F.coalesce(F.trim("author"), F.lit("")) == "",
            "licence": F.coalesce(F.trim("licence"), F.lit("")) == "",
        },
    )


def identity_align(rows: DataFrame, file: str, stored: str) -> DataFrame:
    """Row ids aligned to their file; the old id stays as an alias unless it is the id of another file."""
    others = rows.select(F.col(file).alias(stored), F.lit(True).alias("_taken")).distinct()
    j = rows.join(others, stored, "left")
    differs = F.col(stored) != F.col(file)
    action = F.when(~differs, "kept").when(F.col("_taken"), "refused").otherwise("aligned")
    return j.select(file, F.when(action == "refused", F.col(stored)).otherwise(F.col(file)).alias(stored), action.alias("action"), F.when(action == "aligned", F.col(stored)).alias("alias"))


def layout_answer_checks(inputs: DataFrame, answers: DataFrame, entity: str, fact: str, faithful: Column) -> DataFrame:
    """Whether a suggested layout may be taken: every input once, none unknown, faithful texts; all or nothing."""
    told = answers.select(entity, fact, F.coalesce(faithful, F.lit(False)).alias("_ok"))
    n = _tallied(told, inputs.select(entity, fact), entity, fact, F.bool_and("_ok").alias("_ok"))
    a, b, met = F.col("_a"), F.col("_b"), F.col("_met")
    # an answered key counts once for each of its inputs, and once where it has none
    times = F.when(met, b).when(a > 0, 1).otherwise(0)
    total = lambda count: F.sum(count.cast("long"))
    return n.groupBy(entity).agg(
        total(F.when(met, 0).otherwise(b)).alias("left_out"),
        total(F.when(a > 1, times).otherwise(0)).alias("twice"),
        total(((a > 0) & ~met).cast("int")).alias("unknown"),
        total(F.when(~F.col("_ok"), times).otherwise(0)).alias("unfaithful"),
    ).withColumn("accepted", F.col("left_out") + F.col("twice") + F.col("unknown") + F.col("unfaithful") == 0)


def parse_verdicts(answers: DataFrame, raw: str, facts: DataFrame, fact: str) -> DataFrame:
    """Verdicts on known facts: status and reason; facts without a verdict stay as they are."""
    doc = F.from_json(raw, "struct<oceny:array<struct<id:long,ok:boolean,powod:string>>>")
    v = answers.select(F.inline(doc["oceny"])).groupBy(F.col("id").alias(fact)).agg(F.max_by(F.struct("ok", "powod"), F.coalesce("ok", F.lit(False))).alias("v"))
    j = facts.join(v, fact, "left")
    state = F.when(F.col("v").isNull(), F.col("status")).when(F.coalesce("v.ok", F.lit(False)), "verified").otherwise("rejected")
    return j.select(fact, state.alias("status"), F.left(F.coalesce("v.powod", F.lit("")), F.lit(200)).alias("reason"))


def parse_review(rows: DataFrame, key: str, raw: str, text: str, criteria: Sequence[str]) -> DataFrame:
    """Marks clamped to 1-10, and claims only where their quote stands in the text."""
    doc = F.from_json(raw, "struct<oceny:map<string,double>,bledy:array<struct<cytat:string,problem:string>>>")
    marks = F.map_filter(F.transform_values(doc["oceny"], lambda k, v: F.greatest(F.lit(1), F.least(F.lit(10), F.bround(v).cast("int")))), lambda k, v: k.isin(*criteria))
    claims = F.coalesce(doc["bledy"], F.array().cast("array<struct<cytat:string,problem:string>>"))
    body = norm_text(F.col(text))
    d = rows.select(key, marks.alias("marks"), claims.alias("claims"), body.alias("_body"))
    real = F.filter("claims", lambda c: (F.length(norm_text(c["cytat"])) >= 4) & F.contains(F.col("_body"), norm_text(c["cytat"])))
    return d.select(key, "marks", F.size(real).alias("kept"), (F.size("claims") - F.size(real)).alias("dropped"), (F.size(F.map_keys("marks")) >= len(criteria) // 2).alias("usable"))


def fact_answer_checks(answers: DataFrame, key: str, raw: str, texts: DataFrame, text: str, sections: Sequence[str], dose: str = r"(?i)\d+\s*(g|mg|ml|łyż|kropl|drops?|tsp|tbsp)\b") -> DataFrame:
    """Extracted statements with the reason why they are taken or not: quote in the source, length, doses, repeats."""
    doc = F.from_json(raw, "struct<fakty:array<struct<cytat:string,sekcja:string,czesc:string>>>")
    each = answers.select(key, F.posexplode(doc["fakty"]).alias("pos", "f")).join(texts.select(key, text), key)
    each = each.select(key, "pos", F.col("f.sekcja").alias("section"), F.col("f.czesc").alias("part"), arrow.snap_quote(F.col("f.cytat"), F.col(text)).alias("span"))
    each = each.withColumn("_n", norm_text(F.col("span")))
    firsts = each.groupBy(key, "_n").agg(F.min("pos").alias("_first"))
    j = each.join(firsts, [key, "_n"])
    reason = (
        F.when(F.col("span").isNull(), "no_quote").when(F.length("span") < 20, "too_short").when(F.col("span").rlike(dose), "dose").when(F.col("pos") != F.col("_first"), "repeated").otherwise("taken")
    )
    section = F.when(F.col("section").isin(*sections), F.col("section")).otherwise("ciekawostki")
    return j.select(key, "pos", section.alias("section"), norm_part(F.col("part")).alias("part"), "span", reason.alias("reason"))


def idea_answer_checks(articles: DataFrame, key: str, text: str, answers: DataFrame, raw: str, most: int = 3, least: int = 30) -> DataFrame:
    """First ideas of each article with a real quote and enough text; articles without any are marked empty."""
    doc = F.from_json(raw, "array<struct<tekst:string,cytat:string>>")
    each = answers.select(key, F.posexplode(F.slice(doc, 1, most)).alias("pos", "x")).join(articles.select(key, text), key)
    good = (F.length("x.tekst") >= least) & F.contains(norm_text(F.col(text)), norm_text(F.col("x.cytat"))) & (F.length("x.cytat") > 0)
    kept = each.filter(good).select(key, "pos", F.col("x.tekst").alias("idea"))
    empty = articles.select(key).join(kept.select(key).distinct(), key, "left_anti").select(key, F.lit(None).cast("int").alias("pos"), F.lit("").alias("idea"))
    return kept.unionByName(empty)


def rating_mean(*marks: Column) -> Column:
    """Mean of marks clamped to 1-10, NULL ones left out."""
    clamped = F.array_compact(F.array(*[F.greatest(F.lit(1), F.least(F.lit(10), F.bround(m).cast("int"))) for m in marks]))
    return F.round(F.aggregate(clamped, F.lit(0), lambda a, x: a + x) / F.nullif(F.size(clamped), F.lit(0)), 1)
