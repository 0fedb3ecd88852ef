"""Expressions over short profile notes: part segments, taste, and warm-cold or dry-wet axes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from florilege.functions import rules
from florilege.functions.text import let, norm_part, strip_accents, words


def pick_segment(note: Column, part: Column) -> Column:
    """The piece of ``a (part), b (part, part)`` written for a part; else the only piece or one without a part."""

    def named(p: Column) -> Column:
        return F.struct(
            F.regexp_replace(F.regexp_replace(p, r"\([^)]*\)", ""), r"^[\s,;/.]+|[\s,;/.]+$", "").alias("text"),
            F.transform(F.split(F.regexp_extract(p, r"\(([^)]*)\)", 1), r"[,/;]| i "), norm_part).alias("parts"),
        )

    def best(pieces: Column) -> Column:
        alone = F.size(pieces) == 1

        def rank(n: Column) -> Column:
            return F.when(F.array_contains(n["parts"], part), 0).when(F.size(F.array_compact(n["parts"])) == 0, 2)

        ranked = F.transform(F.transform(pieces, named), lambda n, i: F.struct(F.coalesce(rank(n), F.when(alone, 1)).alias("r"), i.alias("i"), n["text"].alias("text")))
        return F.array_min(F.filter(ranked, lambda x: x["r"].isNotNull()))["text"]

    return let(F.filter(F.regexp_extract_all(note, F.lit(r"[^()]*(?:\([^)]*\))?"), F.lit(0)), lambda p: F.trim(p) != ""), best)


def taste(note: Column) -> Column:
    """First clear taste; one behind a weakening word counts only when no other is named."""
    weak_words = F.array(*[F.lit(w) for w in rules.WEAK_WORDS])

    def name(w: Column) -> Column:
        return F.coalesce(*[F.when(w.startswith(stem), F.lit(value)) for stem, value in rules.TASTES])

    def named(low: Column) -> Column:
        before = F.slice(F.concat(F.array(F.lit("")), low), 1, F.size(low))
        each = F.zip_with(low, before, lambda w, b: F.struct(name(w).alias("taste"), F.array_contains(weak_words, b).alias("weak")))
        return F.filter(each, lambda x: x["taste"].isNotNull())

    def first(found: Column) -> Column:
        strong = F.filter(found, lambda x: ~x["weak"])
        return F.coalesce(F.try_element_at(strong, F.lit(1))["taste"], F.try_element_at(found, F.lit(1))["taste"])

    return let(let(words(note), named), first)


def axis(note: Column, one: str, other: str) -> Column:
    """Which side of an axis a note names; NULL when neutral, silent or both."""
    low = words(strip_accents(note))

    def has(side: str) -> Column:
        return F.exists(low, lambda w: w.rlike("^(" + "|".join(rules.AXES[side]) + ")"))

    neutral = F.exists(low, lambda w: w.rlike("^(neutral|stabiliz)"))
    return F.when(~neutral & has(one) & ~has(other), one).when(~neutral & has(other) & ~has(one), other)
