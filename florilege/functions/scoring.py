"""Scores, verdicts, notes and limits as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from florilege.functions import rules

# Verdicts from mild to strict, and the lowest scores for the first two.
VERDICTS = ("publish", "improve", "reject")
PUBLISH_FROM, IMPROVE_FROM = 72, 45


def expert_score(scores: Column, weights: dict[str, float]) -> Column:
    """Weighted marks of 1 to 10 as 0 to 100; criteria without a mark do not count."""
    top, bottom = F.lit(0.0), F.lit(0.0)
    for name, weight in weights.items():
        mark = F.try_element_at(scores, F.lit(name))
        top = top + F.coalesce((mark - 1) / 9 * 100 * weight, F.lit(0.0))
        bottom = bottom + F.when(mark.isNotNull(), weight).otherwise(0)
    return F.round(top / F.nullif(bottom, F.lit(0.0)), 1)


def stricter_verdict(score: Column, scores: Column, hard: Sequence[str], model: Column, warnings: Column | None = None, errors: Column | None = None) -> Column:
    """The stricter of the rule and the reviewer: low marks on hard criteria, errors and warnings raise the rule."""
    rank = _rule_rank(score, scores, hard, warnings, errors)
    return F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), F.greatest(rank, _said(model)) + 1)


def _said(model: Column) -> Column:
    return F.coalesce(*[F.when(model == v, i) for i, v in enumerate(VERDICTS)], F.lit(0))


def _rule_rank(score: Column, scores: Column, hard: Sequence[str], warnings: Column | None, errors: Column | None) -> Column:
    rank = F.when(score >= PUBLISH_FROM, 0).when(score >= IMPROVE_FROM, 1).otherwise(2)
    for name in hard:
        mark = F.coalesce(F.try_element_at(scores, F.lit(name)), F.lit(10))
        rank = F.greatest(rank, F.when(mark <= 2, 2).when(mark <= 4, 1).otherwise(0))
    for sign in (warnings, errors if errors is None else errors > 0):
        if sign is not None:
            rank = F.greatest(rank, F.when(sign, 1).otherwise(0))
    return rank


def verdict_reasons(score: Column, scores: Column, hard: Sequence[str], model: Column, warnings: Column | None = None, errors: Column | None = None) -> Column:
    """Why a text was not published as it is, in the order of the checks: score, hard criteria, errors, numbers, reviewer."""
    said = []
    said.append(F.when(score < PUBLISH_FROM, F.concat(F.lit("score "), F.bround(score, 0).cast("int").cast("string"), F.lit("/100"))))
    for name in hard:
        mark = F.try_element_at(scores, F.lit(name))
        said.append(F.when(mark <= 4, F.concat(F.lit(f"{name}: "), mark.cast("string"), F.lit("/10"))))
    if errors is not None:
        said.append(F.when(errors > 0, F.concat(F.lit("errors: "), errors.cast("string"))))
    if warnings is not None:
        said.append(F.when(warnings, "numbers not in the data"))
    said.append(F.when(_said(model) > _rule_rank(score, scores, hard, warnings, errors), F.concat(F.lit("reviewer: "), model)))
    return F.array_compact(F.array(*said))


def engagement(reactions: Column, comments: Column, shares: Column) -> Column:
    """Reactions, twice the comments, three times the shares; NULL when nothing is known."""
    known = reactions.isNotNull() | comments.isNotNull() | shares.isNotNull()
    zero = F.lit(0)
    return F.when(known, F.coalesce(reactions, zero) + 2 * F.coalesce(comments, zero) + 3 * F.coalesce(shares, zero))


def token_estimate(*texts: Column) -> Column:
    """A quarter of the characters, one at least."""
    chars = F.lit(0)
    for text in texts:
        chars = chars + F.coalesce(F.length(text), F.lit(0))
    return F.greatest(F.lit(1), F.floor(chars / 4).cast("int"))


def purpose_of(system: Column) -> Column:
    """Purpose of a request by the first marker in its system prompt."""
    out = F.when(system.contains(rules.PURPOSES[0][0]), rules.PURPOSES[0][1])
    for marker, purpose in rules.PURPOSES[1:]:
        out = out.when(system.contains(marker), purpose)
    low = F.lower(system)
    post = low.contains("post") & (low.contains("facebook") | low.contains("instagram") | low.contains("marketing"))
    return out.when(post, "marketing").otherwise("inne")


def retry_seconds(text: Column) -> Column:
    """Seconds to wait as two kinds of error text state them."""
    delay = r'retryDelay"?\s*:\s*"(\d+(?:\.\d+)?)s"'
    again = r"(?i)(?:try again|retry) in\s+(?:(\d+)h)?\s*(?:(\d+)m(?!s))?\s*(?:(\d+(?:\.\d+)?)(ms|s))?"

    def number(i: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(text, again, i), F.lit("")).cast("double"), F.lit(0.0))

    unit = F.when(F.regexp_extract(text, again, 4) == "ms", 1000.0).otherwise(1.0)
    spoken = number(1) * 3600 + number(2) * 60 + number(3) / unit
    return F.when(text.rlike(delay), F.nullif(F.regexp_extract(text, delay, 1), F.lit("")).cast("double")).when(text.rlike(again), F.nullif(spoken, F.lit(0.0)))


def limit_kind(text: Column) -> Column:
    """Whether a limit is a short one or a used-up quota."""
    low = F.lower(text)
    daily = low.rlike(r"per day|perday|\(tpd\)|\(rpd\)|daily")
    minute = low.rlike(r"per minute|perminute|\(tpm\)|\(rpm\)|\(otpm\)|\(itpm\)|per second")
    wait = retry_seconds(text)
    billed = low.rlike("exceeded your current quota|billing") & (wait.isNull() | (wait > 300))
    return F.when(~minute & (daily | billed), "quota").otherwise("minute")


def parse_budget(text: Column) -> Column:
    """``name=1_000,name=2`` to a map; pairs without a number are left out."""
    pairs = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda p: p.rlike(r"^[^=]+=\s*[\d_]+\s*$"))
    return F.map_from_entries(
        F.transform(pairs, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)), F.replace(F.trim(F.substring_index(p, "=", -1)), F.lit("_"), F.lit("")).cast("long")))
    )


def review_notes(errors: Column, risks: Column, scores: Column, suggestions: Column, least: int = 8) -> Column:
    """Notes in order: errors, risks, weak criteria from the lowest mark, suggestions."""

    def tagged(tag: str, items: Column) -> Column:
        return F.transform(items, lambda x: F.concat(F.lit(f"{tag}: "), x))

    weak = F.filter(F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k")))), lambda e: e["v"] < least)
    marks = F.transform(weak, lambda e: F.concat(e["k"], F.lit(" "), e["v"].cast("string")))
    return F.concat(tagged("error", errors), tagged("risk", risks), marks, tagged("suggestion", suggestions))
