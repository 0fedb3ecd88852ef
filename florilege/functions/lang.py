"""Language codes, foreign texts and label maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lang2(code: Column) -> Column:
    """Two-letter code of a language tag; ``?`` when unknown."""
    head = F.substring_index(F.replace(F.lower(F.coalesce(code, F.lit("?"))), F.lit("_"), F.lit("-")), "-", 1)
    return F.coalesce(F.nullif(head, F.lit("")), F.lit("?"))


def is_foreign(code: Column, original: Column) -> Column:
    """Not Polish by its code; without a code, written in Cyrillic, Chinese or Japanese."""
    low = F.lower(F.coalesce(code, F.lit("")))
    return F.when(low != "", ~low.startswith("pl")).otherwise(F.coalesce(original.rlike("[Ѐ-ӿ぀-ヿ一-鿿]"), F.lit(False)))


def wiki_lang_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^https?://([a-z-]+)(?:\.m)?\.wikipedia\.org/", 1), F.lit(""))


def labels_by_lang(labels: Column) -> Column:
    """Labels per language without blanks; of the Chinese variants the simplified one wins."""
    full = F.map_filter(labels, lambda k, v: F.coalesce(v, F.lit("")) != "")
    chinese = F.coalesce(*[F.try_element_at(full, F.lit(k)) for k in ("zh-hans", "zh-cn", "zh")])
    others = F.map_filter(full, lambda k, v: ~k.startswith("zh"))
    return F.when(chinese.isNull(), others).otherwise(F.map_concat(others, F.create_map(F.lit("zh"), chinese)))


def aliases_by_lang(aliases: Column, most: int = 12) -> Column:
    """First aliases per language; Chinese ones live in the labels."""
    kept = F.map_filter(aliases, lambda k, v: ~k.startswith("zh") & (F.size(v) > 0))
    return F.transform_values(kept, lambda k, v: F.slice(v, 1, most))
