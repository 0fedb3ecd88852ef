"""Dictionary links, enrichment and anti joins.

Text meets a large catalogue through an inverted index: the vocabulary of all texts is cut into prefixes or substrings,
joined with the pieces of the names on equality, and the texts join on their words. No text meets every name. The
pieces of a small catalogue are looked up in each text as it stands, which is less work than its words are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from florilege.functions.text import ngrams, norm_text, words
from florilege.operators.primitives import newest_per_key, top_per_key
from florilege.session import cut_lineage, written


#: Distinct pieces up to which a text is searched for each of them; cutting a text into words and joining those costs
#: as much as some 2,000 searches.
FEW = 1000
#: Signs of a piece by which words of a vocabulary meet it before the whole piece is compared.
HEAD = 5


def _few(pieces: DataFrame) -> bool:
    return pieces.select("piece").distinct().limit(FEW + 1).count() <= FEW


def _searched(texts: DataFrame, text_id: str, hay: Column, pieces: DataFrame, needle: Column) -> DataFrame:
    """``(text_id, piece)`` where the needle of a piece stands in a text; the pieces are few."""
    needles = [tuple(r) for r in pieces.select("piece", needle.alias("_needle")).distinct().collect() if r["_needle"] is not None]

    @F.pandas_udf(ArrayType(StringType()))
    def held(hays: pd.Series) -> pd.Series:
        return hays.map(lambda text: [piece for piece, n in needles if n in text], na_action="ignore")

    return texts.select(text_id, F.explode(held(hay)).alias("piece")).distinct()


def _each(texts: DataFrame, text_id: str, found: Column) -> DataFrame:
    """``(text_id, w)``: the distinct words of each text, written so that the texts are cut up once."""
    return written(texts.select(text_id, F.array_distinct(found).alias("_ws")), "words").select(text_id, F.explode("_ws").alias("w"))


def _linked(each: DataFrame, text_id: str, spread: Callable[[Column], Column], pieces: DataFrame, head: Column, holds: Callable[[Column, Column], Column]) -> DataFrame:
    """``(text_id, piece)`` for the wanted pieces; each word of the whole vocabulary is cut up only once.

    Words are cut to the lengths that heads of pieces have, so a very long word costs its length times those few lengths;
    ``holds`` compares a word with the pieces of its heads.
    """
    asked = pieces.select("piece").distinct().select("piece", head.alias("_head")).filter(F.length("_head") > 0)
    lengths = asked.agg(F.array_sort(F.collect_set(F.length("_head"))).alias("_sizes"))  # one row
    vocabulary = each.select("w").distinct().crossJoin(lengths)
    fit = F.filter("_sizes", lambda n: n <= F.length("w"))
    cut = vocabulary.select("w", F.explode(F.array_distinct(spread(fit))).alias("_head"))
    wanted = cut.join(asked, "_head").filter(holds(F.col("w"), F.col("piece"))).select("w", "piece")
    return each.join(wanted, "w").select(text_id, "piece").distinct()


def held_whole(found: DataFrame, text_id: str, listed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(text_id, *keys)`` of the sets of pieces that a text holds whole.

    ``found`` has (text_id, piece), ``listed`` (keys, piece). A set meets a text only on its rarest piece; the others are
    looked up for those few, so a piece that stands in most sets joins nothing.
    """
    counts = found.groupBy("piece").agg(F.count("*").alias("_df"))
    ranked = listed.select(*keys, "piece").distinct().join(counts, "piece", "left")
    rarest = ranked.groupBy(*keys).agg(F.min_by("piece", F.struct(F.coalesce("_df", F.lit(0)), "piece")).alias("piece"), F.count("*").alias("_need"))
    near = found.join(rarest, "piece").select(text_id, *keys, "_need")
    each = near.join(listed.select(*keys, "piece").distinct(), list(keys)).join(found, [text_id, "piece"])
    return each.groupBy(text_id, *keys, "_need").agg(F.count("*").alias("_got")).filter("_got = _need").select(text_id, *keys)


def _split(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda w: w != "")


def word_prefixes(texts: DataFrame, text_id: str, text: Column, pieces: DataFrame, normal: bool = False) -> DataFrame:
    """Which of the pieces begin a word of each text; ``normal`` says that the texts are in normal form already."""
    n = text if normal else norm_text(text)
    if _few(pieces):
        usable = pieces.filter((F.col("piece") != "") & ~F.contains("piece", F.lit(" ")))
        return _searched(texts, text_id, F.concat(F.lit(" "), n), usable, F.concat(F.lit(" "), "piece"))
    heads = lambda sizes: F.transform(sizes, lambda k: F.left(F.col("w"), k))
    return _linked(_each(texts, text_id, _split(n)), text_id, heads, pieces, F.col("piece"), lambda w, piece: F.lit(True))


def word_substrings(texts: DataFrame, text_id: str, low: Column, pieces: DataFrame) -> DataFrame:
    """Which of the pieces lie within a word of each text."""
    if _few(pieces):
        return _searched(texts, text_id, low, pieces.filter(F.col("piece").rlike(r"(?U)\A\w+\z")), F.col("piece"))

    def of_length(n: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length("w") - n + 1), lambda i: F.substring(F.col("w"), i, n))

    each = _each(texts, text_id, F.regexp_extract_all(low, F.lit(r"(?U)\w+"), F.lit(0)))
    return _linked(each, text_id, lambda sizes: F.flatten(F.transform(sizes, of_length)), pieces, F.left("piece", F.lit(HEAD)), F.contains)


def whole_phrases(texts: DataFrame, text_id: str, normal: Column, pieces: DataFrame, size: int) -> DataFrame:
    """Which of the pieces, each of ``size`` words, stand in each text of normal form as whole words."""
    if _few(pieces):
        usable = pieces.filter(F.size(_split(F.col("piece"))) == size)
        return _searched(texts, text_id, F.concat(F.lit(" "), normal, F.lit(" ")), usable, F.concat(F.lit(" "), "piece", F.lit(" ")))
    w = _split(normal)
    runs = w if size == 1 else ngrams(w, size)
    return texts.select(text_id, F.explode(F.array_distinct(runs)).alias("piece")).join(pieces.select("piece").distinct(), "piece").select(text_id, "piece")


def _root(word: Column) -> Column:
    size = F.length(word)
    return F.when(size >= 6, F.left(word, size - 2)).otherwise(F.left(word, F.greatest(F.lit(3), size - 1)))


def dict_match_best(texts: DataFrame, text_id: str, text: Column, catalogue: DataFrame, entity: str, name: Column, latin: Column) -> DataFrame:
    """Best entity of each text by word roots and Latin names; ties give none.

    A Latin pair scores 10; the root of the first word 3 and each further root 2; a very short first word counts
    only with another root beside it, for 4.
    """
    named = catalogue.select(F.col(entity), F.filter(words(name), lambda w: F.length(w) > 2).alias("ws"), words(latin).alias("lat"))
    head = F.get("ws", F.lit(0))
    short = F.length(head) <= 3
    tails = F.slice("ws", 2, F.greatest(F.size("ws") - 1, F.lit(0)))
    roots = named.filter(F.size("ws") > 0).select(
        entity,
        short.alias("short"),
        F.explode(
            F.concat(
                F.array(F.struct(F.lit(0).alias("pos"), F.when(short, head).otherwise(_root(head)).alias("piece"))),
                F.transform(tails, lambda w, i: F.struct((i + 1).alias("pos"), F.when(short, F.left(w, F.lit(4))).otherwise(_root(w)).alias("piece"))),
            )
        ).alias("r"),
    )
    roots = roots.select(entity, "short", "r.pos", "r.piece")
    normal = written(texts.select(text_id, norm_text(text).alias("_n")), "normal")
    pieces = word_prefixes(normal, text_id, F.col("_n"), roots, normal=True)
    # a word must stand whole only where it is very short
    brief = roots.filter(F.col("short") & (F.col("pos") == 0))
    whole = whole_phrases(normal, text_id, F.col("_n"), brief, 1).withColumn("_whole", F.lit(True))
    found = pieces.join(roots, "piece").join(whole, [text_id, "piece"], "left")
    fits = F.when(F.col("short") & (F.col("pos") == 0), F.coalesce("_whole", F.lit(False))).otherwise(True)
    hit = found.filter(fits).groupBy(text_id, entity, "short").agg(F.max(F.when(F.col("pos") == 0, 1)).alias("_head"), F.countDistinct(F.when(F.col("pos") > 0, F.col("pos"))).alias("_more"))
    points = F.when(F.col("_head").isNull(), 0).when(F.col("short"), F.when(F.col("_more") > 0, 4).otherwise(0)).otherwise(3 + 2 * F.col("_more"))
    by_name = hit.select(text_id, entity, points.alias("score"))
    latins = named.filter(F.size("lat") >= 2).select(entity, F.array_join(F.slice("lat", 1, 2), " ").alias("piece"))
    by_latin = whole_phrases(normal, text_id, F.col("_n"), latins, 2).join(latins, "piece").select(text_id, entity, F.lit(10).alias("score"))
    best = by_name.unionByName(by_latin).groupBy(text_id, entity).agg(F.max("score").alias("score")).filter("score > 0")
    level = best.groupBy(text_id, "score").agg(F.count("*").alias("n"), F.min(entity).alias(entity))
    top = level.groupBy(text_id).agg(F.max_by(F.struct("n", entity, "score"), "score").alias("t"))
    return top.filter("t.n = 1").select(text_id, F.col(f"t.{entity}").alias(entity), "t.score")


def mention_join(texts: DataFrame, text_id: str, text: Column, catalogue: DataFrame, entity: str, name: Column) -> DataFrame:
    """Entities in a text: every stem of the name occurs, or one stem of five letters that no other name has."""

    def stem(w: Column) -> Column:
        return F.left(w, F.least(F.lit(6), F.greatest(F.lit(4), F.length(w) - 2)))

    stems = F.array_distinct(F.transform(F.filter(words(name), lambda w: F.length(w) >= 3), stem))
    listed = catalogue.select(F.col(entity), F.explode(stems).alias("piece"))
    alone = listed.filter(F.length("piece") >= 5).groupBy("piece").agg(F.count("*").alias("_n"), F.min(entity).alias(entity)).filter("_n = 1")
    found = cut_lineage(word_prefixes(texts, text_id, text, listed))
    sure = found.join(alone, "piece").select(text_id, entity)
    return held_whole(found, text_id, listed, [entity]).unionByName(sure).distinct()


def link_longest(texts: DataFrame, text_id: str, text: Column, catalogue: DataFrame, entity: str, name: Column) -> DataFrame:
    """Entity whose first two word stems all lie in the text; the longer list wins, the earliest on ties."""
    pair = F.slice(F.regexp_extract_all(F.lower(F.substring_index(name, "(", 1)), F.lit(r"(?U)\w+"), F.lit(0)), 1, 2)
    stems = F.array_distinct(F.transform(pair, lambda w: F.left(w, F.greatest(F.lit(4), F.length(w) - 2))))
    listed = catalogue.select(F.col(entity), F.size(pair).alias("n"), F.size(stems).alias("need"), F.explode(stems).alias("piece"))
    found = word_substrings(texts, text_id, F.lower(text), listed).join(listed, "piece")
    hit = found.groupBy(text_id, entity, "n", "need").agg(F.count("*").alias("got")).filter("got = need")
    return hit.groupBy(text_id).agg(F.max_by(F.col(entity), F.struct("n", -F.col(entity))).alias(entity))


def species_keys(latin: Column) -> Column:
    """``Genus species`` pairs of a Latin note; a lone genus where no species follows."""
    pattern = r"(?<!['\"‘’])\b([A-Z][a-z]+)(?:\s+(?!spp?\.)(?:x\s+)?([a-z][a-z-]{2,}))?"
    genus = F.regexp_extract_all(latin, F.lit(pattern), F.lit(1))
    species = F.regexp_extract_all(latin, F.lit(pattern), F.lit(2))
    return F.array_distinct(F.zip_with(genus, species, lambda g, s: F.trim(F.concat_ws(" ", F.lower(g), s))))


def plant_key(latin: Column) -> Column:
    """First two words when the second starts small, else the first."""
    w = F.regexp_extract_all(latin, F.lit("[A-Za-z-]+"), F.lit(0))
    second = F.get(w, F.lit(1))
    return F.when(second.rlike("^[a-z]"), F.concat_ws(" ", F.lower(F.get(w, F.lit(0))), F.lower(second))).otherwise(F.lower(F.get(w, F.lit(0))))


def binomial_or_genus(items: DataFrame, item: str, latin: Column, card: str, entities: DataFrame, entity: str, entity_latin: Column) -> DataFrame:
    """Entities of the same species, of the same genus when an item names only that, and the explicit card.

    Items meet the names first, each item and name once, and then the entities of the name, so the pairs are distinct as
    they are made. Only entities of several names, and cards that are no such pair, are compared with each other.
    """
    keys = items.select(item, F.explode(species_keys(latin)).alias("key")).distinct()
    named = entities.select(entity, plant_key(entity_latin).alias("key")).filter("key IS NOT NULL")
    own = named.groupBy(entity).agg(F.min("key").alias("key"), (F.min("key") != F.max("key")).alias("_more"))
    several = named.join(own.filter("_more").select(F.col(entity).alias("_several")), F.col(entity).eqNullSafe(F.col("_several")), "left_semi").distinct()
    names = named.select("key").distinct()
    same = keys.filter(F.contains(F.col("key"), F.lit(" "))).join(names, "key").select(item, "key")
    genera = keys.filter(~F.contains(F.col("key"), F.lit(" "))).withColumnRenamed("key", "_genus").join(names.withColumn("_genus", F.substring_index("key", " ", 1)), "_genus")
    wanted = same.unionByName(genera.select(item, "key")).distinct()
    pairs = own.filter("NOT _more").join(wanted, "key").select(item, entity)
    further = several.join(wanted, "key").select(item, entity)
    cards = items.select(item, F.col(card).alias(entity)).distinct().join(entities.select(entity).distinct(), entity).join(own, entity, "left")
    met = wanted.select(F.col(item).alias("_item"), F.col("key").alias("_key"))
    plain = cards.filter(~F.coalesce("_more", F.lit(False))).join(met, F.col(item).eqNullSafe(F.col("_item")) & (F.col("key") == F.col("_key")), "left_anti")
    further = further.unionByName(cards.filter("_more").select(item, entity)).distinct()
    return pairs.unionByName(further).unionByName(plain.select(item, entity))


def lookup_with_inflection(rows: DataFrame, row: str, name: str, latin: str, names: DataFrame, latins: DataFrame, entity: str, order: str) -> DataFrame:
    """Entity by Latin key, else by exact name, else by a name that differs only at its end.

    ``names`` holds ``(key, entity, order)``, ``latins`` holds ``(key, entity, order)``; the first entry wins.
    """

    def firsts(table: DataFrame, column: str) -> DataFrame:
        return table.groupBy("key").agg(F.min_by(entity, order).alias(column))

    r = rows.select(row, norm_text(F.col(name)).alias("_n"), F.col(latin).isNull().alias("_bare"), F.array_join(F.slice(F.split(F.lower(latin), r"\s+"), 1, 2), " ").alias("_l"))
    by_latin = r.join(firsts(latins, "_e1"), F.col("_l") == F.col("key"), "left").drop("key")
    by_name = by_latin.join(firsts(names, "_e2"), F.col("_n") == F.col("key"), "left").drop("key")
    size = F.length("key")
    heads = F.transform(F.sequence(F.greatest(F.lit(4), size - 5), F.least(size, size + 1)), lambda n: F.left(F.col("key"), n))
    # equal names and equal questions are one row each, so that what repeats does not multiply
    first = names.filter(size >= 6).groupBy("key").agg(F.min_by(entity, order).alias(entity), F.min(order).alias(order))
    loose = first.select("key", entity, order, F.explode(heads).alias("_head"))
    open_rows = by_name.filter(F.col("_e1").isNull() & F.col("_e2").isNull() & F.col("_bare") & (F.length("_n") >= 6)).select(row, "_n")
    asked = open_rows.select("_n").distinct().select("_n", F.left("_n", F.length("_n") - 2).alias("_head"))
    near = asked.join(loose, "_head").filter(F.abs(size - F.length("_n")) <= 3)
    answers = near.groupBy("_n").agg(F.min_by(entity, order).alias("_e"), F.min(order).alias("_o"))
    by_end = open_rows.join(answers, "_n").groupBy(row).agg(F.min_by("_e", "_o").alias("_e3"))
    return by_name.join(by_end, row, "left").select(row, F.coalesce("_e1", "_e2", "_e3").alias(entity))


def name_dictionary(names: DataFrame, entity: str, lang: str, name: str, head_first: Sequence[str]) -> DataFrame:
    """Names per language that mean one entity only: all words, or the head noun alone, with how sure they are."""
    w = F.filter(words(F.regexp_replace(F.col(name), r"\(.*?\)", " ")), lambda x: F.length(x) >= 3)
    base = names.select(entity, lang, w.alias("ws")).filter(F.size("ws") > 0)
    head = F.when(F.col(lang).isin(*head_first), F.get("ws", F.lit(0))).otherwise(F.element_at("ws", -1))

    def sure(word: Column) -> Column:
        return (F.length(word) >= 5) & ((F.col(lang) != "en") | (F.length(word) >= 7))

    full = base.select(entity, lang, "ws", F.when(F.size("ws") == 1, sure(F.get("ws", F.lit(0)))).otherwise(True).alias("sure"))
    heads = base.filter((F.size("ws") > 1) & (F.length(head) >= 5)).select(entity, lang, F.array(head).alias("ws"), sure(head).alias("sure"))
    g = full.unionByName(heads).groupBy(lang, "ws").agg(F.countDistinct(entity).alias("n"), F.min(entity).alias(entity), F.bool_or("sure").alias("sure"))
    return g.filter("n = 1").drop("n")


def _word_root(w: Column) -> Column:
    return F.when(F.length(w) <= 5, w).otherwise(F.left(w, F.greatest(F.lit(5), F.length(w) - 2)))


def foreign_mentions(texts: DataFrame, text_id: str, lang: str, text: Column, dictionary: DataFrame, entity: str) -> DataFrame:
    """Entities named in a text of the same language; sure when any of the matching names is."""
    roots = F.array_distinct(F.transform("ws", _word_root))
    d = dictionary.select(lang, entity, "sure", F.array_join("ws", " ").alias("_name"), F.explode(roots).alias("piece"))
    tagged = d.withColumn("piece", F.concat_ws("|", lang, "piece"))  # names meet texts of their language only
    pieces = word_prefixes(texts, text_id, text, d).join(texts.select(text_id, lang), text_id)
    found = cut_lineage(pieces.select(text_id, F.concat_ws("|", lang, "piece").alias("piece")))
    hit = held_whole(found, text_id, tagged, [lang, entity, "_name", "sure"])
    return hit.groupBy(text_id, entity).agg(F.bool_or("sure").alias("sure"))


def glossary(names: DataFrame, lang: str, name: str, target: str) -> DataFrame:
    """Source terms with one target only; short single words stay out."""
    size = F.length(name)
    single = ~F.contains(F.col(name), F.lit(" "))
    usable = (size <= 80) & ~(single & (size < F.when(F.col(lang) == "en", 7).otherwise(5)))
    low, goal = F.lower(name), F.lower(target)

    def cap(c: Column) -> Column:
        return F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, 2, 1000))

    forms = F.when(F.col(lang) == "de", F.array(F.struct(F.col(name).alias("term"), goal.alias("target")))).otherwise(
        F.array(F.struct(low.alias("term"), goal.alias("target")), F.struct(cap(low).alias("term"), cap(goal).alias("target")))
    )
    each = names.filter(usable).select(lang, F.inline(forms))
    return each.groupBy(lang, "term").agg(F.min("target").alias("target"), F.countDistinct("target").alias("n")).filter("n = 1").drop("n")


def pages_for_entity(pages: DataFrame, page: str, text: str, keys: DataFrame, entity: str, used: DataFrame, k: int) -> DataFrame:
    """Pages per entity by number of name occurrences, without those already used.

    ``keys`` holds ``(entity, key)`` in lower case; the first word of a key selects the pages to count in.
    """
    first = keys.select(entity, "key", F.regexp_extract("key", r"(?U)^(\w+)", 1).alias("piece")).distinct()
    near = word_substrings(pages, page, F.lower(text), first).join(first, "piece").select(page, entity, "key")
    # each page is put in lower case once, and looked through in full only for keys that it holds
    low = pages.select(page, F.lower(text).alias("_low"))
    held = near.join(low, page).filter(F.contains("_low", "key"))
    count = ((F.length("_low") - F.length(F.replace(F.col("_low"), F.col("key"), F.lit("")))) / F.length("key")).cast("long")
    sums = held.select(entity, page, count.alias("hits")).groupBy(entity, page).agg(F.sum("hits").alias("hits")).filter("hits > 0")
    sums = sums.join(used.select(entity, page).distinct(), [entity, page], "left_anti")
    return top_per_key(sums, [entity], [F.desc("hits"), F.asc(page)], k)


def alias_resolution(rows: DataFrame, name: Column, aliases: DataFrame, entity: str) -> DataFrame:
    """Resolved entity, known non-entity or unknown, by normal name."""
    a = aliases.select(F.col("name").alias("_alias"), F.col(entity), F.lit(True).alias("_known"))
    j = rows.withColumn("_alias", norm_text(name)).join(a, "_alias", "left")
    state = F.when(F.col("_known").isNull(), "unknown").when(F.col(entity).isNull(), "no_entity").otherwise("entity")
    return j.withColumn("state", state).drop("_alias", "_known")


def split_known(rows: DataFrame, known: DataFrame, key: str, hits: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a new key, and the known keys with their hit counters raised."""
    new = rows.join(known, key, "left_anti")
    seen = rows.join(known.select(key), key, "left_semi").groupBy(key).agg(F.count("*").alias("_more"))
    raised = known.join(seen, key, "left").withColumn(hits, F.col(hits) + F.coalesce("_more", F.lit(0))).drop("_more")
    return new, raised


def card_enrichment(parts: DataFrame, record: str, entity: str, part: str, cards: DataFrame) -> DataFrame:
    """Warnings of the cards of a record's entities, those of the used part after the general ones.

    ``parts`` are the ingredients of records; a record has few of them, so its warnings fit one row.
    """
    j = parts.join(cards, entity)
    own = F.array_compact(F.array(F.col("warning"), F.when(F.col(part) == F.col("card_part"), F.col("part_warning"))))
    each = j.select(record, F.posexplode(own).alias("pos", "text"), entity).groupBy(record, "text").agg(F.min(F.struct("pos", entity)).alias("o"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o", "text"))), lambda x: x["text"])
    return each.groupBy(record).agg(F.array_join(listed, " • ").alias("warnings"))


def task_outcomes(tasks: DataFrame, runs: DataFrame, task: str, run: str) -> DataFrame:
    """Tasks with the state of their run, its minutes and value; a lost run counts as failed.

    A finished run that was refused and wrote nothing is blocked.
    """
    j = tasks.join(runs, run, "left")
    refused = (F.col("refusals") > 0) & (F.col("written") == 0)
    state = F.when(F.col("status").isNull(), "failed").when((F.col("status") == "done") & refused, "blocked").otherwise(F.col("status"))
    minutes = F.greatest(F.lit(1.0), F.coalesce("minutes", F.lit(0.0)))
    return j.select(task, run, state.alias("state"), F.round(minutes, 6).alias("minutes"), F.coalesce("value", F.lit(0.0)).alias("value"))


def audit_compare(old: DataFrame, new: DataFrame, entity: str, k: int = 10) -> DataFrame:
    """Best and worst score changes between two audits, and new entities."""
    j = new.select(entity, F.col("score").alias("_new")).join(old.select(entity, F.col("score").alias("_old")), entity, "left")
    delta = j.filter("_old IS NOT NULL").select(entity, F.round(F.col("_new") - F.col("_old"), 6).alias("delta"))
    up = delta.filter("delta > 0").orderBy(F.desc("delta"), entity).limit(k).select(entity, F.lit("better").alias("change"), "delta")
    down = delta.filter("delta < 0").orderBy("delta", entity).limit(k).select(entity, F.lit("worse").alias("change"), "delta")
    fresh = j.filter("_old IS NULL").select(entity, F.lit("new").alias("change"), F.col("_new").alias("delta"))
    return up.unionByName(down).unionByName(fresh)


def quote_backfill(facts: DataFrame, fact: str, table: DataFrame, most: int = 300) -> DataFrame:
    """Missing quotes filled from the fact table, clipped at the end of a word."""
    source = table.select(fact, F.col("quote").alias("_q"))
    one = F.trim(F.regexp_replace("_q", r"\s+", " "))
    clipped = F.when(F.length(one) <= most, one).otherwise(F.concat(F.regexp_replace(F.left(one, F.lit(most)), r"\s+\S*$", ""), F.lit("…")))
    own = F.nullif(F.trim(F.coalesce("quote", F.lit(""))), F.lit(""))
    return facts.join(source, fact, "left").withColumn("quote", F.coalesce(own, clipped)).drop("_q")


def version_reviews(versions: DataFrame, reviews: DataFrame, root: str, text_hash: str, order: str) -> DataFrame:
    """Versions with the last review of the same text."""
    last = newest_per_key(reviews, [root, text_hash], [order])
    return versions.join(last, [root, text_hash], "left")


def merge_same_species(entities: DataFrame, entity: str, species: str, generated: Column, facts: DataFrame, fact: str, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """Generated entities fold into the hand-made one of their species; facts follow without repeats.

    Returns the map ``(entity, target)`` and the facts with their new entity.
    """
    hand = entities.filter(~generated).groupBy(species).agg(F.min(entity).alias("target"))
    moved = entities.filter(generated).join(hand, species).select(entity, "target")
    owned = facts.join(moved, entity, "left").withColumn("_to", F.coalesce("target", F.col(entity))).withColumn("_moved", F.col("target").isNotNull())
    first = owned.groupBy("_to", fingerprint).agg(F.min(F.struct("_moved", fact)).alias("_f"))
    kept = first.select(F.col(f"_f.{fact}").alias(fact), F.col("_to").alias(entity), fingerprint)
    return moved, kept


def reassign_facts(changed: DataFrame, entity: str, old_key: str, entities: DataFrame, key: str, facts: DataFrame, fact: str, fingerprint: str) -> DataFrame:
    """Facts of an entity whose species changed go to the entity of the old species, or are rejected if known there."""
    goal = entities.groupBy(F.col(key).alias(old_key)).agg(F.min(entity).alias("_to"))
    moving = changed.join(goal, old_key, "left").select(entity, "_to")
    f = facts.join(moving, entity)
    there = facts.select(F.col(entity).alias("_to"), fingerprint, F.lit(True).alias("_known")).distinct()
    j = f.join(there, ["_to", fingerprint], "left")
    state = F.when(F.col("_to").isNull() | F.col("_known"), "rejected").otherwise("moved")
    return j.select(fact, F.when(state == "moved", F.col("_to")).otherwise(F.col(entity)).alias(entity), state.alias("state"))


def unused_ideas(ideas: DataFrame, idea: str, posts: DataFrame, refs: str, prefix: str) -> DataFrame:
    """Ideas that no live post refers to; a post may list several behind one prefix."""
    listed = posts.filter(F.col(refs).startswith(prefix)).select(F.explode(F.split(F.regexp_replace(F.col(refs), "^" + prefix, ""), ",")).alias(idea))
    return ideas.join(listed.select(F.col(idea).cast(dict(ideas.dtypes)[idea])).distinct(), idea, "left_anti")


def request_key(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def split_cached(requests: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int, garbage: Column) -> DataFrame:
    """Each distinct request with its fresh answer, or marked to be executed."""
    fresh = cache.filter((F.col("at") >= now - F.expr(f"INTERVAL {ttl_seconds} SECONDS")) & ~garbage)
    last = newest_per_key(fresh.select("key", "at", "answer"), ["key"], ["at", "answer"])
    keys = requests.groupBy("key").agg(F.count("*").alias("requests"))
    return keys.join(last, "key", "left").select("key", "requests", "answer", F.col("answer").isNull().alias("execute"))


def encode_once(texts: DataFrame, key: str, cache: DataFrame, encode) -> DataFrame:
    """Vectors of all rows: each distinct text is encoded once and known ones are reused."""
    known = cache.select(key, "vector")
    missing = texts.join(known.select(key), key, "left_anti").dropDuplicates([key])
    return texts.join(known.unionByName(encode(missing).select(key, "vector")), key)


def name_rows(entities: DataFrame, entity: str, maps: dict[str, Column]) -> DataFrame:
    """Names per language from several map columns, as rows with the map they come from."""

    def tagged(label: str, names: Column) -> Column:
        return F.transform(F.map_entries(names), lambda e: F.struct(e["key"].alias("lang"), e["value"].alias("name"), F.lit(label).alias("source")))

    empty = F.array().cast("array<struct<lang:string,name:string,source:string>>")
    parts = F.flatten(F.array(*[F.coalesce(tagged(label, m), empty) for label, m in maps.items()]))
    return entities.select(entity, F.inline(parts)).filter("name <> ''")


def new_ideas(facts: DataFrame, fact: str, wanted: Column, ideas: DataFrame, key: str) -> DataFrame:
    """Facts of chosen sections that are no idea yet, keyed by the fact."""
    rows = facts.filter(wanted).withColumn(key, F.concat(F.lit("fact:"), F.col(fact).cast("string")))
    return rows.join(ideas.select(key), key, "left_anti")


def first_word_match(rows: DataFrame, row: str, name: Column, entities: DataFrame, entity: str, entity_name: Column, order: str) -> DataFrame:
    """First entity with the same name or the same first word."""
    n = norm_text(name)
    e = entities.select(entity, order, F.substring_index(norm_text(entity_name), " ", 1).alias("_w"))
    firsts = e.groupBy("_w").agg(F.min_by(entity, order).alias(entity))
    return rows.select(row, F.substring_index(n, " ", 1).alias("_w")).join(firsts, "_w", "left").select(row, entity)


def resolve_numbers(points: DataFrame, numbers: str, sources: Column) -> DataFrame:
    """Source numbers of a point replaced by the named sources of its record; unknown numbers drop out."""
    table = F.map_from_entries(sources)
    return points.withColumn(numbers, F.array_compact(F.transform(numbers, lambda n: F.try_element_at(table, n))))


def about_entity(text: Column, latin: Column, name: Column) -> Column:
    """A normal text is about an entity: its Latin genus, its name, or nearly all long stems of the name.

    All three are normal forms, so that each text is normalised once and not once per entity.
    """
    genus = F.substring_index(latin, " ", 1)

    def begins(w: Column) -> Column:
        return F.startswith(text, w) | F.contains(text, F.concat(F.lit(" "), w))

    long = F.filter(F.split(name, " "), lambda w: F.length(w) >= 4)
    found = F.size(F.filter(long, lambda w: begins(F.left(w, F.lit(5)))))
    by_stems = (F.size(long) >= 1) & (found >= F.greatest(F.lit(1), F.size(long) - 1))
    return ((F.length(genus) >= 4) & begins(genus)) | F.contains(text, name) | by_stems
