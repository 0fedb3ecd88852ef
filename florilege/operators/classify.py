"""Ordered rules with reasons, and the kind of a page by them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions import rules
from florilege.functions.text import hits, is_culinary, plain_words, quantity_hits, recipe_score, topic_score
from florilege.functions.urls import path
from florilege.session import cut_lineage
from florilege.sources.html import extract_pages, flatten_jsonld


@dataclass(frozen=True)
class Rule:
    """What a row is where ``when`` holds and no rule before it did."""

    when: Column
    label: Column | str
    confidence: Column | float
    method: Column | str
    reason: Column | str


def _col(value: Column | str | float) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def first_rule(ordered: Sequence[Rule], names: Sequence[str] = ("label", "confidence", "method", "reason")) -> Column:
    """The outcome of the first rule whose condition holds (NULL is not holding), as one struct with the rule's number."""
    hit = [F.when(F.coalesce(r.when, F.lit(False)), F.struct(*[_col(v).cast(kind).alias(n) for n, v, kind in zip(names, (r.label, r.confidence, r.method, r.reason), ("string", "double", "string", "string"), strict=True)], F.lit(i).alias("rule"))) for i, r in enumerate(ordered)]
    return F.coalesce(*hit)


#: JSON-LD types of a product page, the number of headings from which a page with a cart is an article.
PRODUCT_TYPES = ("Product", "Offer", "AggregateOffer")
SHOP_HEADINGS = 6
#: A list of recipes by its links or items, the text from which a page has content, and an article.
LIST_LINKS, LIST_ITEMS, LEAST_TEXT, ARTICLE_TEXT = 60, 25, 300, 1200


#: What a recipe says of itself.
TOLD = ("recipeCategory", "recipeCuisine", "keywords")


def _told(key: str) -> Column:
    return F.coalesce(F.array_join(F.try_variant_get("node", f"$.{key}", "array<string>"), " "), F.try_variant_get("node", f"$.{key}", "string"))


def is_shop_page(url: Column, headings: Column, text: Column) -> Column:
    """A product page by its address (13 digits), or by a cart and a price at the top with few headings."""
    top = F.left(text, F.lit(6000))
    return path(url).rlike(rules.EAN) | ((F.size(headings) <= SHOP_HEADINGS) & top.rlike(rules.CART) & top.rlike(rules.PRICE))


def page_signals(pages: DataFrame, page: str, url: str, html: str, keywords: Sequence[str], purpose: Sequence[str], dishes: Sequence[str], dish_categories: Sequence[str] = ()) -> DataFrame:
    """What the rules look at, one row per page: text and its sizes, scores, shop signs, and what JSON-LD of any depth says.

    ``purpose`` and ``dishes`` are word stems, counted in title, headings, the recipe's own words and the top of the text; a
    recipe category of ``dish_categories`` counts three times.
    """
    read = cut_lineage(extract_pages(pages, page, url, html))
    nodes = flatten_jsonld(read.select(page, F.posexplode("jsonld").alias("_script", "_ld")), [page, "_script"], "_ld")
    types = F.coalesce(F.try_variant_get("node", "$['@type']", "array<string>"), F.array(F.try_variant_get("node", "$['@type']", "string")))
    told = nodes.select(F.col(page).alias("_page"), "_script", "place", types.alias("t"), F.try_variant_get("node", "$.name", "string").alias("name"), *[_told(k).alias(k) for k in TOLD])
    recipe = F.array_contains(F.transform("t", F.lower), "recipe")
    first = F.min_by(F.struct(F.lit(True).alias("there"), F.coalesce("name", F.lit("")).alias("name"), F.concat_ws(" ", *TOLD).alias("told"), F.col(TOLD[0]).alias("category")), F.when(recipe, F.struct("_script", "place")))
    told = told.groupBy("_page").agg(F.bool_or(F.arrays_overlap("t", F.array(*[F.lit(t) for t in PRODUCT_TYPES]))).alias("product"), F.bool_or(recipe).alias("has_recipe"), first.alias("_first"))
    both = read.join(told, F.col(page) == F.col("_page"), "left")
    node = F.coalesce("has_recipe", F.lit(False))
    name = F.when(node, F.nullif(F.col("_first.name"), F.lit("")))
    words = plain_words(F.concat_ws(" ", "title", F.array_join(F.slice("headings", 1, 20), " "), name, F.col("_first.told"), F.left("text", F.lit(3000))))
    category = F.when(hits(plain_words(F.col("_first.category")), dish_categories) > 0, 3).otherwise(0) if dish_categories else F.lit(0)
    return both.select(
        page, url, F.coalesce(F.nullif("title", F.lit("")), F.col(url)).alias("title"), "text", F.size("links").alias("links"), F.size("items").alias("items"),
        F.coalesce("product", F.lit(False)).alias("product"), node.alias("recipe_node"), name.alias("recipe_name"),
        is_shop_page(F.col(url), F.col("headings"), F.col("text")).alias("shop"),
        recipe_score(F.col("headings"), F.col("items"), F.col("text"), rules.INGREDIENT_HEADINGS, rules.STEP_HEADINGS).alias("recipe"),
        topic_score(F.col("title"), F.col("text"), keywords).alias("topic"),
        hits(words, purpose).alias("purpose"), (hits(words, dishes) + category).alias("dishes"), quantity_hits(F.col("text")).alias("amounts"),
    )


def _corrected(when: Column, label: Column, confidence: Column, method: Column | str, reason: Column) -> list[Rule]:
    """A model's word: a recipe without any part or amount is a list where the page is one, else an article."""
    bare = (label == "recipe") & (F.col("recipe") == 0) & (F.col("amounts") == 0)
    listed = (F.col("links") >= LIST_LINKS) | (F.col("items") >= LIST_ITEMS)
    sure = F.round(F.least(F.greatest(confidence.cast("double"), F.lit(0.0)), F.lit(1.0)), 2)
    return [
        Rule(when & bare & listed, "other", 0.7, method, "list of recipes: no ingredients or amounts"),
        Rule(when & bare, "fact", sure, method, "article without amounts"),
        Rule(when, label, sure, method, F.left(reason, F.lit(200))),
    ]


def page_rules(skip_dishes: bool = True, model: str | None = None, answer: str | None = None, asked: Column | None = None) -> list[Rule]:
    """The cascade for ``page_signals``: product, JSON-LD, shop, dish, recipe, no content, model, answer, then weak signs.

    ``model`` names a struct (label, confidence, use, fallback): its gate's word is one layer, and below the answers of an
    outside model it is a fallback, but not for ``other``. ``answer`` names a struct (label, confidence, reason, model);
    ``asked`` tells that an answer was asked for and none came, so the page waits for another look.
    """
    dish = is_culinary(F.col("purpose"), F.col("dishes")) if skip_dishes else F.lit(False)
    recipe, topic, chars = F.col("recipe"), F.col("topic"), F.length("text")
    found = [
        Rule(F.col("product") & ~F.col("recipe_node"), "other", 0.9, "heuristic", "product page"),
        Rule(F.col("recipe_node") & dish, "other", 0.9, "jsonld", "dish"),
        Rule(F.col("recipe_node"), "recipe", 1.0, "jsonld", "schema.org/Recipe"),
        Rule((recipe < 0.45) & F.col("shop"), "other", 0.85, "heuristic", "product page: cart and price, or number in the address"),
        Rule((recipe >= 0.45) & dish, "other", 0.8, "heuristic", "dish"),
        Rule(recipe >= 0.7, "recipe", F.round(recipe, 2), "heuristic", "ingredients, steps and amounts"),
        Rule((chars < LEAST_TEXT) | ((topic == 0) & (recipe < 0.3)), "other", 0.8, "heuristic", "no content or topic"),
    ]
    if model is not None:
        m = F.col(model)
        found += _corrected(m["use"], m["label"], m["confidence"], "model", F.concat(F.lit("model: "), m["label"]))
    if answer is not None:
        a = F.col(answer)
        label = F.when(a["label"].isin("recipe", "fact", "other"), a["label"]).otherwise("other")
        reason = F.when((label == "other") & F.lower(a["reason"]).startswith("culinary"), "dish").otherwise(F.coalesce(a["reason"], F.lit("")))
        found += _corrected(a["label"].isNotNull(), label, F.coalesce(a["confidence"], F.lit(0.5)), F.concat(F.lit("answer:"), a["model"]), reason)
    if model is not None:
        m = F.col(model)
        found += _corrected(m["fallback"] & (m["label"] != "other"), m["label"], m["confidence"], "model", F.concat(F.lit("model, no answer: "), m["label"]))
    found += [
        Rule(recipe >= 0.45, "recipe", recipe, "heuristic", "likely recipe"),
        Rule((topic >= 0.5) & (chars > ARTICLE_TEXT), "fact", F.round(topic * 0.6, 2), "heuristic", "article on the topic"),
    ]
    if asked is not None:
        found.append(Rule(asked, "other", 0.3, "deferred", "unclear, no answer yet"))
    return [*found, Rule(F.lit(True), "other", 0.5, "heuristic", "unclear")]


def classify_pages(signals: DataFrame, page: str, ordered: Sequence[Rule]) -> DataFrame:
    """(page, title, kind, confidence, method, reason, rule): the first rule that holds for each page."""
    hit = signals.withColumn("_hit", first_rule(ordered))
    title = F.when(F.col("_hit.method") == "jsonld", F.coalesce("recipe_name", "title")).otherwise(F.col("title"))
    return hit.select(page, title.alias("title"), F.col("_hit.label").alias("kind"), "_hit.confidence", "_hit.method", "_hit.reason", "_hit.rule")


