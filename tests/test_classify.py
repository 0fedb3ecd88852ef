"""The rule cascade for pages on literal pages."""

import json

from pyspark.sql import functions as F

from florilege.operators import classify as C
from tests.test_pages import JSONLD, LOREM


def recipe_html(name, jsonld=None):
    ld = f'<script type="application/ld+json">{jsonld}</script>' if jsonld else ""
    return f"""<html lang="en"><head><title>{name}</title>{ld}</head><body><article>
    <h1>{name}</h1><p>A traditional herbal remedy with nettle and elder flower. {LOREM}</p>
    <h2>Ingredients</h2><ul><li>2 cups fresh nettle leaves</li><li>1 tbsp honey</li><li>500 ml water</li></ul>
    <h2>Instructions</h2><ol><li>Boil the water.</li><li>Steep the herb for 10 minutes.</li></ol>
    <a href="/recipes/">All recipes</a></article></body></html>"""


PRODUCT = json.dumps([{"@type": "ItemList", "itemListElement": [{"@type": ["Thing", "Offer"]}]}])
DISH = json.dumps({"@graph": [{"mainEntity": {"@type": "Recipe", "name": "Soup cake soup", "description": "soup"}}]})
ARTICLE = f"<html><body><h1>On nettle</h1><p>{LOREM}</p></body></html>"
PAGES = {
    "https://herbs.example/r": (recipe_html("Nettle Soup", JSONLD), ("recipe", "jsonld", 1.0, "Nettle Soup")),
    "https://herbs.example/d": (recipe_html("Dandelion Tea"), ("recipe", "heuristic", 0.79, "Dandelion Tea")),
    "https://herbs.example/shop": ("<html><head><title>Shop</title></head><body><h1>Buy seeds</h1><p>Cheap seeds, discount.</p></body></html>", ("other", "heuristic", 0.8, "Buy seeds")),
    "https://herbs.example/offer": (recipe_html("Offer", PRODUCT), ("other", "heuristic", 0.9, "Offer")),
    "https://herbs.example/dish": (f'<script type="application/ld+json">{DISH}</script><h1>Dish</h1>', ("other", "jsonld", 0.9, "Soup cake soup")),
    "https://herbs.example/p/5901234123457": (ARTICLE, ("other", "heuristic", 0.85, "On nettle")),
    "https://herbs.example/p/59012341234571": (ARTICLE, ("fact", "heuristic", 0.6, "On nettle")),
    "https://herbs.example/cart": (ARTICLE.replace("<p>", "<p>Dodaj do koszyka: 12,50 zł "), ("other", "heuristic", 0.85, "On nettle")),
    "https://herbs.example/blog": (ARTICLE.replace("<h1>", "<h2>x</h2>" * 6 + "<h1>").replace("<p>", "<p>ADD TO CART $ 12.50 "), ("fact", "heuristic", 0.6, "On nettle")),
    "https://herbs.example/null": (None, ("other", "heuristic", 0.8, "https://herbs.example/null")),
}


def signals(spark, pages):
    df = spark.createDataFrame([(u, h) for u, h in pages.items()], "url string, html string").withColumn("page", F.col("url"))
    return C.page_signals(df, "page", "url", "html", ["nettle", "herb"], ["=tea", "folk", "remed"], ["soup", "cake"])


def test_kinds(spark):
    got = {r.page: (r.kind, r.method, r.confidence, r.title) for r in C.classify_pages(signals(spark, {u: h for u, (h, _) in PAGES.items()}), "page", C.page_rules()).collect()}
    assert got == {u: want for u, (_, want) in PAGES.items()}


def test_models_and_answers(spark):
    """Unclear pages: the model's gate, an answer, a fallback, a page that waits; corrections of recipes without amounts."""
    unclear = f"<html><body><p>{LOREM[:900]}</p>%s</body></html>"
    links = "".join(f"<a href='/{i}'>x</a>" for i in range(60))
    rows = {
        "https://a/use": ("", ("fact", 0.9, True, False), None, ("fact", 0.9, "model")),
        "https://a/list": (links, ("recipe", 0.9, True, False), None, ("other", 0.7, "model")),
        "https://a/bare": ("", ("recipe", 1.4, True, False), None, ("fact", 1.0, "model")),
        "https://a/amount": ("2 cups water", ("recipe", 0.8, True, False), None, ("recipe", 0.8, "model")),
        "https://a/answer": ("", ("fact", 0.9, False, True), ("other", 0.6, "Culinary thing", "m1"), ("other", 0.6, "answer:m1")),
        "https://a/odd": ("", None, ("poem", None, None, "m1"), ("other", 0.5, "answer:m1")),
        "https://a/fallback": ("", ("fact", 0.6, False, True), None, ("fact", 0.6, "model")),
        "https://a/no": ("", ("other", 0.6, False, True), None, ("other", 0.3, "deferred")),
    }
    more = spark.createDataFrame([(u, m, a) for u, (_, m, a, _) in rows.items()], "p string, gate struct<label:string,confidence:double,use:boolean,fallback:boolean>, said struct<label:string,confidence:double,reason:string,model:string>")
    given = signals(spark, {u: unclear % tail for u, (tail, *_) in rows.items()}).join(more, F.col("page") == F.col("p")).withColumn("topic", F.lit(0.1))
    got = C.classify_pages(given, "page", C.page_rules(model="gate", answer="said", asked=F.lit(True))).collect()
    assert {r.page: (r.kind, r.confidence, r.method) for r in got} == {u: want for u, (*_, want) in rows.items()}
    assert {r.page: r.reason for r in got}["https://a/answer"] == "dish"
