"""Pages from HTML: columns and rows over the node table of :mod:`florilege.sources.dom`."""

from __future__ import annotations

import html as entities
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from florilege.functions.text import let
from florilege.functions.urls import absolute, normalize_url, site_key
from florilege.session import cut_lineage
from florilege.sources import dom as D

#: A shell that scripts fill: much markup, next to no text, many scripts.
SHELL_HTML, SHELL_TEXT, SHELL_SCRIPTS = 30_000, 250, 10


def extract_pages(pages: DataFrame, page: str, url: str, html: str) -> DataFrame:
    """Title, language, canonical address, main text, headings, list items, JSON-LD, links and feeds of each page.

    The first heading that is not empty is the title before the title element. ``needs_script`` marks pages whose
    text scripts would have to build.
    """
    sized = pages.select(page, url, html, F.length(html).alias("_chars"))
    trees = D.parse_trees(sized, [page, url, "_chars"], html)
    text = lambda n: D.clean(D.text_of(n))
    attr = lambda n, name: F.try_element_at(n["attrs"], F.lit(name))
    first = lambda tag: text(F.get(D.tagged(tag), F.lit(0)))
    links = F.filter(D.tagged("a"), lambda n: F.coalesce(attr(n, "href"), F.lit("")) != "")
    rel = lambda name: F.filter(D.tagged("link"), lambda n: F.array_contains(F.split(F.lower(F.coalesce(attr(n, "rel"), F.lit(""))), r"\s+"), name) & (F.coalesce(attr(n, "href"), F.lit("")) != ""))
    full = lambda n: normalize_url(absolute(attr(n, "href"), F.col(url)))
    feeds = F.transform(F.filter(rel("alternate"), lambda n: F.coalesce(attr(n, "type"), F.lit("")).contains("xml")), full)
    rows = trees.select(
        page,
        url,
        F.coalesce(F.nullif(first("h1"), F.lit("")), first("title"), F.lit("")).alias("title"),
        F.nullif(attr(F.get(D.tagged("html"), F.lit(0)), "lang"), F.lit("")).alias("lang"),
        full(F.get(rel("canonical"), F.lit(0))).alias("canonical"),
        D.main_text().alias("text"),
        F.transform(D.tagged("h1", "h2", "h3", "h4"), text).alias("headings"),
        F.transform(D.tagged("li"), text).alias("items"),
        F.filter("jsonld", lambda x: F.try_parse_json(_spoken(x)).isNotNull()).alias("jsonld"),
        F.transform(links, lambda n: F.struct(attr(n, "href").alias("href"), F.left(text(n), F.lit(120)).alias("anchor"))).alias("links"),
        F.array_compact(feeds).alias("feeds"),
        F.size(D.tagged("script")).alias("scripts"),
        F.coalesce("_chars", F.lit(0)).alias("html_chars"),
    )
    shell = (F.col("html_chars") > SHELL_HTML) & (F.length("text") < SHELL_TEXT) & (F.col("scripts") > SHELL_SCRIPTS)
    return rows.withColumn("needs_script", shell)


def link_edges(extracted: DataFrame, page: str, url: str) -> DataFrame:
    """Edges from page to normalized link with anchor and same-site flag."""
    each = extracted.select(page, F.col(url).alias("from_url"), F.inline("links"))
    to = normalize_url(absolute(F.col("href"), F.col("from_url")))
    e = each.withColumn("to_url", to).filter("to_url IS NOT NULL")
    return e.select(page, "from_url", "to_url", "anchor", (site_key(F.col("from_url")) == site_key(F.col("to_url"))).alias("same_site"))


def link_depths(edges: DataFrame, seeds: DataFrame, url: str, most: int) -> DataFrame:
    """Least number of links from a seed to each address, level by level up to a depth."""
    seen = cut_lineage(seeds.select(F.col(url).alias("url")).distinct().withColumn("depth", F.lit(0)))
    steps = cut_lineage(edges.select("from_url", "to_url").distinct())
    level = seen
    for depth in range(1, most + 1):
        nxt = steps.join(level.select(F.col("url").alias("from_url")), "from_url").select(F.col("to_url").alias("url")).distinct()
        level = cut_lineage(nxt.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = cut_lineage(seen.unionByName(level))
    return seen


def apply_profiles(pages: DataFrame, page: str, url: str, html: str, rules: DataFrame, prefer_jsonld: bool = True) -> DataFrame:
    """Fields of each page by the profile of its site (see :func:`florilege.sources.dom.profile_fields`), and its ``mode``.

    With ``prefer_jsonld`` a complete recipe in the page's JSON-LD goes before the selectors, as mode ``jsonld``.
    """
    trees = D.parse_trees(pages.withColumn("_site", site_key(F.col(url))), [page, "_site"], html)
    trees = cut_lineage(trees)  # read twice: by selectors and by JSON-LD
    fields = D.profile_fields(trees, page, "_site", rules)
    if not prefer_jsonld:
        return fields
    told = recipe_from_jsonld(trees.select(page, F.posexplode("jsonld").alias("_script", "_ld")), page, "_ld", order="_script")
    best = told.where("complete").groupBy(F.col(page).alias("_page")).agg(F.min_by(F.struct(*[told[f] for f in ("title", "description", "ingredients", "steps", "image", "yield", "total_time")]), F.struct("script", "place")).alias("_told"))
    both = fields.join(best, F.col(page) == F.col("_page"), "left")
    told_field = lambda f: F.when(F.col("_told").isNotNull(), F.col(f"_told.{f}")).otherwise(F.col(f)).alias(f)
    kept = [told_field(f) if f in best.schema["_told"].dataType.names else F.col(f) for f in D.FIELDS]
    return both.select(page, *kept, F.when(F.col("_told").isNotNull(), "jsonld").otherwise(F.col("mode")).alias("mode"), "fact")


#: Selectors of common recipe plugins, and containers of an article's text in order.
PLUGIN_FIELDS = {
    "wprm": {"title": ".wprm-recipe-name", "ingredients": ".wprm-recipe-ingredient", "steps": ".wprm-recipe-instruction-text", "yield": ".wprm-recipe-servings", "notes": ".wprm-recipe-notes"},
    "tasty": {"title": ".tasty-recipes-title", "ingredients": ".tasty-recipes-ingredients li", "steps": ".tasty-recipes-instructions li", "notes": ".tasty-recipes-notes"},
    "mv": {"title": ".mv-create-title", "ingredients": ".mv-create-ingredients li", "steps": ".mv-create-instructions li", "notes": ".mv-create-notes"},
}
CONTENT_CSS = ("article .entry-content", ".entry-content", ".post-content", ".article-content", ".article-body", "article", "main")


def rule_search(pages: DataFrame, page: str, site: str, html: str, plugins: dict[str, dict[str, str]] | None = None, containers: Sequence[str] = CONTENT_CSS) -> DataFrame:
    """(site, rule, fields, css, pages, coverage, passes): ready-made field sets tried on all pages of each site.

    A plugin's set is tried where its first selector's mark stands in any page of the site; ``css`` is the first container
    with enough text on all pages of the site and is part of every set, ``content`` being the set of it and the title alone.
    ``coverage`` is the share of pages with a complete record or an article; at least two thirds pass.
    """
    plugins = PLUGIN_FIELDS if plugins is None else plugins
    spark = pages.sparkSession
    trees = cut_lineage(D.parse_trees(pages.select(page, site, html), [page, site], html))
    sizes = trees.groupBy(F.col(site).alias("_site")).agg(F.count("*").alias("pages"))
    # one record per page and container: the first element of each decides
    held = D.select(trees, page, site, D.rule_table(spark, [(None, css, css, None) for css in containers]))
    first = held.groupBy(page, "css").agg(F.min_by("value", "node").alias("_text"))
    enough = first.where(F.length(D.clean(F.col("_text"))) >= D.ARTICLE_CHARS)
    own = trees.select(F.col(page).alias("_page"), F.col(site).alias("_site"))
    rank = F.array_position(F.array(*[F.lit(c) for c in containers]), F.col("css"))
    full = enough.join(own, F.col(page) == F.col("_page")).groupBy("_site", "css").agg(F.count("*").alias("_n"))
    content = full.join(sizes, "_site").where("_n = pages").groupBy("_site").agg(F.min_by("css", rank).alias("css"))
    fields = [(None, f"{name}:{f}", css, None) for name, of in plugins.items() for f, css in of.items()] + [(None, "content:title", "h1", None)]
    got = D.select(trees, page, site, D.rule_table(spark, fields))
    hit = got.where(F.length(D.clean(F.col("value"))) > 0).groupBy(page).agg(F.collect_set("field").alias("_hits"))
    marks = [(name, next(iter(of.values())).split()[0].lstrip(".")) for name, of in plugins.items()]
    marked = pages.select(F.col(site).alias("_site"), *[F.col(html).contains(mark).alias(name) for name, mark in marks])
    marked = marked.groupBy("_site").agg(*[F.bool_or(name).alias(name) for name, _ in marks])
    sets = marked.select("_site", F.explode(F.array_compact(F.array(*[F.when(F.col(name), name) for name, _ in marks], F.lit("content")))).alias("rule"))
    tried = sets.join(content, "_site", "left").where("rule <> 'content' OR css IS NOT NULL")
    seen = own.join(hit, own["_page"] == hit[page], "left").select("_page", "_site", F.coalesce("_hits", F.array().cast("array<string>")).alias("_hits"))
    has = lambda f: F.array_contains("_hits", F.concat("rule", F.lit(f":{f}")))
    article = has("title") & F.col("css").isNotNull()
    done = seen.join(tried, "_site").withColumn("_ok", (has("title") & has("ingredients") & has("steps")) | article)
    n = done.groupBy(F.col("_site").alias(site), "rule", "css").agg(F.count("*").alias("pages"), F.count(F.when(F.col("_ok"), 1)).alias("complete"))
    return n.select("*", (F.col("complete") / F.col("pages")).alias("coverage"), (F.col("complete") * 100 >= F.col("pages") * 67).alias("passes"))


def request_table(rows: DataFrame, purpose: str, prompt: Column) -> DataFrame:
    """Requests to an outside model as data: a key from purpose and prompt."""
    r = rows.select(prompt.alias("prompt")).distinct().withColumn("purpose", F.lit(purpose))
    return r.select(F.sha2(F.to_json(F.struct("purpose", "prompt")), 256).alias("key"), "purpose", "prompt")


def answer_requests(requests: DataFrame, answer=None) -> DataFrame:
    """Requests with their answers from an injected function; without one they stay pending."""
    if answer is None:
        return requests.withColumn("answer", F.lit(None).cast("string")).withColumn("state", F.lit("pending"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(answer=[answer(p) for p in b["prompt"]], state="answered")

    return requests.mapInPandas(run, "key string, purpose string, prompt string, answer string, state string")


def join_answers(requests: DataFrame, responses: DataFrame, problem: Callable[[Column], Column]) -> DataFrame:
    """(*requests, answer, version, state, problem): each request with its newest answer that passes the check.

    ``responses`` hold ``(key, version, answer)``, any number of versions per key; answers to no request are left out. ``problem``
    says what is wrong with an answer, NULL for nothing. A request whose answers all fail is ``rejected`` with the newest
    one's problem, so it can be asked again; one without an answer stays ``pending``.
    """
    told = responses.where(F.col("answer").isNotNull()).select("key", "version", "answer", problem(F.col("answer")).alias("problem"))
    rank = F.struct(F.col("problem").isNull(), "version", "answer")
    best = told.groupBy("key").agg(F.max_by(F.struct("answer", "version", "problem"), rank).alias("_a"))
    state = F.when(F.col("_a").isNull(), "pending").when(F.col("_a.problem").isNull(), "answered").otherwise("rejected")
    kept = F.when(state == "answered", F.col("_a.answer"))
    return requests.join(best, "key", "left").select(*requests.columns, kept.alias("answer"), F.when(state == "answered", F.col("_a.version")).alias("version"), state.alias("state"), F.col("_a.problem").alias("problem"))


def carry_over(requests: DataFrame, before: DataFrame) -> DataFrame:
    """The requests that are new or still open: those an earlier round answered are not asked again."""
    return requests.join(before.where("state = 'answered'").select("key"), "key", "left_anti")


def _spoken(json: Column) -> Column:
    """JSON text whose strings may hold raw control characters."""
    return F.regexp_replace(json, "[\\x00-\\x1f]", " ")


def _items(value: Column) -> Column:
    """Elements of a variant list, or the value alone."""
    return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array(value))


def _is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


#: Keys below which a node of JSON-LD holds further nodes.
NESTED = ("@graph", "mainEntity", "itemListElement")


def flatten_jsonld(rows: DataFrame, keep: Sequence[str], jsonld: str) -> DataFrame:
    """(*keep, place, node): every object of each JSON-LD text, those below a graph, main entity or item list too, at any depth.

    One round per level, until no object is left; ``place`` orders the nodes of a text as they stand in it. Broken
    JSON gives nothing.
    """
    doc = F.try_parse_json(_spoken(F.col(jsonld)))
    level = rows.select(*keep, doc.alias("_v")).where("_v IS NOT NULL").select(*keep, F.array().cast("array<int>").alias("place"), "_v")
    done: DataFrame | None = None
    while True:
        # lists of lists come apart at once with their own places
        each = level.select(*keep, "place", F.posexplode(_items(F.col("_v"))).alias("_i", "_n")).where("_n IS NOT NULL")
        each = cut_lineage(each.select(*keep, F.concat("place", F.array("_i")).alias("place"), F.col("_n").alias("node")))
        nodes = each.where(_is_object(F.col("node")))
        lists = each.where(F.schema_of_variant("node").startswith("ARRAY")).select(*keep, "place", F.col("node").alias("_v"))
        done = nodes if done is None else done.unionByName(nodes)
        inner = F.array(*[F.struct(F.lit(i).alias("i"), F.try_variant_get("node", f"$['{k}']", "variant").alias("v")) for i, k in enumerate(NESTED)])
        below = nodes.select(*keep, "place", F.explode(inner).alias("b")).where("b.v IS NOT NULL").select(*keep, F.concat("place", F.array("b.i")).alias("place"), F.col("b.v").alias("_v"))
        level = cut_lineage(below.unionByName(lists))
        if level.isEmpty():
            return done


@F.pandas_udf(StringType())
def _without_entities(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: entities.unescape(t) if t is not None and "&" in t else t)


def _step_texts(rows: DataFrame, keep: Sequence[str], steps: str) -> DataFrame:
    """(*keep, steps): texts of instructions: a text cut at lines and numbers, lists, steps, and sections of steps at any depth."""
    level = rows.select(*keep, F.array().cast("array<int>").alias("at"), F.col(steps).alias("_v")).where("_v IS NOT NULL")
    done: DataFrame | None = None
    while True:
        each = level.select(*keep, "at", F.posexplode(_items(F.col("_v"))).alias("_i", "_n")).where("_n IS NOT NULL")
        each = cut_lineage(each.select(*keep, F.concat("at", F.array("_i")).alias("at"), F.col("_n").alias("_n")))
        inner = F.try_variant_get("_n", "$.itemListElement", "variant")
        kind = F.schema_of_variant("_n")
        spoken = lambda k: F.nullif(F.try_variant_get("_n", f"$.{k}", "string"), F.lit(""))
        told = F.when(kind == "STRING", F.try_variant_get("_n", "$", "string")).when(kind.startswith("OBJECT") & inner.isNull(), F.coalesce(spoken("text"), spoken("name")))
        leaf = each.select(*keep, "at", told.alias("_t"), (kind == "STRING").alias("_plain")).where("_t IS NOT NULL")
        done = leaf if done is None else done.unionByName(leaf)
        below = F.when(kind.startswith("ARRAY"), F.col("_n")).when(kind.startswith("OBJECT"), inner)
        level = cut_lineage(each.select(*keep, "at", below.alias("_v")).where("_v IS NOT NULL"))
        if level.isEmpty():
            break
    read = done.withColumn("_t", _without_entities("_t"))
    # the break before "2." or "2)" leaves the number with its step
    parts = F.when(F.col("_plain"), F.split("_t", r"\n+|(?<=\.)\s+(?=\d+[.)]\s)")).otherwise(F.array("_t"))
    texts = F.filter(F.transform(parts, D.clean), lambda x: x != "")
    ordered = F.array_sort(F.collect_list(F.struct("at", texts.alias("t"))))
    return read.groupBy(*keep).agg(F.flatten(F.transform(ordered, lambda x: x["t"])).alias("steps"))


def recipe_from_jsonld(rows: DataFrame, key: str, jsonld: str, order: str | None = None) -> DataFrame:
    """(key, script, place, title, description, ingredients, steps, image, yield, total_time, complete) of every recipe.

    Recipes stand at any depth of graphs, main entities and item lists; steps are texts, steps or sections. ``script`` is
    the column ``order`` (which text of the key), ``place`` where the recipe stands in it. Complete is a recipe
    with title, ingredients and steps.
    """
    given = rows.select(key, (F.col(order) if order else F.lit(0)).alias("script"), F.col(jsonld).alias("_ld"))
    nodes = flatten_jsonld(given, [key, "script"], "_ld")
    kinds = F.coalesce(F.try_variant_get("node", "$['@type']", "array<string>"), F.array(F.try_variant_get("node", "$['@type']", "string")))
    own = cut_lineage(nodes.where(F.array_contains(kinds, "Recipe")))
    keep = [key, "script", "place"]
    text = lambda k: F.try_variant_get("node", f"$.{k}", "string")
    # the first of a list, and of an object its address
    head = lambda v: F.coalesce(F.get(F.try_variant_get(v, "$", "array<variant>"), F.lit(0)), v)
    named = lambda v: F.when(_is_object(v), F.coalesce(F.try_variant_get(v, "$.url", "string"), F.try_variant_get(v, "$['@id']", "string"))).otherwise(F.try_variant_get(v, "$", "string"))
    first = lambda k: let(head(head(F.try_variant_get("node", f"$.{k}", "variant"))), named)
    listed = lambda k: F.nullif(F.coalesce(F.try_variant_get("node", f"$.{k}", "array<string>"), F.array_compact(F.array(text(k)))), F.array().cast("array<string>"))
    parts = F.coalesce(listed("recipeIngredient"), listed("ingredients"), F.array().cast("array<string>"))
    read = own.select(*keep, text("name").alias("title"), text("description").alias("description"), parts.alias("ingredients"), first("image").alias("image"), first("recipeYield").alias("yield"), F.nullif(text("totalTime"), F.lit("")).alias("total_time"))
    # entities of all texts of a recipe in one call: they travel joined
    joined = F.concat_ws("\x01", F.concat(F.coalesce("title", F.lit("")), F.lit("\x02"), F.coalesce("description", F.lit("")), F.lit("\x02"), F.coalesce("yield", F.lit(""))), F.transform("ingredients", lambda x: F.coalesce(x, F.lit(""))))
    plain = read.withColumn("_all", F.split(_without_entities(joined), "\x01"))
    cell = lambda i: F.nullif(D.clean(F.get(F.split(F.get("_all", F.lit(0)), "\x02"), F.lit(i))), F.lit(""))
    told = F.filter(F.transform(F.slice("_all", F.lit(2), F.size("_all")), D.clean), lambda x: x != "")
    texts = plain.select(*keep, cell(0).alias("title"), cell(1).alias("description"), told.alias("ingredients"), "image", cell(2).alias("yield"), "total_time")
    steps = _step_texts(own.select(*keep, F.try_variant_get("node", "$.recipeInstructions", "variant").alias("_s")), keep, "_s")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) if k == key else F.col(k) == F.col(f"_{k}") for k in keep]
    out = texts.join(steps.select(*[F.col(k).alias(f"_{k}") for k in keep], F.col("steps").alias("_steps")), same, "left")
    out = out.select(*keep, "title", "description", "ingredients", F.coalesce("_steps", F.array().cast("array<string>")).alias("steps"), "image", "yield", "total_time")
    return out.withColumn("complete", F.col("title").isNotNull() & (F.size("ingredients") > 0) & (F.size("steps") > 0))


def normalize_record(title: Column, ingredients: Column, steps: Column, links: Column, known: Column, kind: Column, kinds: Sequence[str], default: str) -> Column:
    """A record in valid form: trimmed text, numbered steps, known links only, a known type."""
    trimmed = lambda a: F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(
        F.trim(title).alias("tytul"),
        F.when(kind.isin(*kinds), kind).otherwise(default).alias("typ"),
        trimmed(ingredients).alias("skladniki"),
        F.transform(trimmed(steps), lambda s, i: F.concat(F.lit("Krok "), (i + 1).cast("string"), F.lit(": "), F.regexp_replace(s, r"(?i)^krok\s*\d+[:.)]\s*", ""))).alias("sposob"),
        F.array_intersect(links, known).alias("linki"),
    )
