"""Pages as trees: a table of nodes per page, selectors, main text and field profiles as columns and windows over it.

A small parser per page gives nodes in document order. ``last`` is the last node below a node, so an ancestor test is a
comparison of two numbers; ``start`` and ``stop`` are places in the page's text, so the text of a node is a substring.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from florilege.functions.text import let

#: Between two strings of a page's text, which a reader may join by spaces or by line feeds.
CUT = "\x01"
#: Elements without content, and those whose content is no text of the page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
UNREAD = {"script", "style", "template"}
#: Elements that end at the start of certain others.
_BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "head": {"body"}, "p": _BLOCKS}
#: Elements inside which an open one of ``_ENDED_BY`` is another list's or table's.
_SCOPES = {"ul", "ol", "dl", "table", "select", "body", "article", "section", "div", "main", "td", "th"}
#: Deeper elements hang on the last of these levels, so no path is long.
DEEPEST = 256

_NODE = "node:int,parent:int,last:int,depth:int,prev:int,nth:int,start:int,stop:int,tag:string,ident:string,classes:array<string>,attrs:map<string,string>"
TREE = f"body string, nodes array<struct<{_NODE}>>, jsonld array<string>"
_STEP = "struct<link:string,tag:string,ident:string,classes:array<string>,tests:array<struct<name:string,op:string,value:string>>,nth:int>"
RULES = f"site string, field string, css string, attr string, ways array<array<{_STEP}>>"


class _Tree(HTMLParser):
    """Nodes of one page as columns, its text, and its JSON-LD scripts."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.tags: list[str] = []
        self.children: dict[int, list[int]] = {}
        self.text: list[str] = []
        self.at = 0
        self.whole = True  # whether the last string has ended
        self.scripts: list[str] = []
        self.script: list[str] | None = None

    def _close(self, depth: int) -> None:
        for node in self.open[depth:]:
            self.rows[node][2], self.rows[node][7] = len(self.rows) - 1, self.at
        del self.open[depth:], self.tags[depth:]

    def _implied(self, tag: str) -> None:
        for i in range(len(self.tags) - 1, -1, -1):
            if tag in _ENDED_BY.get(self.tags[i], ()):
                self._close(i)
            elif self.tags[i] in _SCOPES and not (self.tags[i] in ("td", "th") and tag in _ENDED_BY["td"]):
                return

    def handle_starttag(self, tag, attrs):
        self._implied(tag)
        self.whole = True
        a = {k: v or "" for k, v in reversed(attrs)}
        parent = self.open[-1] if self.open else -1
        beside = self.children.setdefault(parent, [])
        node = len(self.rows)
        self.rows.append([node, parent, node, len(self.open), beside[-1] if beside else -1, len(beside) + 1, self.at, self.at, tag, a.get("id", ""), a.get("class", "").split(), list(a.items())])
        beside.append(node)
        if tag == "script" and a.get("type", "").strip().lower() == "application/ld+json":
            self.script = []
        if tag not in VOID and len(self.open) < DEEPEST:
            self.open.append(node)
            self.tags.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.tags and self.tags[-1] == tag and tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        self.whole = True
        if tag == "script" and self.script is not None:
            self.scripts.append("".join(self.script))
            self.script = None
        for i in range(len(self.tags) - 1, -1, -1):
            if self.tags[i] == tag:
                self._close(i)
                return

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        elif not (self.tags and self.tags[-1] in UNREAD):
            # a stray "<" comes on its own: it belongs to the string before it
            if not self.whole:
                self.text[-1] = self.text[-1][:-1]
                self.at -= 1
            piece = data.replace(CUT, " ") + CUT
            self.text.append(piece)
            self.at += len(piece)
            self.whole = False


def _parsed(html: str | None) -> _Tree:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    tree._close(0)
    return tree


def parse_trees(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """The columns ``keys`` with ``body``, ``nodes`` and ``jsonld`` of each page, ``chars`` and ``scripts`` as counts.

    Null and empty pages have no nodes and an empty text.
    """
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                trees = [_parsed(h) for h in batch.column(html).to_pylist()]
                cells = [list(c) for c in zip(*(r for t in trees for r in t.rows), strict=True)] or [[] for _ in range(12)]
                types = [pa.int32()] * 8 + [pa.string(), pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string())]
                names = [f.split(":")[0] for f in _NODE.replace("map<string,string>", "map").split(",")]
                nodes = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cells, types, strict=True)], names)
                ends = [0]
                for t in trees:
                    ends.append(ends[-1] + len(t.rows))
                out = [batch.column(k) for k in keys]
                out += [pa.array(["".join(t.text) for t in trees], pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nodes), pa.array([t.scripts for t in trees], pa.list_(pa.string()))]
                yield pa.record_batch(out, names=[*keys, "body", "nodes", "jsonld"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", {TREE}"
    return pages.select(*keys, html).mapInArrow(run, schema)


def clean(text: Column) -> Column:
    """Marks of tags and runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), rf"[\s\x01 ]+", " "))


def text_of(node: Column) -> Column:
    """The text below a node as it stands in ``body``."""
    return F.substring(F.col("body"), node["start"] + 1, node["stop"] - node["start"])


def lines_of(text: Column) -> Column:
    """Each string of a text on a line of its own, cleaned, without empty lines; NULL when nothing is left."""
    lines = F.filter(F.transform(F.split(text, r"[\x01\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"), clean), lambda x: x != "")
    return F.nullif(F.array_join(lines, "\n"), F.lit(""))


def tagged(*tags: str) -> Column:
    """Nodes of these tags in document order."""
    return F.filter("nodes", lambda n: n["tag"].isin(*tags))


#: Parts of a page that are not its main text.
ASIDE = ("script", "style", "nav", "footer", "header", "aside", "form", "noscript")


def main_text() -> Column:
    """Lines of the first article, else main element, else body, without menus, forms and the like; "" when nothing is left."""

    def of(off: Column) -> Column:
        whole = lambda n: ~F.exists(off, lambda b: (b["node"] <= n["node"]) & (n["node"] <= b["last"]))
        first = lambda tag: F.get(F.filter(tagged(tag), whole), F.lit(0))
        page = F.struct(F.lit(0).alias("start"), F.length("body").alias("stop"))
        spot = lambda n: F.when(n.isNotNull(), F.struct(n["start"].alias("start"), n["stop"].alias("stop")))
        return let(F.coalesce(*[spot(first(t)) for t in ("article", "main", "body")], page), lambda m: kept(m, off))

    def kept(main: Column, off: Column) -> Column:
        begin = F.struct(main["start"].alias("at"), F.lit("").alias("out"))

        def cut(acc: Column, b: Column) -> Column:
            more = F.concat(acc["out"], F.substring(F.col("body"), acc["at"] + 1, b["start"] - acc["at"]))
            inside = (b["start"] >= acc["at"]) & (b["stop"] <= main["stop"]) & (b["stop"] > b["start"])
            return F.when(inside, F.struct(b["stop"].alias("at"), more.alias("out"))).otherwise(acc)

        return F.aggregate(off, begin, cut, lambda acc: F.concat(acc["out"], F.substring(F.col("body"), acc["at"] + 1, main["stop"] - acc["at"])))

    return F.coalesce(lines_of(let(tagged(*ASIDE), of)), F.lit(""))


_TOKEN = re.compile(r"""\s*([>+~,])\s*|(\s+)|([a-zA-Z][\w-]*|\*)|\#([\w-]+)|\.([\w-]+)|\[\s*([\w:-]+)\s*(?:([~^$*|]?=)\s*(?:"([^"]*)"|'([^']*)'|([^\]\s"']+))\s*)?\]|:(first-child)|:nth-child\(\s*(\d+)\s*\)""")


@cache
def ways_of(css: str) -> list[list[dict]] | None:
    """A selector as alternatives of steps; None when it is empty, broken or uses anything but type, class, id, attribute,
    first and n-th child, and the combinators descendant, child, next and later sibling."""

    def step(link: str) -> dict:
        return {"link": link, "tag": None, "ident": None, "classes": [], "tests": [], "nth": None}

    css, at, ways, bare = (css or "").strip(), 0, [[step("")]], True
    while at < len(css):
        m = _TOKEN.match(css, at)
        if m is None:
            return None
        sign, space, tag, ident, css_class, name, op, *values = m.groups()
        quoted, single, plain, first, nth = values
        last = ways[-1][-1]
        if sign or space:
            if bare:
                return None
            if sign == ",":
                ways.append([step("")])
            else:
                ways[-1].append(step(sign or " "))
        elif tag:
            if not bare:
                return None
            last["tag"] = None if tag == "*" else tag.lower()
        elif ident:
            last["ident"] = ident
        elif css_class:
            last["classes"].append(css_class)
        elif name:
            last["tests"].append({"name": name.lower(), "op": op or "", "value": next((v for v in (quoted, single, plain) if v is not None), "")})
        else:
            last["nth"] = 1 if first else int(nth)
        bare, at = bool(sign or space), m.end()
    return None if bare else ways


def rule_table(spark: SparkSession, rules: list[tuple[str | None, str, str, str | None]]) -> DataFrame:
    """(site, field, css, attr) as a table of parsed rules; a null site means every site, a broken selector finds nothing."""
    return spark.createDataFrame([(s, f, css, attr, ways_of(css) or []) for s, f, css, attr in rules], RULES)


def profile_rules(profiles: DataFrame, site: str, fields: str) -> DataFrame:
    """Rules of profiles given as JSON ``{"title": {"css": ..., "attr": ...}, ...}``, one row per site."""

    @F.udf(RULES.split("ways ", 1)[1], useArrow=True)
    def parsed(css):
        return ways_of(css) or []

    spec = F.from_json(fields, "map<string,struct<css:string,attr:string>>")
    each = profiles.select(F.col(site).alias("site"), F.explode(spec).alias("field", "spec")).where("spec.css IS NOT NULL")
    return each.select("site", "field", "spec.css", "spec.attr", parsed("spec.css").alias("ways"))


def _fits(node: Column, step: Column) -> Column:
    """Whether a node has the tag, id, classes, attributes and place that a step names."""

    def holds(t: Column) -> Column:
        v, want = F.try_element_at(node["attrs"], t["name"]), t["value"]
        some = want != ""
        test = (
            F.when(t["op"] == "", True)
            .when(t["op"] == "=", v == want)
            .when(t["op"] == "~=", F.array_contains(F.split(v, r"\s+"), want))
            .when(t["op"] == "^=", some & v.startswith(want))
            .when(t["op"] == "$=", some & v.endswith(want))
            .when(t["op"] == "*=", some & v.contains(want))
            .otherwise((v == want) | v.startswith(F.concat(want, F.lit("-"))))
        )
        return v.isNotNull() & test

    return (
        (step["tag"].isNull() | (step["tag"] == node["tag"]))
        & (step["ident"].isNull() | (step["ident"] == node["ident"]))
        & F.forall(step["classes"], lambda c: F.array_contains(node["classes"], c))
        & F.forall(step["tests"], holds)
        & (step["nth"].isNull() | (step["nth"] == node["nth"]))
    )


#: Rules up to this number are sent to every task; more are joined by site.
FEW_RULES = 20_000


def select(trees: DataFrame, page: str, site: str, rules: DataFrame) -> DataFrame:
    """(page, field, css, node, value): every element that a rule of the page's site selects; ``value`` is its text or attribute.

    Each page is looked at once: nodes that fit a step leave it as rows. That a node has an ancestor among the hits of the
    step before is then a running maximum of ``last`` over the hits before it, since nodes nest; a parent is the last node one
    level higher, a sibling the last on its level. All windows are within one page and rule and share one shuffle.
    """
    one = rules.groupBy(F.col("site").alias("_for")).agg(F.collect_list(F.struct("field", "css", "attr", "ways")).alias("_rules"))
    few = rules.count() <= FEW_RULES
    own = trees.join(F.broadcast(one) if few else one, F.col(site) == F.col("_for"), "left")
    every = one.where("_for IS NULL").select(F.col("_rules").alias("_every"))  # one row at most
    own = own.join(F.broadcast(every), F.lit(True), "left")
    none = F.array().cast(f"array<struct<field:string,css:string,attr:string,{'ways:' + RULES.split('ways ', 1)[1]}>>")
    each = own.withColumn("_all", F.concat(F.coalesce("_rules", none), F.coalesce("_every", none)))

    def found(rule: Column) -> Column:
        def of_way(way: Column, a: Column) -> Column:
            def of_step(step: Column, k: Column) -> Column:
                def told(n: Column) -> Column:
                    value = F.when(k == F.size(way) - 1, F.when(rule["attr"].isNotNull(), F.try_element_at(n["attrs"], rule["attr"])).otherwise(text_of(n)))
                    at = [n[c].alias(c) for c in ("node", "parent", "last", "depth", "prev")]
                    return F.struct(rule["field"].alias("field"), rule["css"].alias("css"), a.alias("way"), k.alias("k"), F.size(way).alias("steps"), step["link"].alias("link"), *at, value.alias("value"))

                return F.transform(F.filter("nodes", lambda n: _fits(n, step)), told)

            return F.flatten(F.transform(way, of_step))

        return F.flatten(F.transform(rule["ways"], of_way))

    hits = each.select(page, F.explode(F.flatten(F.transform("_all", found))).alias("h")).select(page, "h.*")
    return _chained(hits, page, rules).select(page, "field", "css", "node", "value").dropDuplicates([page, "field", "css", "node"])


def _chained(hits: DataFrame, page: str, rules: DataFrame) -> DataFrame:
    """The hits of last steps whose earlier steps are met as their combinators ask."""
    step = rules.select(F.explode("ways").alias("way")).select(F.posexplode("way").alias("k", "s")).where("k > 0")
    links = sorted((r.k, r.link) for r in step.select("k", "s.link").distinct().collect())
    way = [page, "field", "css", "way"]
    done = hits.withColumn("_ok", F.col("k") == 0)
    for k in sorted({k for k, _ in links}):
        before = (F.col("k") == k - 1) & F.col("_ok")
        here = F.lit(False)
        for link in [name for j, name in links if j == k]:
            if link == " ":
                ahead = Window.partitionBy(*way).orderBy("node").rangeBetween(Window.unboundedPreceding, -1)
                met = F.max(F.when(before, F.col("last"))).over(ahead) >= F.col("node")
            else:
                level = F.col("parent") if link == "~" else F.when(F.col("k") == k, F.col("depth") - (1 if link == ">" else 0)).otherwise(F.col("depth"))
                named = {">": "_above", "+": "_beside", "~": "_family"}[link]
                done = done.withColumn(named, level)
                ahead = Window.partitionBy(*way, named).orderBy("node").rangeBetween(Window.unboundedPreceding, -1)
                near = F.max(F.when(before, F.col("node"))).over(ahead)
                met = near.isNotNull() if link == "~" else near == F.col("parent" if link == ">" else "prev")
            here = here | ((F.col("link") == link) & F.coalesce(met, F.lit(False)))
        done = done.withColumn("_ok", F.when(F.col("k") == k, here).otherwise(F.col("_ok")))
    return done.where((F.col("k") == F.col("steps") - 1) & F.col("_ok"))


#: Fields of a profile, those with many values, least characters of an article and of a told fact.
FIELDS = ("title", "description", "ingredients", "steps", "image", "yield", "total_time", "notes", "content")
MANY = ("ingredients", "steps")
ARTICLE_CHARS, FACT_CHARS = 300, 400


def profile_fields(trees: DataFrame, page: str, site: str, rules: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page with the fields of its site's profile, ``mode`` and ``fact``.

    ``ingredients`` and ``steps`` are all values, ``content`` the lines of all elements, the rest the first value. ``mode`` is
    ``fields`` for a complete record, ``article`` for a title with enough content, else NULL; ``fact`` tells whether
    title and content are enough for a told fact.
    """
    got = select(trees, page, site, rules)
    values = F.transform(F.array_sort(F.collect_list(F.struct("node", "value"))), lambda x: x["value"])
    grouped = got.groupBy(page, "field").agg(values.alias("_v"))
    wide = grouped.groupBy(page).agg(F.map_from_entries(F.collect_list(F.struct("field", "_v"))).alias("_f"))
    rows = trees.select(page, *keep).join(wide.withColumnRenamed(page, "_page"), F.col(page) == F.col("_page"), "left")
    told = lambda f: F.filter(F.transform(F.coalesce(F.try_element_at("_f", F.lit(f)), F.array().cast("array<string>")), clean), lambda v: v != "")
    lines = F.filter(F.transform(F.coalesce(F.try_element_at("_f", F.lit("content")), F.array().cast("array<string>")), lines_of), lambda v: v.isNotNull())
    cells = [(told(f) if f in MANY else F.nullif(F.array_join(lines, "\n"), F.lit("")) if f == "content" else F.get(told(f), F.lit(0))).alias(f) for f in FIELDS]
    out = rows.select(page, *keep, *cells)
    long = lambda n: F.col("title").isNotNull() & (F.length(F.coalesce("content", F.lit(""))) >= n)
    complete = F.col("title").isNotNull() & (F.size("ingredients") > 0) & (F.size("steps") > 0)
    return out.withColumns({"mode": F.when(complete, "fields").when(long(ARTICLE_CHARS), "article"), "fact": long(FACT_CHARS)})
