"""Text expressions: normal forms, stems, tokens, lines, sentences and metrics.

All are native column expressions but for ``numbers``, ``word_diff``, ``snap_quote``, ``metric_units`` and
``norm_text_exact`` in :mod:`florilege.functions.arrow`, which need values no built-in function computes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from florilege.functions import rules


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside a lambda a plain expression would be computed per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@cache
def _accents() -> tuple[str, str]:
    """Letters with marks and their base letters, from the Unicode decomposition of the letter blocks."""
    marked, plain = [], []
    for code in [*range(0x00AA, 0x0590), *range(0x1E00, 0x2000)]:
        char = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
        if len(base) == 1 and base != char:
            marked.append(char)
            plain.append(base)
    return "".join(marked), "".join(plain)


def strip_accents(text: Column) -> Column:
    """Base letters of accented ones; loose combining marks vanish."""
    return F.regexp_replace(F.translate(text, *_accents()), r"\p{Mn}+", "")


def norm_text(text: Column) -> Column:
    """Lower case, no accents, every run of non-word characters one space."""
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "ł", "l")
    return F.trim(F.regexp_replace(strip_accents(low), r"(?U)[^\w]+", " "))


def words(text: Column) -> Column:
    """Words of the normal form."""
    return F.filter(F.split(norm_text(text), " "), lambda w: w != "")


def stems(text: Column, size: int = 6) -> Column:
    """Distinct first letters of words of four letters or more."""
    long = F.filter(F.split(norm_text(text), " "), lambda w: F.length(w) > 3)
    return F.array_distinct(F.transform(long, lambda w: F.left(w, F.lit(size))))


def short_sha(text: Column) -> Column:
    return F.left(F.sha1(F.encode(text, "UTF-8")), F.lit(16))


def fingerprint(owner: Column, text: Column) -> Column:
    """The same for texts of the same stems in any order."""
    return short_sha(F.concat(owner, F.lit("|"), F.array_join(F.array_sort(stems(text)), " ")))


def text_hash(text: Column) -> Column:
    return short_sha(norm_text(text))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two distinct arrays; 0 when one is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.nullif(union, F.lit(0)))


def stem_similarity(a: Column, b: Column) -> Column:
    return jaccard(stems(a), stems(b))


def _latin_words(text: Column) -> Column:
    return F.regexp_extract_all(strip_accents(F.lower(F.coalesce(text, F.lit("")))), F.lit("[a-z]+"), F.lit(0))


def title_tokens(text: Column) -> Column:
    """Latin words of three letters or more without filler; a plural s is cut from long words."""
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(rules.TITLE_STOP)])
    kept = F.filter(_latin_words(text), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    return F.array_distinct(F.transform(kept, lambda w: F.when(F.length(w) > 4, F.regexp_replace(w, "s+$", "")).otherwise(w)))


def polish_tokens(text: Column) -> Column:
    """Latin words cut to four letters at most, one less than a short word, without filler."""
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(rules.POLISH_STOP)])
    low = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "ł", "l")
    kept = F.filter(_latin_words(low), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))
    return F.array_distinct(F.transform(kept, lambda w: F.left(w, F.least(F.lit(4), F.length(w) - 1))))


def norm_part(part: Column) -> Column:
    """Free text to the vocabulary of parts: the first word decides, then later words; NULL when none fits."""

    def vocabulary(p: Column) -> Column:
        out = F.when(F.lower(F.trim(part)).isin("null", "none", "-", ""), F.lit(""))
        for head in ("^ ", " "):
            for stems_of, name in rules.PART_STEMS:
                out = out.when(p.rlike(f"{head}(" + "|".join(stems_of.split()) + ")"), name)
        return F.nullif(out, F.lit(""))

    return let(F.concat(F.lit(" "), norm_text(part)), vocabulary)


def slugify(text: Column, default: str = "przepis") -> Column:
    plain = strip_accents(F.regexp_replace(F.lower(text), "ł", "l"))
    slug = F.left(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(60))
    return F.coalesce(F.nullif(slug, F.lit("")), F.lit(default))


def hits(text_words: Column, stem_list: Sequence[str]) -> Column:
    """Words that match a stem; ``=word`` matches the whole word or its plural only."""
    exact = F.array(*[F.lit(s[1:]) for s in stem_list if s.startswith("=")]).cast("array<string>")
    prefix = "^(" + "|".join(s for s in stem_list if not s.startswith("=")) + ")"

    def fits(w: Column) -> Column:
        singular = F.regexp_replace(w, "s+$", "")
        whole = F.array_contains(exact, w) | F.array_contains(exact, singular) | F.array_contains(exact, F.regexp_replace(singular, "e$", ""))
        return whole | w.rlike(prefix) if prefix != "^()" else whole

    return F.size(F.filter(text_words, fits))


def plain_words(text: Column) -> Column:
    """Lower-case words with apostrophes."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)[\w'’]+"), F.lit(0))


def is_culinary(purpose: Column, culinary: Column) -> Column:
    """Clearly a dish, without a healing or craft purpose."""
    return ((culinary >= 3) & (culinary >= 3 * F.greatest(purpose, F.lit(1)))) | ((purpose == 0) & (culinary >= 2))


def quantity_hits(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(rules.QUANTITY))


def recipe_score(headings: Column, list_items: Column, text: Column, ingredient_words: Sequence[str], step_words: Sequence[str]) -> Column:
    """0 to 1 from ingredient and step headings, list items with quantities, and quantities in the text."""
    heads = F.lower(F.array_join(headings, " | "))
    items = F.size(F.filter(list_items, lambda x: x.rlike(rules.QUANTITY)))
    score = (
        F.when(heads.rlike("|".join(ingredient_words)), 0.3).otherwise(0.0)
        + F.when(heads.rlike("|".join(step_words)), 0.25).otherwise(0.0)
        + F.least(F.lit(0.3), items * 0.06)
        + F.least(F.lit(0.15), quantity_hits(F.left(text, F.lit(8000))) * 0.02)
    )
    return F.round(F.least(F.lit(1.0), score), 3)


def topic_score(title: Column, text: Column, keywords: Sequence[str]) -> Column:
    """0 to 1 from words that start with a keyword."""
    found = F.regexp_count(F.lower(F.concat_ws(" ", title, F.left(text, F.lit(6000)))), F.lit(r"(?U)\b(" + "|".join(keywords) + r")\w*"))
    return F.round(F.least(F.lit(1.0), found / 15), 3)


def line_key(line: Column) -> Column:
    """Comparison key of a line."""
    return F.trim(F.regexp_replace(F.lower(line), r"(?U)\W+", " "))


def lines(text: Column) -> Column:
    """Lines without trailing space."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"\s+$", ""))


def is_site_line(line: Column) -> Column:
    """A line that may be dropped as site boilerplate: three words, no section heading, no quantity."""
    long = F.size(F.filter(F.split(line, r"\s+"), lambda w: w != "")) >= 3
    return long & ~line.endswith(":") & ~line.rlike(rules.LINE_QUANTITY)


def _shift(items: Column, back: bool) -> Column:
    """The array moved by one place, with NULL in the gap."""
    size = F.size(items)
    if back:
        return F.slice(F.concat(F.array(F.lit(None)), items), 1, size)
    return F.concat(F.slice(items, 2, size), F.array(F.lit(None)))


def marked_lines(text: Column, boilerplate: Column | None = None) -> Column:
    """Lines with their key and whether they are noise, site boilerplate, a repeated long line or repeated later.

    Repeats are found by sorting the lines of the row by key and comparing neighbours, so a long text stays
    cheap and nothing is shuffled.
    """

    def keyed(line: Column, i: Column) -> Column:
        return F.struct(i.alias("pos"), line.alias("line"), F.trim(line).alias("bare"), line_key(line).alias("key"))

    def judged(e: Column) -> Column:
        short = F.length(e["bare"]).between(1, rules.SHORT_LINE)
        known = F.lit(False)
        if boilerplate is not None:
            known = F.coalesce(F.array_contains(boilerplate, e["key"]), F.lit(False)) & is_site_line(e["bare"])
        return F.struct(e["key"].alias("key"), e["pos"].alias("pos"), e["line"].alias("line"), F.length(e["bare"]).alias("size"), (short & (known | e["bare"].rlike(rules.NOISE_LINE))).alias("drop"))

    def grouped(e: Column) -> Column:
        long = F.when(~e["drop"] & (e["size"] > rules.LONG_LINE), e["key"])
        return F.struct(long.alias("long_key"), e["key"].alias("key"), e["pos"].alias("pos"), e["line"].alias("line"), e["drop"].alias("drop"))

    def flag_repeat(e: Column, before: Column) -> Column:
        again = F.coalesce(e["long_key"] == before["long_key"], F.lit(False))
        return F.struct(e["key"].alias("key"), e["pos"].alias("pos"), e["line"].alias("line"), (e["drop"] | again).alias("drop"))

    def flag_later(e: Column, after: Column) -> Column:
        later = F.coalesce((e["key"] != "") & (e["key"] == after["key"]), F.lit(False))
        return F.struct(e["pos"].alias("pos"), e["line"].alias("line"), e["drop"].alias("drop"), later.alias("later"))

    rows = F.transform(F.transform(F.transform(lines(text), keyed), judged), grouped)
    by_key = let(F.array_sort(rows), lambda z: F.array_sort(F.zip_with(z, _shift(z, True), flag_repeat)))
    return let(by_key, lambda z: F.array_sort(F.zip_with(z, _shift(z, False), flag_later)))


def clean_text(marked: Column) -> Column:
    """Text of marked lines without dropped ones and without runs of lines that only repeat later headings.

    Lines become one letter each; a pattern over the letters finds three such lines in a row, or two right under
    a contents heading.
    """

    def letter(e: Column) -> Column:
        bare = F.trim(e["line"])
        listed = e["later"] & (F.length(bare) <= rules.TOC_LINE) & ~e["line"].rlike(rules.LINE_QUANTITY)
        head = bare.rlike(rules.TOC_HEADING)
        return F.when(listed & head, "H").when(listed, "1").when(head, "h").otherwise("0")

    letters = F.array_join(F.transform(marked, letter), "")  # one letter per line
    one = "[1H]"
    run = f"{one}(?={one}{one})|(?<={one}){one}(?={one})|(?<={one}{one}){one}|(?<=[hH]){one}(?={one})|(?<=[hH]{one}){one}"
    mask = F.split(F.regexp_replace(letters, run, "x"), "")
    kept = F.filter(F.zip_with(marked, mask, lambda e, m: F.when(~e["drop"] & (m != "x"), e["line"])), lambda x: x.isNotNull())
    joined = F.regexp_replace(F.array_join(kept, "\n"), r"\n(?:[ \t]*\n)+", "\n\n")
    return F.regexp_replace(joined, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Sentences cut after closing marks before a capital, a digit or a quote."""
    parts = F.split(F.trim(text), "(?<=[.!?])\\s+(?=[A-ZĄĆĘŁŃÓŚŹŻ0-9\"'(])")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def is_cjk(text: Column) -> Column:
    """At least three tenths of the visible characters are Chinese or Japanese; a text without any is not counted."""
    visible = F.length(F.regexp_replace(text, r"(?U)\s", ""))
    return text.rlike(rules.CJK) & (visible > 0) & (F.regexp_count(text, F.lit(rules.CJK)) >= 0.3 * visible)


def _cut(paragraph: Column, most: int) -> Column:
    """A long paragraph cut between sentences."""
    parts = F.split(paragraph, r"(?<=[.!?。！？])\s*")
    start = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        full = (state["buf"] != "") & (F.length(state["buf"]) + F.length(s) > most)
        out = F.when(full, F.array_append(state["out"], F.trim(state["buf"]))).otherwise(state["out"])
        buf = F.concat(F.when(full, F.lit("")).otherwise(state["buf"]), s, F.lit(" "))
        return F.struct(buf.alias("buf"), out.alias("out"))

    cut = F.aggregate(parts, start, step, lambda z: F.when(F.trim(z["buf"]) != "", F.array_append(z["out"], F.trim(z["buf"]))).otherwise(z["out"]))
    return F.when(F.length(paragraph) <= most, F.array(paragraph)).otherwise(cut)


def paragraphs(text: Column, least: int = 200, most: int = 1500, tail: int = 60) -> Column:
    """Paragraphs: short pieces join the next ones, long ones are cut; a very short rest joins the last."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n\s*\n|\n"), lambda p: F.trim(p)), lambda p: p != "")
    start = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))

    def full(buf: Column) -> Column:
        # only a length between the two limits needs to know the script
        return let(F.length(buf), lambda n: (n >= least) | ((n >= least // 3) & is_cjk(buf)))

    def step(state: Column, p: Column) -> Column:
        def put(buf: Column) -> Column:
            def state_of(done: Column) -> Column:
                return F.struct(F.when(done, F.lit("")).otherwise(buf).alias("buf"), F.when(done, F.array_append(state["out"], buf)).otherwise(state["out"]).alias("out"))

            return let(full(buf), state_of)

        return let(F.when(state["buf"] == "", p).otherwise(F.concat(state["buf"], F.lit("\n"), p)), put)

    def finish(state: Column) -> Column:
        def close(whole: Column) -> Column:
            joined = F.concat(F.slice(whole, 1, F.greatest(F.size(whole) - 1, F.lit(0))), F.array(F.concat_ws("\n", F.try_element_at(whole, F.lit(-1)), state["buf"])))
            short = (F.size(whole) > 0) & (F.length(state["buf"]) < tail)
            return F.when(state["buf"] == "", whole).when(short, joined).otherwise(F.array_append(whole, state["buf"]))

        return let(F.flatten(F.transform(state["out"], lambda p: _cut(p, most))), close)

    return F.aggregate(parts, start, step, finish)


def char_runs(text: Column, n: int) -> Column:
    """Runs of ``n`` characters; the text is cut into characters first, as a substring has to count from the start."""

    def runs(chars: Column) -> Column:
        spots = F.when(F.size(chars) >= n, F.sequence(F.lit(1), F.size(chars) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.array_join(F.slice(chars, i, n), ""))

    return let(F.split(text, ""), runs)


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of ``n`` tokens joined by a space."""

    def runs(t: Column) -> Column:
        spots = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.array_join(F.slice(t, i, n), " "))

    return let(tokens, runs)


def numbers_supported(fact: Column, quote: Column) -> Column:
    """Every number of a statement stands in its quote, comma and point alike."""
    found = F.array_distinct(F.regexp_extract_all(fact, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0)))
    pool = F.replace(quote, F.lit(","), F.lit("."))
    return let(pool, lambda p: F.forall(found, lambda n: F.contains(p, F.replace(n, F.lit(","), F.lit(".")))))


def supported_label(label: Column, text: Column) -> Column:
    """A label follows from a text: all its numbers stand there and half of its word stems."""
    parts = words(label)
    numeral = r"^([ivxlcdm]+|\d+)$"
    nums = F.filter(parts, lambda w: w.rlike(numeral))
    plain = F.filter(parts, lambda w: (F.length(w) >= 4) & ~w.rlike(numeral))

    def check(spaced: Column) -> Column:
        found = F.size(F.filter(plain, lambda w: F.contains(spaced, F.concat(F.lit(" "), F.left(w, F.lit(5))))))
        enough = F.when(F.size(plain) == 0, F.size(nums) > 0).otherwise(found * 2 >= F.size(plain))
        return F.forall(nums, lambda n: F.contains(spaced, n)) & enough

    supported = let(F.concat(F.lit(" "), norm_text(text), F.lit(" ")), check)
    return F.coalesce(F.nullif(label, F.lit("")).isNotNull() & supported, F.lit(False))


def faithful(new: Column, original: Column, threshold: float = 0.6, slack: int = 1) -> Column:
    """A rewritten sentence adds few stems and no numbers to its sources."""
    ns = stems(new, 5)
    novel = F.size(F.array_except(ns, stems(original, 5)))
    return numbers_supported(new, original) & (novel <= F.greatest(F.lit(float(slack)), (1 - threshold) * F.size(ns)))


def stem_cover(text: Column, by: Column) -> Column:
    """Share of the stems of a text found in another one; 1 for a text without stems."""
    ts = stems(text, 5)
    return F.when(F.size(ts) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(ts, stems(by, 5))) / F.nullif(F.size(ts), F.lit(0)))


def has_loop(text: Column) -> Column:
    """One word four times in a row, or one sentence three times."""
    low = F.concat_ws(" ", F.split(F.trim(F.lower(text)), r"\s+"))
    run = low.rlike(r"(?:^| )(\S+)(?: \1){3}(?: |$)")
    sents = F.filter(F.transform(F.split(F.lower(text), "[.!?]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 8)
    sorted_ = F.array_sort(sents)
    again = let(sorted_, lambda z: F.exists(F.zip_with(z, F.slice(z, 3, F.greatest(F.size(z), F.lit(1))), lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    return run | again


def segment_problems(src: Column, out: Column, lang: Column) -> Column:
    """Codes of what is wrong with a translated segment; ``warn:`` marks a warning."""
    a, b = F.trim(F.coalesce(src, F.lit(""))), F.trim(F.coalesce(out, F.lit("")))
    foreign = ~F.left(F.lower(F.coalesce(lang, F.lit(""))), F.lit(2)).isin("", "pl")
    script = foreign & b.rlike(rules.FOREIGN_SCRIPT)
    same = foreign & (F.size(F.split(a, r"\s+")) >= 4) & (norm_text(a) == norm_text(b))
    ratio = F.length(b) / F.nullif(F.length(a), F.lit(0))
    long = F.length(a) >= 40
    found = F.array_compact(
        F.array(
            F.when(script, "foreign_script").when(same, "untranslated"),
            F.when(has_loop(b), "loop"),
            F.when(long & (ratio < 0.3), "cut_short").when(long & (ratio > 3), "too_long").when(long & ((ratio < 0.5) | (ratio > 2.2)), "warn:length"),
        )
    )
    none = F.array().cast("array<string>")
    return F.when(a == "", none).when(b == "", F.array(F.lit("empty"))).otherwise(found)


def looks_broken(src: Column, out: Column) -> Column:
    """Usual faults of machine translation: empty, far too long, looping, few different words."""
    w = F.filter(F.split(F.lower(F.trim(out)), r"\s+"), lambda x: x != "")
    poor = (F.size(w) >= 12) & (F.size(F.array_distinct(w)) / F.nullif(F.size(w), F.lit(0)) < 0.3)
    run = F.array_join(w, " ").rlike(r"(?:^| )(\S+)(?: \1){3}(?: |$)")
    return F.when(F.trim(out) == "", F.trim(src) != "").otherwise((F.length(out) > 3 * F.length(src) + 40) | run | F.coalesce(poor, F.lit(False)))


def report_summary(problems: Column, first: int = 3) -> Column:
    """First errors joined, with the number of further ones."""
    errors = F.filter(problems, lambda p: ~p.startswith("warn:"))
    more = F.when(F.size(errors) > first, F.concat(F.lit(" (+"), (F.size(errors) - first).cast("string"), F.lit(")"))).otherwise("")
    return F.concat(F.array_join(F.slice(errors, 1, first), "; "), more)


def split_quantity(text: Column) -> Column:
    """Leading quantity with unit, and the name behind it."""
    pattern = r"(?iU)^\s*([\d½¼¾⅓⅔][\d\s.,/½¼¾⅓⅔–-]*(?:\s*(?:g|kg|dag|mg|ml|l|litr\w*|łyż\w*|lyz\w*|szklan\w*|garś\w*|szczyp\w*|krop\w*|cups?|tbsp|tsp|oz|cm|%)\.?)?)\s+(.{2,})$"
    name = F.regexp_replace(F.regexp_extract(text, pattern, 2), r"^[ ,;]+|[ ,;]+$", "")
    quantity = F.trim(F.regexp_extract(text, pattern, 1))
    found = text.rlike(pattern)
    return F.struct(F.when(found, quantity).alias("quantity"), F.when(found, name).otherwise(F.trim(text)).alias("name"))


def iso_duration(value: Column) -> Column:
    """``PT1H30M`` to hours and minutes in words; other text stays."""
    pattern = r"(?i)^P(?:(\d+)D)?T?(?:(\d+)H)?(?:(\d+)M)?(?:\d+S)?$"

    def part(i: int) -> Column:
        return F.coalesce(F.nullif(F.regexp_extract(value, pattern, i), F.lit("")).cast("int"), F.lit(0))

    hours, minutes = part(2) + part(1) * 24, part(3)
    spoken = F.concat_ws(" ", F.when(hours > 0, F.concat(hours.cast("string"), F.lit(" godz."))), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit(" min"))))
    any_part = F.concat(*[F.regexp_extract(value, pattern, i) for i in (1, 2, 3)]) != ""
    return F.when(value.rlike(pattern) & any_part, F.nullif(spoken, F.lit(""))).otherwise(F.nullif(value, F.lit("")))


def first_rule(text: Column, table: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """Name of the first ``(pattern, name)`` whose pattern occurs."""
    out = F.when(text.rlike(table[0][0]), table[0][1])
    for pattern, name in table[1:]:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(F.lit(default)) if default is not None else out


def syllables(word: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(word, F.lit("(?i)[aeiouyąęóäöüéèêàáíúâîô]+")))


def text_metrics(body: Column, low: int = 120, high: int = 200) -> Column:
    """Words, sentences, readability, variety, repeats, and the scores that follow from them."""
    w = F.regexp_extract_all(F.lower(body), F.lit(r"(?U)[^\W\d_]+"), F.lit(0))
    n = F.greatest(F.size(w), F.lit(1))
    spots = F.regexp_extract_all(F.replace(body, F.lit("\n"), F.lit(" ")), F.lit(r"[^.!?…]+[.!?…]*"), F.lit(0))
    sents = F.filter(spots, lambda s: s.rlike(r"(?U)[^\W\d_]"))
    ns = F.greatest(F.size(sents), F.lit(1))
    hard = F.size(F.filter(w, lambda x: syllables(x) >= 4))
    fog = F.round(0.4 * (n / ns + 100.0 * hard / n), 1)
    longest = F.coalesce(F.array_max(F.transform(sents, lambda s: F.regexp_count(s, F.lit(r"(?U)[^\W\d_]+")))), F.lit(0))
    paras = F.size(F.filter(F.split(body, r"\n\s*\n"), lambda p: F.trim(p) != ""))
    ttr = F.round(F.size(F.array_distinct(w)) / n, 2)
    count = F.size(w)
    length_score = F.when(count < low, F.greatest(F.lit(0), 100 - (low - count) * 2)).when(count > high, F.greatest(F.lit(0), 100 - (count - high) * 2)).otherwise(100)
    reading = F.when(fog <= 10, F.lit(100.0)).otherwise(F.greatest(F.lit(0.0), 100 - (fog - 10) * 15))
    reading = F.greatest(F.lit(0.0), reading - F.when(longest > 30, 15).otherwise(0))
    issues = F.concat_ws(
        ",",
        F.when(count < low, "too_short").when(count > high, "too_long"),
        F.when(fog > 11, "hard_text"),
        F.when(longest > 30, "long_sentence"),
        F.when((paras < 2) & (count > 80), "wall_of_text"),
    )
    return F.struct(
        count.alias("words"), F.size(sents).alias("sentences"), fog.alias("fog"), longest.alias("longest_sentence"), paras.alias("paragraphs"),
        ttr.alias("ttr"), length_score.cast("double").alias("length_score"), F.round(reading, 1).alias("reading_score"), issues.alias("issues"),
    )


def repeated_words(text_words: Column, least: int = 3) -> Column:
    """Words of four letters or more that come up ``least`` times or more, counted in one pass."""
    long = F.array_sort(F.filter(text_words, lambda w: F.length(w) > 3))
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, w: Column) -> Column:
        n = F.when(state["w"] == w, state["n"] + 1).otherwise(1)
        out = F.when(n == least, F.array_append(state["out"], w)).otherwise(state["out"])
        return F.struct(w.alias("w"), n.alias("n"), out.alias("out"))

    return F.aggregate(long, start, step, lambda s: s["out"])


def name_phrase(text: Column) -> Column:
    """Words of an ingredient that name it: no quantities, parts or fillers."""
    stop = F.array(*[F.lit(w) for w in rules.NOT_NAME])
    w = F.regexp_extract_all(text, F.lit(r"(?U)[^\W\d_]+"), F.lit(0))
    return F.array_join(F.filter(w, lambda x: ~F.array_contains(stop, norm_text(x))), " ")


def clean_name(text: Column) -> Column:
    """Lower-case name without brackets and quantities."""
    n = F.lower(F.regexp_replace(text, r"\(.*?\)", " "))
    n = F.regexp_replace(n, r"(?U)\d+([.,]\d+)?\s*\w*", " ")
    return F.regexp_replace(F.regexp_replace(n, r"\s+", " "), r"^[ ,.;:-]+|[ ,.;:-]+$", "")


def error_signature(log: Column, marker: str) -> Column:
    """Last marked line of a log, digits as N, at most 200 characters; NULL without one."""
    last = F.try_element_at(F.filter(F.split(log, "\n"), lambda x: F.contains(x, F.lit(marker))), F.lit(-1))
    tail = F.substring_index(last, marker, -1) if len(marker) else last
    return F.left(F.trim(F.regexp_replace(tail, r"\d+", "N")), F.lit(200))


def focus_windows(text: Column, keys: Sequence[str] | Column, window: int = 1600, limit: int = 10000) -> Column:
    """Merged windows around every occurrence of a name in a long text, up to a limit; the start if none."""
    low = F.lower(text)
    names = keys if isinstance(keys, Column) else F.array(*[F.lit(k) for k in keys])

    def spots(key: Column) -> Column:
        parts = F.split(low, F.concat(F.lit(r"\Q"), key, F.lit(r"\E")))
        fold = F.aggregate(
            F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda s, p: F.struct((s["at"] + F.length(p) + F.length(key)).alias("at"), F.array_append(s["out"], s["at"] + F.length(p)).alias("out")),
            lambda s: s["out"],
        )
        return fold

    starts = F.array_sort(F.flatten(F.transform(names, spots)))
    half = window // 2
    spans = F.transform(starts, lambda i: F.struct(F.greatest(F.lit(0), i - half).alias("a"), F.least(F.length(text), i + half).alias("b")))
    empty = F.array().cast("array<struct<a:int,b:int>>")

    def merge(out: Column, s: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joined = F.array_append(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b")))
        return F.when((F.size(out) > 0) & (s["a"] <= last["b"]), joined).otherwise(F.array_append(out, s))

    merged = F.aggregate(spans, empty, merge)

    def take(state: Column, s: Column) -> Column:
        size = F.least(s["b"] - s["a"], limit - state["n"])
        more = state["n"] < limit
        piece = F.substring(text, s["a"] + 1, size)
        return F.struct(F.when(more, state["n"] + size).otherwise(state["n"]).alias("n"), F.when(more, F.array_append(state["out"], piece)).otherwise(state["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    picked = F.aggregate(merged, start, take, lambda s: F.array_join(s["out"], "\n[...]\n"))
    return F.when(F.length(text) <= limit, text).when(F.size(starts) == 0, F.left(text, F.lit(limit))).otherwise(picked)


def clip_clean(value: Column, limit: int) -> Column:
    """One line, clipped; NULL for empty words."""
    one = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    return F.when(F.lower(one).isin("", "null", "none", "-", "brak", "nieznany", "nieznana"), F.lit(None)).otherwise(F.left(one, F.lit(limit)))


def filled(value: Column) -> Column:
    """Holds more than a placeholder."""
    return ~F.lower(F.trim(F.coalesce(value, F.lit("")))).isin(*rules.EMPTY_WORDS)
