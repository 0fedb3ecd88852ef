"""Secret scans in DataFrame functions only: fixed patterns, and windows of high Shannon entropy over candidate strings.

A candidate is a run of letters and digits between separators, or a block of such runs joined by the signs that base64
uses, if the runs look random. A window slides over it; the counts of its characters and the sum of c*log2(c) are
updated by the character that comes in and the one that goes out. A candidate whose highest window entropy reaches
the bound of its character class is a span of kind ``entropy`` unless the allow-list names its form. Gates, classes and
allow-list look at the candidate alone, so a path or a placeholder beside a key neither hides nor joins it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions.text import let
from florilege.llm.common import packed

#: The base patterns, in the order of their kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
#: Greedy runs are maximal, so 32 or more from the start of a run are the runs of 32 or more.
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}"
#: Letters and digits between separators; runs joined by base64 signs.
PART = r"(?<![A-Za-z0-9])[A-Za-z0-9]{20,}"
JOINED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9]{0,64}[+/_-])[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
WINDOW = 20
#: Bits a character by class: digits with a-f or A-F; with lower or upper case letters only; with both.
BOUNDS = {"hex": 3.0, "single": 3.4, "mixed": 3.7}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Parts that are no secrets: those that name themselves an example at an end (blocks too), ascending digits, crossed-out
#: ones, one repeated unit, words in camel case.
ALLOWED = (
    r"(?i)^(?:example|placeholder|changeme|your|dummy|sample)|(?:example|placeholder|changeme)(?:key)?[0-9]{0,4}$",
    r"^[A-Za-z]{0,12}(?:0?1234567890?){1,8}[A-Za-z]{0,12}$",
    r"(?i)^[a-z0-9]{0,12}x{8,}[a-z0-9]{0,4}$",
    r"^(.{1,6}?)\1+$",
    # possessive: no other cut into words could match, and a greedy group takes the matcher's stack on long runs
    r"^[a-z]*(?:(?:[A-Z][a-z]?)?[A-Z][a-z]{2,}|[A-Z]{2,5}(?=[A-Z][a-z]))++[A-Z]{0,5}[0-9]{0,4}$",
)
#: A run of a block that is a word, maybe with a number behind it, or a number; such a run is not random.
WORD = r"^(?:(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,4}|[0-9]+)$"


def _found(text: Column, pattern: str, kind: int, length: Callable[[Column], Column] | None = None) -> Column:
    """Spans (s, k, e, v) of the matches of ``pattern``; ``length`` tells how many matches' lengths to look at."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = length(text) if length else matches
    pieces = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,k:int,e:int,v:string>>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        span = F.struct(s.alias("s"), F.lit(kind).alias("k"), e.alias("e"), x["v"].alias("v"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    rows = F.arrays_zip(F.slice(pieces, 1, F.size(matches)).alias("p"), matches.alias("m"), value.alias("v"))
    rows = F.transform(rows, lambda r: F.struct(r["p"].alias("p"), r["m"].alias("m"), r["v"].alias("v")))
    return F.when(text.rlike(pattern), F.aggregate(rows, start, add, lambda acc: acc["out"])).otherwise(start["out"])


def top_entropy(text: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy of any window of ``text`` in bits a character, by incremental counts.

    With the sum of c*log2(c) over the counts c of a window its entropy is log2(window) - sum / window. One step costs the
    same whatever the length: the codes of the characters are made once, of the counts only those of the two
    characters that come and go are replaced, and what a count adds to the sum is read from a list.
    """
    gains = [(c + 1) * math.log2(c + 1) - (c * math.log2(c) if c else 0.0) for c in range(window + 1)]
    gain = F.array(*[F.lit(g) for g in gains])
    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("n"), F.lit(0.0).alias("sum"), F.lit(float("inf")).alias("low"))

    def changed(counts: Column, k: Column, by: int) -> Column:
        return F.concat(F.slice(counts, F.lit(1), k), F.array(F.get(counts, k) + by), F.slice(counts, k + 2, F.lit(len(ALPHABET) + 1)))

    def best_of(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            new, old = F.get(codes, i), F.get(codes, i - window)
            came = acc["sum"] + F.get(gain, F.get(acc["n"], new))
            swapped = came - F.get(gain, F.get(acc["n"], old) - 1)
            filling = F.struct(changed(acc["n"], new, 1).alias("n"), came.alias("sum"), F.when(i == window - 1, came).otherwise(acc["low"]).alias("low"))
            counts = let(changed(acc["n"], old, -1), lambda n: changed(n, new, 1))
            sliding = F.struct(counts.alias("n"), swapped.alias("sum"), F.least(acc["low"], swapped).alias("low"))
            return F.when(i < window, filling).when(new == old, acc).otherwise(sliding)

        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, lambda acc: F.log2(F.lit(float(window))) - acc["low"] / window)

    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    return F.when(F.length(text) >= window, let(codes, best_of)).otherwise(0.0)


def _classes(value: Column) -> tuple[Column, Column, Column]:
    return value.rlike("[a-z]"), value.rlike("[A-Z]"), value.rlike("[0-9]")


def _secret_part(value: Column) -> Column:
    """Whether a run of letters and digits is not allow-listed and reaches the bound of its class.

    Where the letters have one case, an eighth of the run must be digits, since long words reach the bound as well.
    """
    listed = F.lit(False)
    for form in ALLOWED:
        listed = listed | value.rlike(form)
    lower, upper, digit = _classes(value)
    both = lower & upper
    bound = F.when(value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), BOUNDS["hex"]).when(both, BOUNDS["mixed"]).otherwise(BOUNDS["single"])
    gate = both | ((lower | upper) & digit & (F.length(F.regexp_replace(value, "[^0-9]", "")) >= F.length(value) / 8))
    return F.when(gate & ~listed, top_entropy(value) >= bound).otherwise(False)


def _secret_block(value: Column) -> Column:
    """Whether joined runs are one random string: all three classes, no run of five or more characters a word or a number."""
    lower, upper, digit = _classes(value)
    runs = F.filter(F.split(value, "[+/_-]"), lambda p: F.length(p) >= 5)
    random = (F.size(runs) > 0) & ~F.exists(runs, lambda p: p.rlike(WORD))
    return F.when(lower & upper & digit & random & ~value.rlike(ALLOWED[0]), top_entropy(value) >= BOUNDS["mixed"]).otherwise(False)


def scan(docs: DataFrame) -> DataFrame:
    """Every row with ``spans`` added: array<struct<s:int,k:int,e:int>>, sorted; code points, end exclusive.

    k is the place in KINDS. Spans of patterns come first in right; an entropy span inside one of them is not repeated, nor
    a run inside a block that is one span.
    Null texts count as empty. A column of the name ``spans`` is replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    assign = F.filter(_found(text, ASSIGN, 0, lambda t: F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2))), lambda x: F.length(x["v"]) >= 8)
    base = F.concat(assign, _found(text, ACCESS, 1), _found(text, HEX, 2))
    found = docs.withColumns({"_base": base, "_more": _found(text, PART, 3), "_joined": _found(text, JOINED, 3)})
    inside = lambda x, spans: F.exists(spans, lambda b: (b["s"] <= x["s"]) & (b["e"] >= x["e"]))
    found = found.withColumn("_base", F.concat("_base", F.filter("_joined", lambda x: ~inside(x, F.col("_base")) & _secret_block(x["v"]))))
    more = F.filter("_more", lambda x: ~inside(x, F.col("_base")) & _secret_part(x["v"]))
    bare = F.transform(F.concat("_base", more), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    return found.withColumn("spans", F.when((F.size("_base") + F.size("_more")) > 0, F.array_sort(bare)).otherwise(F.array().cast("array<struct<s:int,k:int,e:int>>"))).drop("_base", "_more", "_joined")


def counted(spans: Column, kind: str) -> Column:
    """How many spans are of ``kind``."""
    k = KINDS.index(kind)  # not a second parameter of the lambda: Spark would bind that to the place in the array
    return F.size(F.filter(spans, lambda x: x["k"] == k)).cast("long")


def spelt(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """Spans of ``kinds`` as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    rows = F.filter(spans, lambda x: x["k"] < len(kinds))
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with every span replaced by ``mark``, overlapping spans by one."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def add(acc: Column, x: Column) -> Column:
        keep = F.substring(text, acc["at"] + 1, x["s"] - acc["at"])
        return F.when(x["s"] >= acc["at"], F.struct(F.concat(acc["out"], keep, F.lit(mark)).alias("out"), x["e"].alias("at"))).otherwise(
            F.struct(acc["out"].alias("out"), F.greatest(acc["at"], x["e"]).alias("at"))
        )

    whole = F.aggregate(spans, start, add, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def without_secrets(docs: DataFrame) -> DataFrame:
    """Every document with its secrets redacted and n_chars as the length of its text; clean ones are unchanged."""
    marked = scan(packed(docs, "text"))
    rest = [F.col("_row")[c].alias(c) for c in docs.columns]
    changed = {"text": redacted(F.col("text"), F.col("spans"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("spans") > 0, F.length(changed["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row")["n_chars"])
    return marked.select(*[changed[c].alias(c) if c in changed else rest[i] for i, c in enumerate(docs.columns)])
