"""Benchmark decontamination by template windows, in DataFrame functions only.

A text becomes a sequence of template words: numbers, capitalised words and units after numbers turn into typed
placeholders, other words into lower case. Windows of five template words are matched by hash with those of the
benchmark; an item is found where enough of its windows are there and its slots are filled consistently, that is each
value of the item has one value in the document. So an item with other numbers or names is found as well. A slot is read
at the shift of a found window that covers it, so words put in or left out within a passage do not misplace its slots.

A second, exact route asks for the lower-cased words themselves: windows of five words, shorter items whole. It needs no
slots and finds copies in any case, and passages that placeholders crowd out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions.text import let
from florilege.llm.common import packed
from florilege.session import cut_lineage

WINDOW = 5
SHARE = 0.8
#: Words of a benchmark window that must not be placeholders.
LITERALS = 2
#: Benchmark windows (16 bytes each and an item id) and suspect pairs up to this number are broadcast; more are joined by shuffle.
BROADCAST_WINDOWS = 500_000
TOKEN = r"[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{M}]+"
#: Units of measure.
UNITS = ("mm", "cm", "m", "km", "in", "ft", "mi", "mg", "g", "kg", "t", "lb", "oz", "ml", "cl", "l", "s", "sec", "min", "h", "hours", "minutes", "seconds", "days", "years", "eur", "usd", "dollars", "euros", "percent", "meters", "miles", "pounds", "liters")


def words(text: Column) -> Column:
    """Numbers and words of a whole text in order; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _kinds(raw: Column) -> tuple[Callable[[Column, Column], Column], ...]:
    """Tests of a word at its place: number, unit after a number, capitalised word. The cheapest comparison comes first."""

    def number(word: Column, i: Column) -> Column:
        return word.between("0", "9~")

    def unit(word: Column, i: Column) -> Column:
        return (i > 0) & number(F.get(raw, i - 1), i) & F.lower(word).isin(*UNITS)

    def name(word: Column, i: Column) -> Column:
        low = F.lower(word)
        return ((word < "a") | (word >= "\u0080")) & (F.length(word) > 1) & (word != low) & (F.substring(word, 2, 1 << 30) == F.substring(low, 2, 1 << 30))

    return number, unit, name


def template(raw: Column, low: Column | None = None) -> Column:
    """For each word 1, 2 or 3 for a number, unit or name, else a hash of its lower case, as ``low`` may have them already."""
    number, unit, name = _kinds(raw)
    told = lambda w, i: F.xxhash64(F.lower(w)) if low is None else F.get(low, i)
    return F.transform(raw, lambda w, i: F.when(number(w, i), 1).when(unit(w, i), 2).when(name(w, i), 3).otherwise(told(w, i)))


def windows(rows: DataFrame, key: str, widths: Sequence[int], literals: int = 0) -> DataFrame:
    """(key, _kind, _at, _window): hash of every window of template words, of which ``literals`` must be no placeholders, as
    kind 0; and of every run of ``widths`` lower-cased words, as the kind of that width."""

    def ahead(t: Column, by: int) -> Column:
        return F.slice(t, by + 1, F.greatest(F.size(t) - by, F.lit(0)))

    def joined(a: Column, b: Column) -> Column:
        return F.zip_with(F.slice(a, 1, F.size(b)), b, lambda x, y: F.xxhash64(x, y))

    def runs(t: Column, width: int) -> Column:
        """Hashes of ``width`` neighbours, for the window by way of one, two and four."""
        if width == WINDOW:
            pairs = lambda two: let(joined(two, ahead(two, 2)), lambda four: joined(four, ahead(t, WINDOW - 1)))
            return let(joined(t, ahead(t, 1)), pairs)
        return t if width == 1 else joined(runs(t, width - 1), ahead(t, width - 1))

    def hashes(t: Column) -> Column:
        every = runs(t, WINDOW)
        if not literals:
            return every
        told = lambda i: sum((F.when(F.get(t, i + k).between(1, 3), 0).otherwise(1) for k in range(WINDOW)), F.lit(0))
        return F.transform(every, lambda h, i: F.when(told(i) >= literals, h))

    def entries(raw: Column) -> Column:
        """Template windows of one text, then its runs of each width, and where each of these lists starts."""

        def lists(low: Column) -> Column:
            both = lambda t: F.array(hashes(t), *[runs(low, w) for w in widths])
            return let(template(raw, low), both)

        return let(F.transform(raw, lambda w: F.xxhash64(F.lower(w))), lists)

    # hashes are made before the rows are multiplied: an exploded row would carry all words of its text; and
    # an inner explode would add a filter that computes them a second time
    kinds = F.array(F.lit(0), *[F.lit(w) for w in widths])
    hashed = rows.select(key, let(words(F.col("text")), entries).alias("_h"))
    each = hashed.select(key, F.posexplode_outer("_h").alias("_list", "_hashes"))
    return each.select(key, F.get(kinds, F.col("_list")).alias("_kind"), F.posexplode_outer("_hashes").alias("_at", "_window")).where("_window IS NOT NULL")


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, windows, found, slots, changed) for every benchmark item found in a document.

    windows: distinct windows of the item; found: those anywhere in the document; slots: distinct values of its
    placeholders; changed: those with another value in the document. A pair that only the exact route finds counts windows
    of words, and no value as changed. Rows that share a doc_id are judged as one document, rows without a doc_id or
    item_id are left out, null and empty texts match nothing, repeated items count once per item_id. An item of fewer
    than five words is found where its words stand in a row.
    """
    texts = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    items = benchmark.select("item_id", "text").where("item_id IS NOT NULL").dropDuplicates()
    sized = items.withColumn("_n", F.least(F.size(words(F.col("text"))), F.lit(WINDOW))).where("_n > 0")
    widths = sorted(r._n for r in sized.select("_n").distinct().collect()) or [WINDOW]
    # an item may have several texts: each is asked for at its own width
    own = windows(sized.select(F.struct("item_id", "_n").alias("_item"), "text"), "_item", widths, LITERALS)
    mine = own.where((F.col("_kind") == 0) | (F.col("_kind") == F.col("_item._n")))
    asked = cut_lineage(mine.select("_item.item_id", "_kind", "_window", F.col("_at").alias("_i")).distinct())
    sizes = asked.groupBy("item_id", "_kind").agg(F.countDistinct("_window").alias("windows"))
    few = asked.count() <= BROADCAST_WINDOWS
    seen = windows(texts, "doc_id", widths).join(F.broadcast(asked) if few else asked, ["_kind", "_window"])
    # short items have one window, and where it stands does not matter
    whole = F.col("_kind").between(1, WINDOW - 1)
    put = seen.select("doc_id", "item_id", "_kind", "_window", "_i", F.when(whole, 0).otherwise(F.col("_at") - F.col("_i")).alias("_shift"))
    # one row per document, item, shift and window before anything is counted
    once = cut_lineage(put.groupBy("doc_id", "item_id", "_kind", "_shift", "_window").agg(F.collect_set("_i").alias("_is")))
    found = once.groupBy("doc_id", "item_id", "_kind").agg(F.countDistinct("_window").alias("found"))
    enough = cut_lineage(found.join(sizes, ["item_id", "_kind"]).where(F.col("found") >= share * F.col("windows")))
    shift = once.where("_kind = 0").groupBy("doc_id", "item_id", "_shift").agg(F.count("*").alias("_n"))
    best = shift.groupBy("doc_id", "item_id").agg(F.max_by("_shift", F.struct("_n", -F.col("_shift"))).alias("_best"))
    likely = cut_lineage(enough.where("_kind = 0").drop("_kind").join(best, ["doc_id", "item_id"]))
    few = likely.count() <= BROADCAST_WINDOWS
    filled = cut_lineage(consistent(likely, once.where("_kind = 0").join(F.broadcast(likely) if few else likely, ["doc_id", "item_id"]), texts, items, few))
    exact = enough.where("_kind > 0").join(filled.select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti")
    return filled.unionByName(verbatim(exact, items))


def verbatim(exact: DataFrame, items: DataFrame) -> DataFrame:
    """The pairs ``exact`` (found by their words) with the placeholder values of their items, none of them changed."""
    spelt = items.select("item_id", words(F.col("text")).alias("_w")).select("item_id", "_w", let(F.col("_w"), lambda w: template(w)).alias("_t"))
    values = F.array_distinct(F.filter("_w", lambda w, i: F.get("_t", i).between(1, 3)))
    slots = spelt.select("item_id", F.explode_outer(values).alias("_v")).groupBy("item_id").agg(F.countDistinct("_v").cast("int").alias("slots"))
    # an item with texts of several lengths may be found at more than one width
    rows = exact.groupBy("doc_id", "item_id").agg(F.max("windows").alias("windows"), F.max("found").alias("found"))
    return rows.join(slots, "item_id").select("doc_id", "item_id", "windows", "found", "slots", F.lit(0).alias("changed"))


def consistent(likely: DataFrame, places: DataFrame, texts: DataFrame, items: DataFrame, few: bool) -> DataFrame:
    """Keep the pairs whose placeholders map each value of the item to one value of the document.

    A slot has the value at the shift of a found window that covers it, of several that next to the best shift; a slot
    in no found window is read at the best shift where the template words about it are equal, else not at all.
    """
    away = F.abs(F.col("_shift") - F.col("_best"))
    each = places.select("doc_id", "item_id", "windows", "found", "_best", F.explode("_is").alias("_i"), "_shift", away.alias("_away"))
    runs = F.array_sort(F.collect_list(F.struct(F.col("_away").alias("away"), F.col("_shift").cast("int").alias("shift"), F.col("_i").cast("int").alias("i"))))
    ids = likely.select("doc_id").distinct()
    if few:  # a few ids: the texts need no shuffle to be picked out
        ids = F.broadcast(ids)
    own = texts.join(ids, "doc_id", "left_semi").select("doc_id", words(F.col("text")).alias("_d")).select("doc_id", "_d", let(F.col("_d"), lambda w: template(w)).alias("_dt"))
    asked = items.select("item_id", words(F.col("text")).alias("_w")).select("item_id", "_w", let(F.col("_w"), lambda w: template(w)).alias("_t"))
    aligned = each.groupBy("doc_id", "item_id", "windows", "found", F.col("_best").cast("int").alias("_best")).agg(runs.alias("_runs"))
    both = aligned.join(asked, "item_id").join(own, "doc_id")

    def equal(i: Column, by: Column) -> Column:
        """Whether the template window at ``i`` of the item is that of this text ``by`` words on."""
        mine = F.slice("_t", i + 1, WINDOW)
        return (i >= 0) & (i + by >= 0) & (F.size(mine) == WINDOW) & (mine == F.slice("_dt", F.greatest(i + by, F.lit(0)) + 1, WINDOW))

    def covering(i: Column) -> Column:
        """The shift at which slot ``i`` is read; null if no window covers it."""
        first = F.get(F.filter("_held", lambda r: (r["i"] <= i) & (i < r["i"] + WINDOW)), F.lit(0))["shift"]
        starts = F.sequence(F.greatest(i - WINDOW + 1, F.lit(0)), i)
        return F.coalesce(first, F.when(F.exists(starts, lambda k: equal(k, F.col("_best"))), F.col("_best")))

    # rows that share an id: a run counts for the texts that hold it, and texts that hold none are no evidence
    held = both.withColumn("_held", F.filter("_runs", lambda r: equal(r["i"], r["shift"]))).where(F.size("_held") > 0)
    slot = F.filter(F.sequence(F.lit(0), F.size("_t") - 1), lambda i: F.get("_t", i).between(1, 3))
    placed = held.withColumn("_slots", F.filter(F.transform(slot, lambda i: F.struct(i.alias("i"), covering(i).alias("by"))), lambda x: x["by"].isNotNull()))
    pairs = F.array_distinct(F.transform("_slots", lambda x: F.struct(F.get("_w", x["i"]).alias("item"), F.get("_d", x["i"] + x["by"]).alias("doc"))))
    valued = placed.select("doc_id", "item_id", "windows", "found", pairs.alias("_p"))
    values = F.size(F.array_distinct(F.col("_p.item")))
    rows = valued.select("doc_id", "item_id", "windows", "found", values.alias("slots"), F.size(F.filter("_p", lambda p: p["item"] != p["doc"])).alias("changed"), (F.size("_p") - values).alias("_odd"))
    # a few slots may differ where a passage was cut or a sentence broken off
    good = rows.where(F.col("_odd") <= round(1 - SHARE, 6) * F.col("slots"))
    return good.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("windows", "found", "slots")], F.min("changed").alias("changed"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns.

    Each row is judged by its own text, so rows without an id are judged as well and rows that share one apart.
    """
    rows = packed(docs, "text").withColumn("_print", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    bad = leaks(rows.select(F.col("_print").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_leak")).distinct()
    return rows.join(bad, F.col("_print") == F.col("_leak"), "left_anti").select("_row.*")
