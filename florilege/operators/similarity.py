"""Near copies, which :mod:`florilege.operators.alike` finds, and matches between tables.

In matches between tables two sets with a Jaccard similarity of ``t`` or more must share one of the rarest
``n - ceil(t * n) + 1`` tokens of each, so joining on these prefixes finds every similar pair. No token is dropped and nothing
is capped. Pairs that meet are many more than pairs that are alike: rows carry a sketch of each set, and a pair whose
sketches rule it out goes before any set is fetched.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions.text import jaccard, let
from florilege.operators.alike import Relation, Units, best_primary, chosen, greedy_primaries, signed, sketcher
from florilege.session import cut_lineage


def token_counts(rows: DataFrame, tokens: str) -> DataFrame:
    """Document frequency of each token of a distinct-token array."""
    return rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def prefix_keys(rows: DataFrame, unit: str, tokens: str, threshold: float, counts: DataFrame, tag: str, beside: Column | None = None) -> DataFrame:
    """``(unit, keys)``: the rarest tokens as blocking keys with what :func:`_possible` needs to know of them.

    That is the token's place, the number of tokens, the threshold, and ``beside``, the size of another set that must be
    alike at 0.5 as well where both sides have one.
    """
    sized = rows.select(unit, (F.lit(0) if beside is None else beside).alias("_m"), F.explode(tokens).alias("token"))
    ordered = sized.join(counts, "token").groupBy(unit, "_m").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("_o"))
    n = F.size("_o")
    first = F.slice("_o", 1, (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int"))

    def key(x: Column, i: Column) -> Column:
        return F.struct(F.concat(F.lit(tag), x["token"].cast("string")).alias("key"), i.alias("pos"), n.alias("n"), F.lit(threshold).alias("c"), F.col("_m").alias("m"))

    return ordered.select(unit, F.transform(first, key).alias("keys"))


_PARTS = ("pos", "n", "c", "m")


def _possible() -> Column:
    """Whether the two sides of a key can reach its threshold.

    Sets of sizes a and b with a Jaccard similarity of c share at least c / (1 + c) * (a + b) tokens. At the first key they
    share, they share no token before its place, so no more than the shorter rest.
    """
    rest = F.least(F.col("a_n") - F.col("a_pos"), F.col("b_n") - F.col("b_pos"))
    beside = (F.least("a_m", "b_m") == 0) | (2 * F.least("a_m", "b_m") >= F.greatest("a_m", "b_m"))
    return beside & (rest >= F.col("a_c") / (1 + F.col("a_c")) * (F.col("a_n") + F.col("b_n")) - 1e-9)


#: Two bits a token or more, up to 2,048 tokens: every blocking key carries a sketch.
_sketch_bits = sketcher(32, 64)


def sketch(hashes: str, least: float) -> Column:
    """Size of a set of hashes, the similarity that it must reach, and its bits.

    The number of words grows with the set, and a longer sketch folds onto a shorter one.
    """
    return F.struct(F.size(hashes).alias("n"), F.lit(least).alias("c"), _sketch_bits(F.col(hashes)).alias("bits"))


def _in_reach(a: Column, b: Column) -> Column:
    """Whether two sketched sets may be as similar as they must; an empty set is for the score to judge.

    A bit that only one side has stands for at least one token that the other lacks. Sketches are compared at the shorter
    length; one more than twice as long is not compared.
    """
    words = F.least(F.size(a["bits"]), F.size(b["bits"]))
    zero = F.lit(0).cast("long")

    def word(x: Column, i: Column) -> Column:
        return F.get(x["bits"], i).bitwiseOR(F.when(F.size(x["bits"]) > words, F.get(x["bits"], i + words)).otherwise(zero))

    def count(acc: Column, i: Column) -> Column:
        both = F.array(word(a, i), word(b, i))
        alone = let(both, lambda x: F.bit_count(F.get(x, 0).bitwiseAND(F.bitwise_not(F.get(x, 1)))) * F.lit(1 << 32) + F.bit_count(F.get(x, 1).bitwiseAND(F.bitwise_not(F.get(x, 0)))))
        return acc + alone

    def enough(alone: Column) -> Column:
        shared = F.least(a["n"] - F.shiftright(alone, 32), b["n"] - alone.bitwiseAND(F.lit((1 << 32) - 1)))
        return shared >= a["c"] / (1 + a["c"]) * (a["n"] + b["n"]) - 1e-9

    unlike_sizes = F.greatest(F.size(a["bits"]), F.size(b["bits"])) > 2 * words
    return (a["n"] == 0) | (b["n"] == 0) | unlike_sizes | F.aggregate(F.sequence(F.lit(0), words - 1), zero, count, enough)


def met(a: DataFrame, b: DataFrame, unit: str, ordered: bool = False) -> DataFrame:
    """Distinct pairs ``(a_unit, b_unit)`` of keyed rows that share a key and can be alike; no payload is read.

    Where rows carry sketches, one of the sketched sets must be in reach.
    """
    pairs = a.join(b, "key").filter(_possible())
    if ordered:
        pairs = pairs.filter(F.col(f"a_{unit}") < F.col(f"b_{unit}"))
    if "a_sketches" in a.columns:
        near = F.exists(F.arrays_zip("a_sketches", "b_sketches"), lambda z: _in_reach(z["a_sketches"], z["b_sketches"]))
        # as a generator behind the join: a lambda in its condition would keep the whole join from being compiled
        pair = F.struct(F.col(f"a_{unit}"), F.col(f"b_{unit}"))
        pairs = pairs.select(F.explode(F.when(near, F.array(pair))).alias("_pair")).select("_pair.*")
    return pairs.select(f"a_{unit}", f"b_{unit}").distinct()


def _renamed(rows: DataFrame, unit: str, payload: Sequence[str], name: str) -> DataFrame:
    return rows.select(F.col(unit).alias(f"{name}_{unit}"), *[F.col(c).alias(f"{name}_{c}") for c in payload])


def keyed(rows: DataFrame, unit: str, keys: str, name: str) -> DataFrame:
    """One row for each blocking key, its columns named for one side of a pair; ``sketches`` go along if there are any."""
    rest = [c for c in ("sketches",) if c in rows.columns]
    each = rows.select(F.col(unit).alias(f"{name}_{unit}"), *[F.col(c).alias(f"{name}_{c}") for c in rest], F.explode(keys).alias("_k"))
    return each.select(f"{name}_{unit}", *[f"{name}_{c}" for c in rest], "_k.key", *[F.col(f"_k.{c}").alias(f"{name}_{c}") for c in _PARTS])


def copy_score(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Sum of title and content similarity where two records count as copies, else NULL."""
    t, i = jaccard(a("t"), b("t")), jaccard(a("i"), b("i"))
    both = (F.size(a("i")) > 0) & (F.size(b("i")) > 0)
    alike = ((t >= 0.5) & (i >= 0.5)) | ((i >= 0.9) & (t >= 0.34))
    titled = (t >= 0.8) & (F.size(b("t")) >= 2)
    return F.when(F.when(both, alike).otherwise(titled), t + i)


#: What :func:`copy_score` needs at least: of two records with content, and of two of which one has none.
COPIES = (Relation("i", 0.5, (("t", 0.34),)), Relation("t", 0.8, bare="i"))


def near_duplicates(items: DataFrame, item: str, hot: int | None = None, again: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(item, duplicate_of, score)``: the best earlier primary of each copy, as a sequential pass would find it.

    ``items`` holds the distinct token arrays ``t`` (title) and ``i`` (content). Records with equal arrays are one
    unit, so a large group of exact copies never meets itself. The result is the same for any number ``hot`` of units
    from which they are cut into blocks. ``again`` gives the items of some ids for less than all are read for.
    """
    again = again or (lambda ids: items.join(ids, item, "left_semi"))

    def marked(rows: DataFrame) -> DataFrame:
        arranged = rows.select(item, F.array_sort("t").alias("t"), F.array_sort("i").alias("i"))
        twin = (F.size("t") > 0) & ((F.size("i") > 0) | (F.size("t") >= 2))
        own = F.when(twin, F.lit(0)).otherwise(F.col(item))
        same = F.unhex(F.sha2(F.concat_ws("|", F.array_join("t", " "), F.array_join("i", " "), own.cast("string")), 256)).alias("same")
        # from here on tokens are 64-bit hashes: fewer bytes, and sets of numbers are compared
        return arranged.select(item, same, *[F.transform(c, lambda w: F.xxhash64(w)).alias(c) for c in ("t", "i")])

    def read(ids: DataFrame) -> DataFrame:
        return chosen(marked(again(ids.select(F.col("unit").alias(item)))).withColumnRenamed(item, "unit"), ids)

    base = cut_lineage(signed(marked(items), [item, "same"], ["t", "i"]))
    sizes = [F.first(c).alias(c) for c in base.columns if c not in (item, "same")]
    rows = cut_lineage(base.groupBy("same").agg(F.min(item).alias("unit"), *sizes).withColumn("owner", F.lit("")))
    units = Units(rows, read, COPIES, ("t", "i"), copy_score, block=hot)
    members = cut_lineage(base.select(item, "same").join(rows.select("same", "unit"), "same").select(item, "unit"))
    return best_primary(members, units, cut_lineage(greedy_primaries(units)), item)


def match_verdict(t: Column, i: Column) -> Column:
    """How sure two records are the same: same, maybe or no."""
    same = ((t >= 0.5) & (i >= 0.5)) | ((i >= 0.8) & (t >= 0.3))
    maybe = ((t >= 0.3) & (i >= 0.25)) | (t >= 0.6) | (i >= 0.6)
    return F.when(same, "same").when(maybe, "maybe").otherwise("no")


def cross_match(left: DataFrame, right: DataFrame, unit: str) -> DataFrame:
    """Best record of another corpus for each record: highest sum of title and content similarity.

    Pairs meet on a rare title token at 0.3 or a rare content token at 0.6; equal token sets of the right side
    are one candidate.
    """
    hashed = [F.transform(F.array_sort(c), lambda w: F.xxhash64(w)).alias(c) for c in ("t", "i")]
    uniq = cut_lineage(right.select(unit, *hashed).groupBy("t", "i").agg(F.min(unit).alias(unit)))
    left = cut_lineage(left.select(unit, *hashed))
    pool = left.select("t", "i").unionByName(uniq.select("t", "i"))
    tc, ic = token_counts(pool, "t"), token_counts(pool, "i")

    def keys(rows: DataFrame, name: str) -> DataFrame:
        both = prefix_keys(rows, unit, "t", 0.3, tc, "t:").unionByName(prefix_keys(rows, unit, "i", 0.6, ic, "i:"))
        return keyed(both.join(rows.select(unit, F.array(sketch("t", 0.3), sketch("i", 0.6)).alias("sketches")), unit), unit, "keys", name)

    pairs = met(keys(uniq, "a"), keys(left, "b"), unit)
    joined = pairs.join(_renamed(uniq, unit, ["t", "i"], "a"), f"a_{unit}").join(_renamed(left, unit, ["t", "i"], "b"), f"b_{unit}")
    scored = joined.select(f"a_{unit}", f"b_{unit}", jaccard(F.col("a_t"), F.col("b_t")).alias("t"), jaccard(F.col("a_i"), F.col("b_i")).alias("i"))
    scored = scored.withColumn("verdict", match_verdict(F.col("t"), F.col("i"))).filter("verdict <> 'no'")
    best = scored.groupBy(F.col(f"b_{unit}").alias(unit)).agg(
        F.max_by(F.struct(F.col(f"a_{unit}").alias("match"), "verdict", "t", "i"), F.struct(F.col("t") + F.col("i"), -F.col(f"a_{unit}"))).alias("b")
    )
    return best.select(unit, "b.match", "b.verdict", F.round("b.t", 6).alias("t"), F.round("b.i", 6).alias("i"))


def reparent(items: DataFrame, item: str, parent: str) -> DataFrame:
    """Every item points at the end of its chain; paths halve with each join."""
    state = cut_lineage(items.select(F.col(item).alias("item"), F.col(parent).alias("up")))
    while True:
        above = state.filter(F.col("up").isNotNull()).select(F.col("item").alias("up"), F.col("up").alias("_next"))
        joined = state.join(above, "up", "left")
        state = cut_lineage(joined.select("item", F.coalesce("_next", "up").alias("up"), F.col("_next").isNotNull().alias("_moved")))
        if state.filter("_moved").isEmpty():
            return state.select(F.col("item").alias(item), F.col("up").alias(parent))
        state = state.drop("_moved")


def group_sources(items: DataFrame, item: str, parent: str, url: str) -> DataFrame:
    """Sources of each duplicate group as rows: the primary first, each address once, in order of arrival.

    Rows instead of one array per group: a group may hold a large share of all items.
    """
    group = F.coalesce(F.col(parent), F.col(item))
    rows = items.select(group.alias("primary"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("_late"), F.col(item).alias("_at"), url)
    return rows.groupBy("primary", url).agg(F.min(F.struct("_late", "_at")).alias("_first")).select(
        "primary", url, (F.col("_first._late") == 0).alias("is_primary"), F.col("_first._at").alias("first_item")
    )
