"""Merkle manifest of a dataset, with one proof per row.

Leaves are numbered in order within their group over range partitions, so that no group is one task. An aligned block
of 8^3 consecutive leaves keeps each of its levels as one string of hex digests: fixed-width substrings of a level are
hashed to the next one, and what flanks a digest in its substring are its siblings. The roots of the blocks are the leaves of
the next, shorter tree, and so on until each group has one root; the roots of the groups go the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.functions.text import let
from florilege.llm.common import packed
from florilege.llm.lines import ascii_lower
from florilege.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, levels within a block, hex digits of a digest.
FAN, HEIGHT, WIDE = 8, 3, 64
BLOCK = FAN**HEIGHT
_SIDES = "array<struct<left:string,right:string>>"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes, so that no two rows spell alike; ``-`` for null."""
    spelt = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(spelt).cast("string"), F.lit(":"), spelt), F.lit("-"))


def leaf(*values: Column) -> Column:
    return sha(F.concat(*[field(v) for v in values]))


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``_place`` (from 0 in ``order`` within ``group``) and ``_of`` (rows of the group).

    Rows are sorted over range partitions, which a last column of row numbers splits even where all of them tie; the
    counts of a group per partition, one small row each, give the offsets.
    """
    ways = [group, *order, "_tie"]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*[F.col(c).asc_nulls_first() for c in ways])
    dealt = cut_lineage(dealt.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ways]).drop("_tie").withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(F.col(group).alias("_whose"), part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    ahead = Window.partitionBy("_whose").orderBy("_part")
    offsets = counts.select(
        "_whose", "_part", "_first",
        F.coalesce(F.sum("_n").over(ahead.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy("_whose")).alias("_of"),
    )
    met = dealt.withColumn("_in", part).join(offsets, (F.col("_in") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_whose")))
    return met.select(*rows.columns, (F.col("_before") + F.col("_at") - F.col("_first")).alias("_place"), "_of")


def parents(level: Column) -> Column:
    """The next level: the hash of each run of ``FAN`` digests, as one string."""
    runs = F.ceil(F.length(level) / (FAN * WIDE)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), runs - 1), lambda i: sha(F.substring(level, i * (FAN * WIDE) + 1, F.lit(FAN * WIDE)))), "")


def levels(first: Column, whole: Column) -> Column:
    """All levels of a block from its leaves up; where it is the ``whole`` of its group a level of one digest is the last."""
    start = F.array(first)
    grow = lambda acc: let(F.element_at(acc, -1), lambda top: F.when(whole & (F.length(top) == WIDE), acc).otherwise(F.concat(acc, F.array(parents(top)))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(HEIGHT)), start, lambda acc, _: grow(acc))


def sides(tree: Column, place: Column) -> Column:
    """Siblings left and right of the digest at ``place`` on each level below the last, from the leaves up."""

    def flank(level: Column, k: Column) -> Column:
        at = F.floor(place / F.pow(F.lit(float(FAN)), k)).cast("int")
        run = F.substring(level, F.floor(at / FAN).cast("int") * (FAN * WIDE) + 1, F.lit(FAN * WIDE))
        own = (at % FAN) * WIDE
        return let(run, lambda r: F.struct(F.substring(r, F.lit(1), own).alias("left"), F.substring(r, own + (WIDE + 1), F.lit(FAN * WIDE)).alias("right")))

    return F.transform(F.slice(tree, F.lit(1), F.size(tree) - 1), flank)


def rooted(rows: DataFrame, group: str, order: list[str], node: str, keep: list[str]) -> DataFrame:
    """Blocks of up to ``BLOCK`` consecutive rows: (_group, _rows, _tree, _top, _up).

    ``node`` is the column of digests. The tree of a group is that of all its rows in ``order``; rows that tie in
    everything have equal digests, so their order among each other does not matter to any digest. ``_tree`` are the
    levels of the block, ``_top`` the root of its group, ``_up`` the siblings on the way from the block's root to it. Work
    shrinks by the size of a block from one round to the next.
    """
    kept = list(dict.fromkeys([node, *keep]))
    numbered = placed(rows.select(group, *[c for c in dict.fromkeys([*order, *kept]) if c != group]), group, order)
    member = F.struct(F.col("_place"), *[F.col(c).alias(f"_m{i}") for i, c in enumerate(kept)])
    ordered = F.array_sort(F.collect_list(member)).alias("_rows")
    blocks = numbered.groupBy(F.col(group).alias("_group"), F.floor(F.col("_place") / BLOCK).alias("_block")).agg(ordered, F.max("_of").alias("_of"))
    blocks = cut_lineage(blocks.withColumn("_tree", levels(F.array_join(F.col("_rows._m0"), ""), F.col("_of") <= BLOCK)))
    root = F.element_at("_tree", -1)
    if blocks.where(F.col("_of") > BLOCK).isEmpty():
        return blocks.select("_group", "_rows", "_tree", root.alias("_top"), F.array().cast(_SIDES).alias("_up"))
    roots = blocks.select(F.col("_group").alias("_owner"), "_block", root.alias("_root"))
    above = paths(rooted(roots, "_owner", ["_block"], "_root", ["_block"]), "_owner", ["_root", "_block"])
    above = above.select("_owner", F.col("_block").alias("_b"), F.col("top").alias("_top"), F.col("path").alias("_up"))
    same = F.col("_group").eqNullSafe(F.col("_owner")) & (F.col("_block") == F.col("_b"))
    return blocks.join(above, same).select("_group", "_rows", "_tree", "_top", "_up")


def paths(blocks: DataFrame, group: str, kept: list[str]) -> DataFrame:
    """(group, *kept, top, path) for each row of ``rooted`` blocks: the root of its group, its siblings on the way there.

    ``kept`` are the digest and the columns kept with it. A group of one row has its digest as root and an empty path.
    """
    one = blocks.select("_group", "_tree", "_top", "_up", F.explode("_rows").alias("_row"))
    path = F.concat(sides(F.col("_tree"), (F.col("_row._place") % BLOCK).cast("int")), F.col("_up"))
    return one.select(F.col("_group").alias(group), *[F.col(f"_row._m{i}").alias(c) for i, c in enumerate(kept)], F.col("_top").alias("top"), path.alias("path"))


def fold(node: Column, path: Column) -> Column:
    """The root that a digest and its siblings give."""
    return F.aggregate(path, node, lambda acc, s: sha(F.concat(s["left"], acc, s["right"])))


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered, subroot, root, path) for each row of ``docs``, the path a list of (left, right) siblings.

    The leaf hashes doc_id, source, lang, n_chars and text. ``tampered`` is the leaf with A-Z of the text in lower case
    where 3 divides the crc32 of the id, else the leaf; rows without an id are not tampered with. Rows of a language (null
    is one) go by doc_id, null first, then by leaf; repeated rows are leaves of their own. Columns of other
    names are not read; a missing one of the five counts as null. An empty table gives an empty result.
    """
    value = lambda name: F.col("_row")[name] if name in docs.columns else F.lit(None).cast("string")
    rows = packed(docs)
    own = leaf(*[value(n) for n in FIELDS])
    low = leaf(*[ascii_lower(value(n)) if n == "text" else value(n) for n in FIELDS])
    picked = F.coalesce(F.crc32(value("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    leaves = rows.select(value("doc_id").alias("doc_id"), value("lang").alias("lang"), own.alias("leaf"), F.when(picked, low).alias("tampered"))
    blocks = rooted(leaves, "lang", ["doc_id", "leaf"], "leaf", ["doc_id", "tampered"])
    # one row per language; any of its blocks knows its root
    roots = blocks.groupBy(F.col("_group").alias("lang")).agg(F.min("_top").alias("subroot")).select(F.lit(0).alias("all"), "lang", "subroot")
    above = paths(rooted(roots, "all", ["lang"], "subroot", ["lang"]), "all", ["subroot", "lang"])
    above = above.select(F.col("lang").alias("_lang"), F.col("top").alias("root"), F.col("path").alias("_above"))
    whole = blocks.join(above, F.col("_group").eqNullSafe(F.col("_lang"))).withColumn("_up", F.struct("_top", "root", F.concat("_up", "_above").alias("up")))
    below = paths(whole.withColumns({"_top": F.col("_up"), "_up": F.col("_up.up")}), "lang", ["leaf", "doc_id", "tampered"])
    return below.select("doc_id", "lang", "leaf", F.coalesce("tampered", "leaf").alias("tampered"), F.col("top._top").alias("subroot"), F.col("top.root").alias("root"), "path")


def verified(marked: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): whether the tampered leaf still gives the root."""
    folded = marked.withColumns({"proof_sha256": sha(proof_text(F.col("path"))), "folded_root": fold(F.col("tampered"), F.col("path"))})
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
