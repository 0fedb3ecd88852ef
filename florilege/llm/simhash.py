"""SimHash near-dedup over vantage-point trees.

Fingerprints are dealt to shards by their Hamming distance to vantage points: up to a cut goes inside, the rest
outside. A pair within ``reach`` bits that a node parts has its outer member no farther than cut + reach (triangle
inequality), so such outer rows also visit the inside and every other branch is pruned. Every linked pair meets
in some shard. There a pair agrees in one of ``reach + 1`` pieces of the fingerprint, so only points of an equal piece
are compared; where too many share one, the same splits go on until a block is small enough. Results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from florilege.llm.common import batches_of, components, joined_links, packed
from florilege.session import cut_lineage

REACH = 4
WORDS = 4
#: Distinct fingerprints that a shard should hold at home.
HOME = 16_384
#: Rows of a shard that one task takes whole, partitions that shards are dealt to, rows that a block compares directly.
MOST_ROWS, MOST_TASKS, BLOCK = 262_144, 20_000, 768
#: Most fingerprints that vantage points and medians are taken from; every fingerprint is then placed.
SAMPLE = 16_384


def fingerprint(text: str | None) -> int:
    """Bits set in over half of the XXH64 hashes (seed 42) of the shingles of a text; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(WORDS, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, _print): one row per row of ``docs``, the fingerprint as a signed long. Null texts count as empty.

    ``_print`` is the SHA-256 of the text where there is no doc_id, else null.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    print_of = F.when(F.col("doc_id").isNull(), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(rows, None):
            values = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(values.view(np.int64)), batch.column("_print")], names=["doc_id", "fp", "_print"])

    return docs.select("doc_id", "text", print_of.alias("_print")).mapInArrow(run, f"doc_id {kind}, fp long, _print string")


def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage)


def _split(points: np.ndarray, tries: int = 6) -> tuple[np.uint64, int] | None:
    """The vantage point and distance among a few that leave the fewest rows on both sides; None if nothing is parted.

    The distance need not be the median: fingerprints crowd at 32 bits, where a cut sends most rows to both sides.
    """
    best = None
    for vantage in points[np.linspace(0, len(points) - 1, tries).astype(int)]:
        d = _distance(points, vantage)
        for middle in sorted({int(q) for q in np.quantile(d, (0.2, 0.35, 0.5, 0.65))}):
            inner, outer = int((d <= middle + REACH).sum()), int((d > middle).sum())
            # work within a side grows with the square of its rows
            cost = inner * inner + outer * outer
            if outer and inner < len(points) and (best is None or cost < best[0]):
                best = (cost, vantage, middle)
    return best and (best[1], best[2])


def vantage_tree(points: np.ndarray, depth: int) -> list:
    """Nested [vantage, distance, inside, outside] over a sample with its spill; a leaf is None.

    A node is split to the depth asked for, by one rule at any size, unless it is too few points to tell or no cut parts
    it well.
    """
    cut = _split(points) if depth and len(points) >= 16 else None
    if cut is None:
        return None
    d = _distance(points, cut[0])
    inside, outside = points[d <= cut[1] + REACH], points[d > cut[1]]
    if len(inside) > 0.95 * len(points):
        return None
    return [cut[0], cut[1], vantage_tree(inside, depth - 1), vantage_tree(outside, depth - 1)]


def placed(tree: list | None, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of point, shard) for every shard that a point must be in."""
    rows, shards, stack = [], [], [(tree, np.arange(len(points)), 1)]
    while stack:
        node, at, name = stack.pop()
        if not at.size:
            continue
        if node is None:
            rows.append(at), shards.append(np.full(at.size, name, dtype=np.int64))
            continue
        d = _distance(points[at], node[0])
        stack += [(node[2], at[d <= node[1] + REACH], 2 * name), (node[3], at[d > node[1]], 2 * name + 1)]
    return (np.concatenate(rows), np.concatenate(shards)) if rows else (np.zeros(0, int), np.zeros(0, int))


#: Pieces of a fingerprint as (shift, mask): of two within ``REACH`` bits one piece at least is equal.
PIECES = [(64 * i // (REACH + 1), (1 << 64 * (i + 1) // (REACH + 1) - 64 * i // (REACH + 1)) - 1) for i in range(REACH + 1)]


def linked(points: np.ndarray) -> np.ndarray:
    """For each of the distinct ``points`` the index of the smallest point it is connected to.

    Points that share a piece are neighbours once sorted by it, and all groups are compared at one distance in the order
    after another. Groups of more than ``BLOCK`` points of one piece are split further.
    """
    parent, stack = np.arange(len(points)), []
    for shift, mask in PIECES:
        piece = (points >> np.uint64(shift)) & np.uint64(mask)
        order = np.argsort(piece, kind="stable")
        starts = np.flatnonzero(np.diff(piece[order], prepend=piece[order[:1]] + np.uint64(1)))
        sizes = np.diff(np.append(starts, len(points)))
        stack += [order[a : a + n] for a, n in zip(starts[sizes > BLOCK].tolist(), sizes[sizes > BLOCK].tolist(), strict=True)]
        after = np.repeat(np.where(sizes > BLOCK, 0, starts + sizes), sizes) - np.arange(len(points))
        live, away = np.flatnonzero(after > 1), 1
        while live.size:
            a, b = order[live], order[live + away]
            near = np.bitwise_count(points[a] ^ points[b]) <= REACH
            parent = joined_links(parent, a[near], b[near])
            away += 1
            live = live[after[live] > away]
    while stack:
        at = stack.pop()
        cut = _split(points[at]) if at.size > BLOCK else None
        if cut is not None:
            d = _distance(points[at], cut[0])
            inside = at[d <= cut[1] + REACH]
            if inside.size <= 0.95 * at.size:
                stack += [inside, at[d > cut[1]]]
                continue
        for i in range(0, at.size, BLOCK):
            for j in range(i, at.size, BLOCK):
                a, b = at[i : i + BLOCK], at[j : j + BLOCK]
                x, y = np.nonzero(np.bitwise_count(points[a][:, None] ^ points[b][None, :]) <= REACH)
                off = a[x] < b[y] if i == j else a[x] != b[y]
                parent = joined_links(parent, a[x[off]], b[y[off]])
    return parent


def links(fps: DataFrame) -> DataFrame:
    """(a, b): for every connected group of distinct fingerprints ``fp`` of a shard, links that connect it.

    A shard of more than ``MOST_ROWS`` rows after all splits is cut into blocks by hash, and every pair of its blocks is a
    task of its own, so no task grows with the table. What a task knows of shards is at most their tree and their sizes: as
    many as the sample has room for.
    """
    total = fps.count()
    depth = max(0, int(np.ceil(np.log2(max(1, total) / HOME))))
    few = fps.orderBy(F.xxhash64("fp")).limit(SAMPLE).collect() if depth else []
    sample = np.array([r.fp for r in few], dtype=np.int64)
    tree = vantage_tree(sample.view(np.uint64), depth)

    def dealt(blocks: dict[int, int] | None):
        def deal(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                points = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
                at, shard = placed(tree, points.view(np.uint64))
                if blocks is None:
                    yield pa.record_batch([pa.array(shard)], names=["shard"])
                    continue
                parts = np.array([blocks.get(s, 1) for s in shard.tolist()], dtype=np.int64)
                own = ((points[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
                each = np.repeat(np.arange(len(at)), parts)
                other = np.arange(len(each)) - np.repeat(np.cumsum(parts) - parts, parts)
                columns = [points[at][each], shard[each], np.minimum(own[each], other), np.maximum(own[each], other)]
                yield pa.record_batch([pa.array(c) for c in columns], names=["fp", "shard", "one", "two"])

        return deal

    def stars(group: pd.DataFrame) -> pd.DataFrame:
        points = np.sort(group["fp"].to_numpy(dtype=np.int64))
        parent = linked(points.view(np.uint64))
        inner = np.nonzero(parent != np.arange(len(points)))[0]
        return pd.DataFrame({"a": points[inner], "b": points[parent[inner]]})

    sizes = fps.mapInArrow(dealt(None), "shard long").groupBy("shard").count().collect() if depth else []
    blocks = {r["shard"]: -(-r["count"] // MOST_ROWS) for r in sizes}
    tasks = sum(b * (b + 1) // 2 for b in blocks.values()) or 1
    pairs = fps.mapInArrow(dealt(blocks), "fp long, shard long, one long, two long")
    # as many partitions as tasks: their work is far more than their bytes, so they are not to be coalesced
    return pairs.repartition(min(tasks, MOST_TASKS), "shard", "one", "two").groupBy("shard", "one", "two").applyInPandas(stars, "a long, b long")


def _grouped(docs: DataFrame) -> DataFrame:
    """The fingerprints of ``docs`` with ``root`` and ``component_id``: the least fingerprint and doc_id of their group."""
    marked = cut_lineage(fingerprints(docs))
    classes = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    groups = components(links(classes.select("fp")))
    joined = classes.join(groups, classes["fp"] == groups["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(joined.join(lowest, "root").select("fp", "root", "component_id"), "fp").select("doc_id", "fp", "_print", "root", "component_id")


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``: the smallest doc_id reachable over links, itself included.

    Rows of equal fingerprint are one class from the start, so copies are never paired. Rows without a doc_id
    have a null component unless a row with an id is reachable. An empty table gives an empty result.
    """
    return _grouped(docs).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: that with the smallest id, or, if the group has no id at all, that with the
    smallest hash of its text. Of repeated rows of one id, or of one text without an id, stays one."""
    groups = cut_lineage(_grouped(docs))
    ids = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_kept")).distinct()
    rows = packed(docs, "doc_id", "text")
    with_id = rows.where("doc_id IS NOT NULL").join(ids, F.col("doc_id") == F.col("_kept"), "left_semi")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))).alias("_place")
    first = with_id.select("_row", place).where("_place = 1").select("_row")
    prints = groups.where("doc_id IS NULL AND component_id IS NULL").groupBy("root").agg(F.min("_print").alias("_kept")).select("_kept")
    bare = rows.where("doc_id IS NULL").withColumn("_print", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    one = bare.join(prints, F.col("_print") == F.col("_kept"), "left_semi").groupBy("_print").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return first.union(one.select("_row")).select("_row.*")
