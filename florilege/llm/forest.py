"""Embedding near-dedup by a forest of random-projection trees.

Every tree splits the space by random directions at the median; vectors near a cut fall on both sides (spill). Every
distinct vector goes through all trees; what shares a leaf is compared exactly, and found links are united over the trees.

Dense groups are not compared pair by pair: a ball whose members lie within half the threshold angle of its centre
holds only linked pairs, so it is one class with a member count. Two balls whose farthest members still are within the
threshold angle are linked throughout; balls whose nearest members are beyond it are not; only pairs of balls in between
are compared member by member, in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import components
from florilege.session import cut_lineage

COSINE = 0.93
TREES, SPILL = 6, 0.06
#: Rows of a tree's leaf that is dealt to one task, of a block that is compared directly, of a block that balls are cut from.
SHARD, LEAF, COVER = 2048, 256, 1024
#: Most centres that the medians of the trees are taken from; all are placed.
SAMPLE = 4096
#: Members of a ball that meet members of another ball in one block.
CHUNK = 256
_SLACK = 1e-7


def usable(vector: Column) -> Column:
    """Neither null nor zero, and every component a finite number."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first so that no square overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in column]) if len(column) else np.zeros((0, 1))


def plant(sample: np.ndarray, depth: int, spill: float, rng: np.random.Generator) -> list | None:
    """A tree over sampled rows: nested [direction, low, high, left, right]; a leaf is None."""
    if depth <= 0 or len(sample) < 8:
        return None
    way = rng.normal(size=sample.shape[1])
    p = sample @ way
    low, high = np.quantile(p, [0.5 - spill, 0.5 + spill])
    return [way, low, high, plant(sample[p <= high], depth - 1, spill, rng), plant(sample[p > low], depth - 1, spill, rng)]


def leaves(tree: list | None, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, rows in it)."""
    stack = [(tree, np.arange(len(rows)), 1)]
    while stack:
        node, at, name = stack.pop()
        if node is None:
            yield name, at
            continue
        p = rows[at] @ node[0]
        stack += [(node[3], at[p <= node[2]], 2 * name), (node[4], at[p > node[1]], 2 * name + 1)]


def blocks(rows: np.ndarray, most: int, spill: float, seed: int) -> Iterator[np.ndarray]:
    """Index sets of at most ``most`` rows by further random splits; a set that no split parts comes whole."""
    rng, stack = np.random.default_rng(seed), [(np.arange(len(rows)), 0)]
    while stack:
        at, misses = stack.pop()
        if at.size <= most or misses > 8:
            yield at
            continue
        p = rows[at] @ rng.normal(size=rows.shape[1])
        low, high = np.quantile(p, [0.5 - spill, 0.5 + spill])
        left, right = at[p <= high], at[p > low]
        if max(left.size, right.size) > 0.95 * at.size:
            stack.append((at, misses + 1))
        else:
            stack += [(left, 0), (right, 0)]


def cover(x: np.ndarray, radius: np.ndarray, theta: float) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Disjoint balls (members, centre, radius) over rows ``x`` that are balls of ``radius`` themselves."""
    free, out, near = np.ones(len(x), dtype=bool), [], _angle(x @ x.T)
    for i in range(len(x)):
        if not free[i]:
            continue
        held = np.nonzero(free & (near[i] + radius <= theta))[0]
        ball = (np.array([i]), x[i], float(radius[i]))
        if held.size > 1:
            centre = x[held].mean(axis=0)
            size = np.linalg.norm(centre)
            if size > 0.1:
                centre = centre / size
                reach = _angle(x[held] @ centre) + radius[held]
                inside = reach <= theta / 2 - _SLACK
                if inside.sum() > 1 and inside[held == i].any():
                    ball = (held[inside], centre, float(reach[inside].max()))
        free[ball[0]] = False
        out.append(ball)
    return out


def _deal(rows: DataFrame, name: str, trees: int, spill: float, seed: int, width: int, carry: str) -> DataFrame:
    """The columns ``carry`` (a schema) of rows with ``name`` and ``centre``, copied to every (tree, leaf) they fall in."""
    kept = [c.split()[0] for c in carry.split(", ")]
    total = rows.count()
    depth = int(np.ceil(np.log2(max(1, total) / SHARD))) if total > SHARD else 0
    sample = rows.select(name, "centre").orderBy(F.xxhash64(name)).limit(SAMPLE).collect() if depth else []
    held = np.array([list(r.centre) + [0.0] * (width - len(r.centre)) for r in sample]).reshape(-1, width)
    rng = np.random.default_rng(seed)
    grown = [plant(held, depth, spill, rng) for _ in range(trees)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if not len(part):
                continue
            x = np.zeros((len(part), width))
            for i, v in enumerate(part["centre"]):
                x[i, : len(v)] = v
            for t, tree in enumerate(grown):
                for leaf, at in leaves(tree, x):
                    if at.size:
                        yield part[kept].iloc[at].assign(leaf=np.int64(t << 40) + leaf)

    return rows.select(*dict.fromkeys([*kept, "centre"])).mapInPandas(run, f"{carry}, leaf long")


def _per_leaf(rows: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    return rows.groupBy("leaf", "label", F.size("centre").alias("_d")).applyInPandas(fn, schema)


def balls(rows: DataFrame, theta: float, seed: int, width: int) -> DataFrame:
    """(node, ball, centre, radius): the ball of every node; centre and radius stand on the node that names the ball."""

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", ignore_index=True)
        x, r, ids, out = _stack(group["centre"]), group["radius"].to_numpy(), group["node"].to_numpy(), []
        for at in blocks(x, COVER, 0.0, seed):
            for start in range(0, len(at), 4 * COVER):
                part = np.sort(at[start : start + 4 * COVER])
                for members, centre, radius in cover(x[part], r[part], theta):
                    named = ids[part[members]]
                    out += [(n, named[0], centre if n == named[0] else None, radius if n == named[0] else None) for n in named]
        return pd.DataFrame(out, columns=["node", "ball", "centre", "radius"])

    dealt = _deal(rows.select("node", "label", "centre", "radius"), "node", 1, 0.0, seed, width, "node long, label string, centre array<double>, radius double")
    return _per_leaf(dealt, cut, "node long, ball long, centre array<double>, radius double")


def near_balls(rows: DataFrame, members: DataFrame, theta: float, trees: int, spill: float, seed: int, width: int) -> DataFrame:
    """(a, b, sure): pairs of balls that share a leaf and may hold links; sure where all their members are linked.

    A ball is in every leaf that any of its members (node, ball, centre) falls in, so two linked members that share a
    leaf bring their balls together however far apart the centres are. All balls of a leaf are compared.
    """

    def pairs(group: pd.DataFrame) -> pd.DataFrame:
        x, r, ids = _stack(group["centre"]), group["radius"].to_numpy(), group["node"].to_numpy()
        found, at = [], np.arange(len(group))
        for i in range(0, at.size, LEAF):
            for j in range(i, at.size, LEAF):
                a, b = at[i : i + LEAF], at[j : j + LEAF]
                cosine = x[a] @ x[b].T
                p, q = np.nonzero(cosine >= np.cos(min(np.pi, theta + r[a].max() + r[b].max() + 2 * _SLACK)) - _SLACK)
                off = ids[a[p]] < ids[b[q]] if i == j else ids[a[p]] != ids[b[q]]
                p, q = p[off], q[off]
                near, both = cosine[p, q], r[a[p]] + r[b[q]]
                angle = _angle(near)
                sure = np.where(both == 0, near >= np.cos(theta), angle + both <= theta - _SLACK)
                maybe = (both > 0) & (angle - both <= theta + _SLACK) | sure
                one, two = ids[a[p[maybe]]], ids[b[q[maybe]]]
                found.append(pd.DataFrame({"a": np.minimum(one, two), "b": np.maximum(one, two), "sure": sure[maybe]}))
        return pd.concat(found) if found else pd.DataFrame({"a": [], "b": [], "sure": []})

    homes = _deal(members, "node", trees, spill, seed, width, "ball long").distinct()
    dealt = homes.join(rows.select(F.col("node").alias("ball"), "node", "label", "centre", "radius"), "ball").drop("ball")
    return _per_leaf(dealt, pairs, "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure"))


def member_links(unsure: DataFrame, members: DataFrame, theta: float) -> DataFrame:
    """(node, a, b, links): rows that a member of one ball is linked to in the other, for the pairs ``unsure``.

    ``members`` has (node, ball, centre, n). Balls are cut into chunks by hash, and every pair of chunks is a block.
    """
    chunks = members.groupBy("ball").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("k"))
    cut = members.join(chunks, "ball").withColumn("chunk", F.pmod(F.hash("node"), F.col("k")))
    sized = unsure.join(chunks.select(F.col("ball").alias("a"), F.col("k").alias("ka")), "a").join(chunks.select(F.col("ball").alias("b"), F.col("k").alias("kb")), "b")
    met = sized.select("a", "b", F.explode(F.sequence(F.lit(0), F.col("ka") - 1)).alias("ca"), "kb").select("a", "b", "ca", F.explode(F.sequence(F.lit(0), F.col("kb") - 1)).alias("cb"))
    sides = []
    for mine, chunk, left in (("a", "ca", True), ("b", "cb", False)):
        own = cut.select(F.col("ball").alias("_ball"), F.col("chunk").alias("_chunk"), "node", "centre", "n")
        sides.append(met.join(own, (met[mine] == F.col("_ball")) & (met[chunk] == F.col("_chunk"))).select("a", "b", "ca", "cb", "node", "centre", "n", F.lit(left).alias("left")))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        one, two = group[group["left"]], group[~group["left"]]
        if not len(one) or not len(two):
            return pd.DataFrame({"node": [], "a": [], "b": [], "links": []}).astype("int64")
        linked = _stack(one["centre"]) @ _stack(two["centre"]).T >= np.cos(theta)
        counts = np.concatenate([linked @ two["n"].to_numpy(), linked.T @ one["n"].to_numpy()])
        out = pd.DataFrame({"node": np.concatenate([one["node"], two["node"]]), "links": counts.astype("int64")})
        return out[out["links"] > 0].assign(a=group["a"].iloc[0], b=group["b"].iloc[0])[["node", "a", "b", "links"]]

    return sides[0].union(sides[1]).groupBy("a", "b", "ca", "cb").applyInPandas(compare, "node long, a long, b long, links long")


def link_vectors(rows: DataFrame, cosine: float = COSINE, trees: int = TREES, spill: float = SPILL, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding, label).

    Vectors of one label (not null) and one length are linked at a cosine of ``cosine`` or more. Null, zero and
    non-finite vectors and those without a label are alone. Every row is a vector, also where rows repeat; the
    component is the smallest vec_id reachable, itself included; a row without a vec_id is never kept. Other
    columns are not read.
    """
    theta = float(np.arccos(cosine))
    vector = F.col("embedding").cast("array<double>")
    all_rows = rows.select("vec_id", F.col("label").cast("string").alias("label"), vector.alias("v"))
    good = all_rows.where(F.col("label").isNotNull() & usable(F.col("v")))
    same = good.groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    classes = cut_lineage(same.withColumn("node", F.monotonically_increasing_id()))
    width = classes.agg(F.max(F.size("v"))).first()[0] or 1

    @F.pandas_udf("array<double>")
    def scaled(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: unit(np.asarray(v, dtype=float)[None, :])[0])

    units = cut_lineage(classes.select("node", "label", scaled("v").alias("centre"), F.lit(0.0).alias("radius"), "n", "first"))
    one = cut_lineage(balls(units, theta, seed, width))
    labels = units.select("node", "label")
    first = one.where("centre IS NOT NULL").join(labels, "node").select("node", "label", "centre", "radius")
    two = cut_lineage(balls(first, theta, seed + 1, width))
    second = two.where("centre IS NOT NULL").join(labels, "node").select("node", "label", "centre", "radius")
    placed = one.select("node", F.col("ball").alias("_b")).join(two.select(F.col("node").alias("_b"), "ball"), "_b").select("node", "ball")
    members = cut_lineage(units.join(placed, "node"))
    sizes = members.groupBy("ball").agg(F.sum("n").alias("size"), F.min("first").alias("lowest"))
    pairs = cut_lineage(near_balls(second, members, theta, trees, spill, seed + 2, width))
    mixed = cut_lineage(member_links(pairs.where("NOT sure"), members.select("node", "ball", "centre", "n"), theta))
    sure = pairs.where("sure").select("a", "b")
    groups = components(sure.union(mixed.select("a", "b").distinct()))
    both = sure.union(sure.select(F.col("b"), F.col("a")))
    outside = both.join(sizes.select(F.col("ball").alias("b"), "size"), "b").groupBy(F.col("a").alias("ball")).agg(F.sum("size").alias("outside"))
    extra = mixed.groupBy("node").agg(F.sum("links").alias("extra"))
    rooted = sizes.join(groups, sizes["ball"] == groups["node"], "left").select("ball", "size", "lowest", F.coalesce("component", "ball").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("lowest").alias("component_id"))
    by_ball = rooted.join(lowest, "root").join(outside, "ball", "left").select("ball", "component_id", (F.col("size") - 1 + F.coalesce("outside", F.lit(0))).alias("_inner"))
    by_class = members.select("node", "ball").join(by_ball, "ball").join(extra, "node", "left").select("node", "component_id", (F.col("_inner") + F.coalesce("extra", F.lit(0))).alias("n_links"))
    result = classes.select("node", "label", "v").join(by_class, "node").select("label", "v", "n_links", "component_id")
    fine = F.col("label").isNotNull() & usable(F.col("v"))
    linked = all_rows.where(fine).join(result, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = all_rows.where(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
