"""Near copies against brute force: fingerprints, vectors, connected components."""

import re
import time

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from florilege.llm import forest, simhash
from florilege.llm.common import components, joined_links


def plain_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def smallest_reachable(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("text", ["", None, " \t\n", "one", "One two\tTHREE", "a b c d", "Á É á é x y z", "a b c d e " * 50, "x\x0by\x0cz\xa0w v"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_groups_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    prints = np.array([plain_fingerprint(r.text) for r in rows], dtype=np.uint64)
    a, b = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4)
    want = smallest_reachable(len(rows), zip(a.tolist(), b.tolist(), strict=True))
    got = {r.doc_id: r for r in simhash.near_groups(docs).collect()}
    assert [got[r.doc_id].component_id for r in rows] == [rows[k].doc_id for k in want]
    assert [got[r.doc_id].fp & (1 << 64) - 1 for r in rows] == prints.tolist()


@pytest.mark.parametrize("most", [65_536, 150])
def test_links_over_many_shards(spark, monkeypatch, most):
    """Close fingerprints with a tree of many levels, in tasks that split on or take pairs of blocks, equal all pairs."""
    monkeypatch.setattr(simhash, "HOME", 64)
    monkeypatch.setattr(simhash, "MOST_ROWS", most)
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 63, 500, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flips = [np.uint64(sum(1 << int(b) for b in rng.choice(64, k, replace=False))) for k in rng.integers(0, 7, 1500)]
    points = np.unique(np.concatenate([seeds, rng.choice(seeds, 1500) ^ np.array(flips)]))
    a, b = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 4)
    want = joined_links(np.arange(len(points)), a, b)
    fps = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    got = simhash.links(fps).collect()
    place = {int(p): i for i, p in enumerate(points.view(np.int64))}
    found = joined_links(np.arange(len(points)), np.array([place[r.a] for r in got]), np.array([place[r.b] for r in got]))
    assert found.tolist() == want.tolist()
    assert joined_links(np.arange(len(points)), *np.nonzero(simhash.linked(points)[:, None] == simhash.linked(points)[None, :])).tolist() == want.tolist()


def test_points_of_a_shard_meet_on_equal_pieces():
    """Many points that share a piece, beside random ones; and a large shard, whose pairs were nearly all compared before."""
    rng = np.random.default_rng(6)
    crowd = np.uint64(5 << 50) ^ rng.integers(0, 1 << 12, 3000, dtype=np.uint64) ^ (rng.integers(0, 1 << 10, 3000, dtype=np.uint64) << np.uint64(26))
    points = np.unique(np.concatenate([crowd, rng.integers(0, 1 << 63, 2000, dtype=np.uint64)]))
    want = joined_links(np.arange(len(points)), *np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 4))
    assert simhash.linked(points).tolist() == want.tolist()
    assert simhash.linked(points[:0]).tolist() == [] and simhash.linked(points[:1]).tolist() == [0]
    many = np.unique(rng.integers(0, 1 << 63, 50_000, dtype=np.uint64))
    start = time.process_time()
    simhash.linked(many)
    assert time.process_time() - start < 4


def test_one_of_each(spark):
    text = "this is a text of several words that two rows share"
    rows = [(3, text, "x"), (1, text, "y"), (1, text, "y"), (None, text, "n"), (5, "", "e"), (6, None, "e"), (7, "another thing altogether is said here", "z")]
    rows += [(None, "rows without any id are near copies of each other too", k) for k in "abc"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept string")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, rows[-1][1]), (1, text), (5, ""), (7, "another thing altogether is said here")]
    groups = simhash.near_groups(docs).collect()
    assert {(r.doc_id, r.component_id) for r in groups} == {(3, 1), (1, 1), (None, 1), (5, 5), (6, 5), (7, 7), (None, None)}
    assert simhash.near_groups(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [tuple(map(int, rng.integers(200, 400, 2))) for _ in range(150)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = smallest_reachable(400, links)
    assert got == {n: want[n] for link in links for n in link if link[0] != link[1]} | {n: c for n, c in got.items() if want[n] == c}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def clustered(rng, width=24):
    """Vectors in tight, middling and wide groups, copies, scaled copies, and many without company."""
    rows = []
    for noise, size in ((0.0, 8), (0.05, 60), (0.2, 60), (0.36, 80), (0.42, 80), (0.5, 40)):
        for _ in range(3):
            centre = rng.normal(size=width)
            centre /= np.linalg.norm(centre)
            near = rng.normal(size=(size, width))
            rows.append((centre + noise * near / np.linalg.norm(near, axis=1, keepdims=True)) * rng.uniform(0.5, 9, (size, 1)))
    rows.append(rng.normal(size=(300, width)))
    return np.concatenate(rows).astype(np.float32)


@pytest.mark.parametrize(("shard", "leaf", "chunk"), [(2048, 256, 256), (128, 40, 16)])
def test_forest_against_all_pairs(spark, monkeypatch, shard, leaf, chunk):
    monkeypatch.setattr(forest, "SHARD", shard)
    monkeypatch.setattr(forest, "LEAF", leaf)
    monkeypatch.setattr(forest, "CHUNK", chunk)
    rng = np.random.default_rng(4)
    x = clustered(rng)
    label = rng.integers(0, 2, len(x))
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (y @ y.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(links, False)
    want = smallest_reachable(len(x), zip(*(a.tolist() for a in np.nonzero(links)), strict=True))
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r for r in forest.link_vectors(df).collect()}
    degree = links.sum(axis=1)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= degree).all()
    assert found.sum() >= 0.97 * degree.sum()
    assert np.mean([got[i].component_id == want[i] for i in range(len(x))]) >= 0.97
    assert all(got[i].component_id >= want[i] for i in range(len(x)))


def test_wide_balls_in_deep_trees(spark, monkeypatch):
    """Pairs of wide balls whose centres are far apart, by one tree without spill: members bring their balls together."""
    monkeypatch.setattr(forest, "SHARD", 16)
    monkeypatch.setattr(forest, "LEAF", 16)
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(60):
        one, two = rng.normal(size=(2, 64))
        one /= np.linalg.norm(one)
        two -= (two @ one) * one
        two /= np.linalg.norm(two)
        rows += [np.cos(t) * one + np.sin(t) * two + 0.002 * rng.normal(size=64) for t in np.linspace(0, 1.05, 25)]
    x = np.array(rows, dtype=np.float32)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    degree = (y @ y.T >= 0.93).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    found = np.array([r.n_links for r in sorted(forest.link_vectors(df, trees=1, spill=0.0).collect(), key=lambda r: r.vec_id)])
    assert (found <= degree).all()
    assert found.sum() >= 0.82 * degree.sum(), found.sum() / degree.sum()


def test_forest_edges(spark):
    one = [1.0, 2.0, 3.0]
    rows = [(1, one, 5), (2, [2.0, 4.0, 6.0], 5), (3, one, 6), (4, one, None), (5, None, 5), (6, [0.0, 0.0, 0.0], 5), (7, [1.0, None, 3.0], 5), (8, [1.0, float("nan"), 1.0], 5), (9, [1.0, float("inf"), 1.0], 5), (10, [], 5), (11, [1.0, 2.0], 5), (2, [2.0, 4.0, 6.0], 5), (None, one, 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("n_links", F.lit("clash"))
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in forest.link_vectors(df).collect())
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted([(0, 3, 1, False), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), *alone])
    assert forest.link_vectors(df.limit(0)).count() == 0
