"""Line dedup, Merkle manifest and centroid clustering against plain Python."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from florilege.llm import centroids, lines, merkle, queries

SPACE = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_lines(rows, least=2, shortest=10):
    keys = [[low(x.strip(SPACE)) for x in (t or "").split("\n")] for _, t in rows]
    held = {}
    for (i, _), ks in zip(rows, keys, strict=True):
        for k in ks:
            held.setdefault(k, set()).add(i)
    gone = {k: min((i for i in h if i is not None), default=None) for k, h in held.items() if len(k) >= shortest and len(h) >= least}
    out = []
    for (i, t), ks in zip(rows, keys, strict=True):
        stay = [x for x, k in zip((t or "").split("\n"), ks, strict=True) if k not in gone or gone[k] == i]
        out.append((i, "\n".join(stay), len(ks), len(ks) - len(stay)))
    return sorted(out, key=str)


LINES = [
    (4, "A line that is shared\nown words of four"),
    (2, "  a LINE that is Shared\t\nÄrger mit Umlauten\n\nshort\n"),
    (9, "ärger mit umlauten\nÄrger mit Umlauten \nshort\na line that is shared\na line that is shared"),
    (2, "a second row of document two\na line that is shared\r"),
    (9, "ärger mit umlauten\nÄrger mit Umlauten \nshort\na line that is shared\na line that is shared"),
    (None, "a line that is shared\nonly rows without id\nonly rows without id"),
    (None, "only rows without id"),
    (7, None),
    (8, ""),
    (11, "own words of four"),
    (12, "\x0bİstanbul ΣΑΣ line\x0c"),
    (13, "\x0bİstanbul ΣΑΣ LINE"),
    (14, "word " * 100_000 + "\n" + "\n".join(["a line that is shared"] * 20_000)),
]


@pytest.mark.parametrize("least", [2, 3])
def test_lines_against_plain(spark, least):
    docs = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in LINES], "doc_id long, text string, kept string, n_lines int, _row int")
    got = lines.drop_shared(docs, least).select("doc_id", "kept", "n_lines", "n_dropped").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_lines(LINES, least)
    assert lines.drop_shared(docs.limit(0)).count() == 0


def test_lines_of_documents(spark):
    docs = spark.createDataFrame([(1, "a line that is shared", "x", None, 21), (2, "a line that is shared\nmy own", "y", None, 28), (3, None, "z", None, None)], DOCS)
    left = lines.without_shared_lines(docs)
    assert left.columns == docs.columns and left.dtypes == docs.dtypes
    assert sorted(tuple(r) for r in left.collect()) == [(1, "a line that is shared", "x", None, 21), (2, "my own", "y", None, 6), (3, None, "z", None, None)]


def test_one_line_of_a_third_of_all_rows(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 3 == 0, "this very common line\n").otherwise(""), F.lit("own line number "), F.col("id")).alias("text"))
    got = lines.drop_shared(docs).agg(F.sum("n_dropped").alias("gone"), F.sum("n_lines").alias("all"), F.max("n_dropped").alias("most")).first()
    assert tuple(got) == (9_999, 40_000, 1)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def spelt(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(nodes):
    """(root, siblings of each node as (left, right) from below)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for i, p in enumerate(at):
            run = p // 8 * 8
            paths[i].append(("".join(level[run:p]), "".join(level[p + 1 : run + 8])))
        level = [sha("".join(level[k : k + 8])) for k in range(0, len(level), 8)]
        at = [p // 8 for p in at]
    return (level[0] if level else None), paths


def plain_manifest(rows):
    leaf = lambda r, t: sha("".join(spelt(v) for v in (r[0], r[3], r[2], r[4], t)))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    done, subroots = [], []
    for lang in order:
        group = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        subroot, paths = plain_tree([leaf(r, r[1]) for r in group])
        subroots.append(subroot)
        done.append((group, paths))
    root, above = plain_tree(subroots)
    out = []
    for (group, paths), subroot, up in zip(done, subroots, above, strict=True):
        for r, path in zip(group, paths, strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            node = leaf(r, low(r[1]) if tampered else r[1])
            for left, right in path + up:
                node = sha(left + node + right)
            out.append((r[0], leaf(r, r[1]), subroot, root, sha("".join(a + b for a, b in path + up)), node, node == root))
    return sorted(out, key=str)


def manifest_rows():
    rng = np.random.default_rng(3)
    rows = [(i, f"Text {i} of the Manifest", "en", f"s{i % 3}", i) for i in rng.permutation(1300).tolist()]
    rows += [(i, f"deutscher Text {i}", "de", None, None) for i in range(64)]
    rows += [(i, f"nine {i}", "nine", "s", 1) for i in range(9)] + [(5, "one alone", "x", "", 0)]
    rows += [(6, None, None, None, None), (7, "", None, "é", -3), (None, "No Id", None, None, 1), (None, "No Id", None, None, 1), (3, "Twice", "é", "s", 1), (3, "Twice", "é", "s", 1), (3, "Other", "é", "s", 1)]
    return rows


def test_manifest_against_plain(spark):
    rows = manifest_rows()
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("_group", "leaf", "root", "_row", "_place")})
    got = merkle.verified(merkle.manifest(docs.repartition(7)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_manifest(rows)
    assert merkle.manifest(docs.limit(0)).count() == 0


@pytest.mark.parametrize("count", [1, 2, 8, 9, 65, 512, 513])
def test_sizes_of_trees(spark, count):
    rows = [(i, "A text", "en", "s", 1) for i in range(count)]
    got = merkle.verified(merkle.manifest(spark.createDataFrame(rows, DOCS)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_manifest(rows)


def test_equal_rows_are_leaves_of_their_own(spark):
    rows = [(1, "The Same", "en", "s", 1)] * 1200
    got = merkle.verified(merkle.manifest(spark.createDataFrame(rows, DOCS)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_manifest(rows)


def plain_clusters(rows, k=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * float(v))) for v in x]) for i, x in rows if x is not None and len(x) == 64 and all(v is not None and np.isfinite(v) for v in x)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [list(x) for _, x in seeds]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    nearest = lambda x: min((far(x, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for j in range(len(centres)):
            held = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
            centres[j] = [sum(v) // len(held) for v in zip(*held, strict=True)] if held else centres[j]
    last = [nearest(x) for _, x in kept]
    part = [sum(d for d, j in last if j == c) for c in range(len(centres))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    most = (1 << 63) - 1
    return sorted(((i, j, min(d, most), min(part[j], most), min(sum(part), most), names[j]) for (i, _), (d, j) in zip(kept, last, strict=True)), key=str)


def vectors(rng, n):
    middle = rng.normal(size=(12, 64))
    x = (middle[rng.integers(0, 12, n)] + 0.5 * rng.normal(size=(n, 64))).astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)]
    rows += [(9000, None), (9001, []), (9002, [1.0] * 63), (9003, [1.0] * 65), (9004, [None] * 64), (9005, [float("nan")] * 64), (9006, [float("inf")] + [0.0] * 63), (9007, [0.0] * 64), (None, [0.5] * 64)]
    return rows + [rows[0], (3, rows[5][1]), (9008, [2.0] * 64), (9009, [2.0] * 64)]


def clustered(spark, rows):
    got = centroids.clusters(spark.createDataFrame([(i, x, i, "c") for i, x in rows], "vec_id long, embedding array<float>, cluster long, x string"))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_centroids_against_plain(spark):
    rows = vectors(np.random.default_rng(6), 600)
    assert clustered(spark, rows) == plain_clusters(rows)


def test_centroids_of_few_and_equal_rows(spark):
    assert clustered(spark, [(9000, None)]) == []
    for rows in ([(1, [0.25] * 64), (2, [-0.75] * 64)], [(i, [0.25] * 64) for i in range(50)]):
        assert clustered(spark, rows) == plain_clusters(rows)


def test_centroids_beyond_64_bits(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (x * 10.0 ** rng.integers(0, 13)).astype(np.float32).tolist()) for i, x in enumerate(rng.normal(size=(60, 64)))]
    assert clustered(spark, rows) == plain_clusters(rows)


def test_bounds_spare_most_rows(spark):
    """Later rounds measure few rows again, and loosening by the total displacement is tighter than by the sum of drifts."""
    rows = vectors(np.random.default_rng(7), 3000)
    data = centroids.whole_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    _, history, again = centroids.fit(data)
    assert max(again[5:]) < 0.6 * len(rows) and again[-1] < 0.3 * len(rows), again
    ways = centroids._displaced(history, len(history) - 1)[0]
    drifts = sum(centroids._displaced(history[: t + 1], t)[t - 1] for t in range(1, len(history)))
    assert (ways <= drifts + 1e-6).all() and ways.sum() < drifts.sum()


@pytest.mark.parametrize("name", ["op11_lines", "op12_merkle", "op13_centroids"])
def test_sql_on_odd_rows(spark, con, tmp_path, name):
    """The SQL states the same on nulls, repeats and odd texts."""
    rows = [(i, t, lang, s, n) for (i, t), (lang, s, n) in zip(LINES, [("en", "a", 1), (None, None, None)] * 7, strict=False)] + manifest_rows()[-8:]
    tables = {"documents": spark.createDataFrame(rows, DOCS), "embeddings": spark.createDataFrame(vectors(np.random.default_rng(9), 300), "vec_id long, embedding array<float>")}
    for k, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{k}.parquet")
    cur = con.cursor()
    cur.execute("CREATE SCHEMA IF NOT EXISTS odd; SET schema = 'odd'")
    for k in tables:
        cur.execute(f"CREATE OR REPLACE VIEW {k} AS SELECT * FROM read_parquet('{tmp_path}/{k}.parquet/*.parquet')")
    got = queries.QUERIES[name](spark, str(tmp_path))
    want = cur.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(tuple(map(str, r)) for r in got.select(*names).collect()) == sorted(tuple(map(str, r)) for r in want.fetchall())
