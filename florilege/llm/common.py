"""What the operators of this package share: folds, bounded samples, links inside a task and across the cluster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.session import cut_lineage


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns beside the whole row as the struct ``_row``, so that no other column's name can clash."""
    return docs.select(*names, F.struct("*").alias("_row"))


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text modulo ``folds``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def labelled_sample(labels: DataFrame, name: str, folds: int, held: int, most: int, key: str = "doc_id") -> DataFrame:
    """At most ``most`` ids with their label ``name``, in the order of their hash, none of the held-out fold.

    An id with several labels has the largest; null ids and null labels teach nothing.
    """
    known = labels.where(F.col(name).isNotNull() & F.col(key).isNotNull() & (fold(F.col(key), folds) != held))
    one = known.groupBy(F.col(key).alias("_id")).agg(F.max(name).alias("_label"))
    return one.orderBy(F.xxhash64("_id"), "_id").limit(most)


def with_labels(texts: DataFrame, sample: DataFrame, key: str = "doc_id") -> DataFrame:
    """(_id, text, _label) of the sampled ids; ``sample`` has a bounded number of rows, so it is broadcast."""
    return texts.select(F.col(key).alias("_id"), "text").join(F.broadcast(sample), "_id").select("_id", "text", "_label")


def joined_links(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Add the links a-b to the forest ``parent`` (every node points to the smallest of its tree) and return it."""
    while a.size:
        left, right = parent[a], parent[b]
        apart = left != right
        if not apart.any():
            break
        a, b, left, right = a[apart], b[apart], left[apart], right[apart]
        low = np.minimum(left, right)
        np.minimum.at(parent, left, low)
        np.minimum.at(parent, right, low)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def batches_of(rows: Iterator[pa.RecordBatch], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of no more than ``most`` rows, so that one batch of long texts stays small."""
    for batch in rows:
        for start in range(0, batch.num_rows, most):
            yield batch.slice(start, most).select(schema.names) if schema else batch.slice(start, most)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links`` (a, b): the smallest node reachable, itself included.

    Alternating stars: each round points all larger neighbours of a node to its smallest one, then all smaller ones,
    until nothing changes. A round is two aggregates and two joins on a node; a hot node is pre-aggregated in the
    first and split by the adaptive skew join in the second. Every round is written to the checkpoint folder.
    """
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == before:
            break
        before = state
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).select("k", F.least("k", "m").alias("m"))
        large = both.join(low, both["a"] == low["k"]).where("b > k").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        small = large.join(least, large["a"] == least["k"]).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = cut_lineage(small.where("a <> b").distinct())
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
