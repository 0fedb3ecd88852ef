"""Exact k-means on integer vectors with norm-of-sum bounds.

The centroids of all rounds are kept. A row stores, from the round in which it was last measured, its distance to its own
centroid and to every other one. Later rounds loosen these by the norm of each centroid's total displacement since
then (not by the sum of its drifts per round): while the own distance plus its displacement is below every other
distance less its displacement, no centroid but the own one can be nearest. All other rows are measured again exactly.

Since loosening needs only the history, rows are not written in every round but in rounds 1, 2, 4, 8 and so on; between
these a round reads the rows and gives only sums per centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from florilege.session import scratch_folder

CENTROIDS, ROUNDS, WIDTH, SCALE = 8, 10, 64, 1024
#: Part by which bounds are loosened besides, for the rounding of roots and of single-precision bounds.
_SLACK = 1e-5
#: Components up to here have squared distances that fit 64 bits; beyond, whole numbers of any size are used.
_PLAIN = 1 << 27
_MOST = (1 << 63) - 1


def whole_vectors(rows: DataFrame, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): rows with exactly ``width`` finite components, each as floor(scale * component) in 64 bits."""
    fine = F.forall("embedding", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    kept = rows.select("vec_id", "embedding").where((F.size("embedding") == width) & fine)
    # a cast of a double holds at the ends of the 64-bit range, floor of doubles beyond it would fail
    low = lambda v: F.floor(F.greatest(F.least(v.cast("double") * scale, F.lit(9.2e18)), F.lit(-9.2e18)))
    return kept.select("vec_id", F.transform("embedding", low).alias("x"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS) -> np.ndarray:
    """The ``k`` vectors with the smallest SHA-256 of ``3:<vec_id>``; equal ids go by their components, no id comes last."""
    seed = F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.orderBy(seed.asc_nulls_last(), "x").limit(k).select("x").collect()
    return _numbers([r.x for r in rows])


def _numbers(rows: list) -> np.ndarray:
    """Rows as 64-bit integers, or as whole numbers of any size where a distance might not fit."""
    x = np.array(rows, dtype=np.int64) if len(rows) else np.zeros((0, 0), dtype=np.int64)
    return x if not x.size or max(int(x.max()), -int(x.min())) <= _PLAIN else x.astype(object)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to centres."""
    out = np.empty((len(x), len(centres)), dtype=object if object in (x.dtype, centres.dtype) else np.int64)
    for j, c in enumerate(centres):
        d = x - c
        out[:, j] = (d * d).sum(axis=1)
    return out


def _displaced(history: list[np.ndarray], now: int) -> np.ndarray:
    """Norm of the way of each centroid from each earlier round until ``now``: one row per round."""
    return np.array([[float(sum(int(v) ** 2 for v in a - b)) ** 0.5 for a, b in zip(history[now], old, strict=True)] for old in history[: now + 1]])


def measure(x: np.ndarray, history: list[np.ndarray], now: int, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, round of measuring, bounds, rows measured) of rows in round ``now``.

    ``state`` holds the first three of an earlier round. Rows whose loosened bounds do not decide are measured to every
    centroid; ties go to the smaller number.
    """
    if state is None:
        again = np.ones(len(x), dtype=bool)
        cluster, seen, bounds = np.zeros(len(x), dtype=np.int32), np.zeros(len(x), dtype=np.int32), np.zeros((len(x), len(history[0])), dtype=np.float32)
    else:
        cluster, seen, bounds = (a.copy() for a in state)
        moved = _displaced(history, now)[seen]
        at = np.arange(len(x))
        reach = (bounds[at, cluster].astype(float) + moved[at, cluster]) * (1 + _SLACK)
        other = (bounds.astype(float) - moved) * (1 - _SLACK) - _SLACK * moved
        other[at, cluster] = np.inf
        again = ~(other.min(axis=1) > reach)
    if again.any():
        d = distances(x[again], history[now])
        cluster[again] = np.argmin(d, axis=1)
        seen[again] = now
        bounds[again] = np.sqrt(d.astype(float))
    return cluster, seen, bounds, int(again.sum())


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return _numbers(batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros((0, 1), dtype=np.int64)


def _state(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    if "cluster" not in batch.schema.names:
        return None
    bounds = batch.column("bounds").flatten().to_numpy().reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1))
    return batch.column("cluster").to_numpy(), batch.column("seen").to_numpy(), bounds


def _measured(rows: DataFrame, history: list[np.ndarray], now: int) -> DataFrame:
    """The rows with their state in round ``now``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, seen, bounds, _ = measure(_vectors(batch), history, now, _state(batch))
            spelt = pa.ListArray.from_arrays(np.arange(len(bounds) + 1, dtype=np.int32) * bounds.shape[1], pa.array(bounds.ravel(), pa.float32()))
            yield pa.record_batch([batch.column("vec_id"), batch.column("x"), pa.array(cluster, pa.int32()), pa.array(seen, pa.int32()), spelt], names=["vec_id", "x", "cluster", "seen", "bounds"])

    kind = rows.schema["vec_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id {kind}, x array<bigint>, cluster int, seen int, bounds array<float>")


def _sums(rows: DataFrame, history: list[np.ndarray], now: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(members, sums of components) of the centroids in round ``now``, and the number of rows that were measured.

    Each batch gives one small row per centroid; Spark adds them up, so the driver sees one row per centroid.
    """
    width = history[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch)
            cluster, _, _, count = measure(x, history, now, _state(batch))
            held = np.unique(cluster)
            total = [[str(v) for v in x[cluster == j].sum(axis=0)] for j in held]
            yield pa.record_batch(
                [pa.array(held, pa.int32()), pa.array([int((cluster == j).sum()) for j in held], pa.int64()), pa.array([count if i == 0 else 0 for i in range(len(held))], pa.int64()), pa.array(total, pa.list_(pa.string()))],
                names=["cluster", "members", "again", "total"],
            )

    parts = rows.mapInArrow(run, "cluster int, members long, again long, total array<string>")
    whole = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    members, sums, again = np.zeros(len(history[0]), dtype=object), np.zeros(history[0].shape, dtype=object), 0
    for r in parts.groupBy("cluster").agg(F.sum("members").alias("members"), F.sum("again").alias("again"), *whole).collect():
        members[r.cluster], again = r.members, again + r.again
        sums[r.cluster] = [int(r[f"s{i}"]) for i in range(width)]
    return members, sums, again


def moved_centroids(old: np.ndarray, members: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Componentwise exact floor of the mean; a centroid without members stays."""
    return _numbers([[int(s) // int(n) for s in row] if n else [int(v) for v in was] for was, n, row in zip(old, members, sums, strict=True)])


def fit(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """(rows with their last stored state, centroids of all rounds, rows that bounds left open in each round) over ``whole_vectors``.

    Rows are written to the shared folder as Parquet, so a lost executor costs its tasks of one round. The history goes to
    every task: (rounds + 1) x k x width numbers, whatever the rows are.
    """
    spark = vectors.sparkSession
    history, measured, rows = [first_centroids(vectors, k)], [], vectors
    for now in range(rounds if len(history[0]) else 0):
        if (now + 1) & now == 0:
            folder = scratch_folder(spark, "centroids")
            _measured(rows, history, now).write.parquet(folder)
            rows = spark.read.parquet(folder)
        members, sums, again = _sums(rows, history, now)
        measured.append(again)
        history.append(moved_centroids(history[-1], members, sums))
    return rows, history, measured


def clusters(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each usable row, after ``rounds`` rounds.

    Rows of another width, null, or with null or non-finite components are left out; repeated rows count each. With fewer
    than ``k`` usable rows each starts a centroid; with none the result is empty. Distances and sums beyond 64 bits
    are given as the largest 64-bit number. Columns of other names are not read.
    """
    state, history, _ = fit(whole_vectors(rows, width, scale), k, rounds)
    last, centres = len(history) - 1, history[-1]
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch)
            cluster, _, _, _ = measure(x, history, last, _state(batch))
            far = np.zeros(len(x), dtype=np.int64)
            for j in np.unique(cluster):
                far[cluster == j] = [min(int(v), _MOST) for v in distances(x[cluster == j], centres[j : j + 1])[:, 0]]
            yield pa.record_batch([batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(far)], names=["vec_id", "cluster", "distance"])

    found = state.mapInArrow(run, f"vec_id {kind}, cluster int, distance long")
    spelt = [hashlib.sha256(",".join(str(int(v)) for v in c).encode()).hexdigest() for c in centres]
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("_sum"))
    # at most k rows
    held = {r["cluster"]: int(r["_sum"]) for r in sums.collect()}
    capped = lambda v: min(v, _MOST)
    facts = [(j, capped(held[j]), capped(sum(held.values())), spelt[j]) for j in sorted(held)]
    schema = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    named = rows.sparkSession.createDataFrame(facts, schema)
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
