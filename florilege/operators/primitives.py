"""Building blocks that stay balanced when one key holds a large share of the rows.

``running`` computes running sums, counts and maxima per key without sending a large key to one task: its rows are cut
into ordered buckets, each bucket is scanned on its own, and the totals of the earlier buckets (one small row
per key and bucket) are added.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from florilege.session import cut_lineage

_AGGREGATE = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def _combine(kind: str, before: Column, here: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
    return F.greatest(before, here) if kind == "max" else F.least(before, here)


#: Rows of a key from which it is cut into buckets; keys below are scanned whole.
BUSY = 1000


def _same_keys(a: DataFrame, keys: Sequence[str], prefix: str) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(F.col(f"{prefix}{k}")) for k in keys], F.lit(True))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    bucket: Column,
    values: Mapping[str, tuple[str, Column]],
    inclusive: bool = True,
) -> DataFrame:
    """Add running aggregates per key in ``order``; ``bucket`` must grow with the order.

    ``values`` maps a new column to ``(sum|count|max|min, expression)``. With ``inclusive=False`` the row itself
    is left out. Keys of few rows, which most tables have, are one scan after one shuffle; only busy keys are cut up.
    """
    if not keys:
        return _running_cut(df, keys, order, bucket, values, inclusive)
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > BUSY)
    busy = cut_lineage(counts.select(*[F.col(k).alias(f"_busy_{k}") for k in keys]))
    cut = _running_cut(df, keys, order, bucket, values, inclusive)
    types = {name: cut.schema[name].dataType for name in values}
    if busy.isEmpty():
        return _running_whole(df, keys, order, values, inclusive).withColumns({name: F.col(name).cast(kind) for name, kind in types.items()})
    on = _same_keys(df, keys, "_busy_")
    few = _running_whole(df.join(busy, on, "left_anti"), keys, order, values, inclusive)
    return few.unionByName(_running_cut(df.join(busy, on, "left_semi"), keys, order, bucket, values, inclusive))


def _running_whole(df: DataFrame, keys: Sequence[str], order: Sequence[Column], values: Mapping[str, tuple[str, Column]], inclusive: bool) -> DataFrame:
    """Running aggregates of keys that one task can hold."""
    rows = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)

    def value(kind: str, expr: Column) -> Column:
        here = _AGGREGATE[kind](expr).over(rows)
        return F.coalesce(here, F.lit(0)) if kind in ("sum", "count") else here

    return df.select("*", *[value(kind, expr).alias(name) for name, (kind, expr) in values.items()])


def _running_cut(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, values: Mapping[str, tuple[str, Column]], inclusive: bool) -> DataFrame:
    """Running aggregates by ordered buckets: each is scanned on its own and takes the totals of the earlier ones."""
    cut = df.withColumn("_bucket", bucket)
    totals = cut.groupBy(*keys, "_bucket").agg(
        *[_AGGREGATE[kind](expr).alias(f"_part_{name}") for name, (kind, expr) in values.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_b"),
        *[
            _AGGREGATE["sum" if kind == "count" else kind](f"_part_{name}").over(earlier).alias(f"_off_{name}")
            for name, (kind, _) in values.items()
        ],
    )
    last = 0 if inclusive else -1
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    scanned = cut.select(
        "*", *[_AGGREGATE[kind](expr).over(inside).alias(f"_in_{name}") for name, (kind, expr) in values.items()]
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys],
        F.col("_bucket").eqNullSafe(F.col("_b")),
    )
    return scanned.join(offsets, same).select(
        *df.columns,
        *[
            _combine(kind, F.col(f"_off_{name}"), F.col(f"_in_{name}")).alias(name)
            for name, (kind, _) in values.items()
        ],
    )


def quantile_bucket(df: DataFrame, order: Sequence[str], parts: int = 64, sample: int = 4096) -> Column:
    """A bucket that grows with the columns ``order`` and splits the rows of ``df`` about evenly, whatever their values.

    The bounds come from at most ``sample`` rows by the hash of ``order``; a few numbers go to the driver. Rows that tie in
    all of ``order`` share a bucket, so a unique column belongs at its end.
    """
    key = F.struct(*order)
    seen = [r[0] for r in df.select(key.alias("_o")).orderBy(F.xxhash64("_o")).limit(sample).orderBy("_o").collect()]
    bounds = [seen[i * len(seen) // parts] for i in range(1, parts) if seen]
    schema = df.select(key.alias("_o")).schema["_o"].dataType
    cuts = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(b, schema.fields, strict=True)]) for b in dict.fromkeys(map(tuple, bounds))]
    return F.size(F.filter(F.array(*cuts), lambda b: b <= key)) if cuts else F.lit(0)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column, name: str) -> DataFrame:
    """Number the rows of each key from 1 in ``order``."""
    return running(df, keys, order, bucket, {name: ("count", F.lit(1))})


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each key. Spark limits the groups before the shuffle, so hot keys stay small."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key with the greatest ``order`` columns, pre-aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def few(df: DataFrame, most: int = 500_000) -> DataFrame:
    """The rows written once, and marked for broadcast if they are no more than ``most``."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() <= most else df


def fixed_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A rule table of fixed size, marked for broadcast."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def count_where(condition: Column) -> Column:
    """Number of rows for which the condition holds, as a long that is never NULL."""
    return F.count(F.when(condition, 1))


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / F.nullif(whole, F.lit(0)))
