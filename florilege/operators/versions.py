"""Comparing versions: line changes, new paragraphs, upserts and merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions.arrow import common_lines


def line_changes(rows: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """Added and removed lines around the longest common subsequence; a moved line counts on both sides."""
    lines = lambda c: F.size(F.split(F.coalesce(c, F.lit("")), "\n"))
    same = rows.select(*keys, lines(before).alias("_a"), lines(after).alias("_b"), common_lines(F.col(before), F.col(after)).alias("_same"))
    return same.select(*keys, (F.col("_b") - F.col("_same")).cast("long").alias("added"), (F.col("_a") - F.col("_same")).cast("long").alias("removed"))


def line_surplus(rows: DataFrame, keys: Sequence[str], before: str, after: str) -> DataFrame:
    """Added and removed lines as a difference of multisets; moved lines do not count."""
    sides = F.array(
        F.struct(F.lit(1).alias("a"), F.lit(0).alias("b"), F.split(F.coalesce(before, F.lit("")), "\n").alias("lines")),
        F.struct(F.lit(0).alias("a"), F.lit(1).alias("b"), F.split(F.coalesce(after, F.lit("")), "\n").alias("lines")),
    )
    each = rows.select(*keys, F.inline(sides)).select(*keys, "a", "b", F.explode("lines").alias("line"))
    n = each.groupBy(*keys, "line").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    zero = F.lit(0)
    return n.groupBy(*keys).agg(
        F.sum(F.greatest(F.col("b") - F.col("a"), zero)).alias("added"), F.sum(F.greatest(F.col("a") - F.col("b"), zero)).alias("removed")
    )


def backlog_merge(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Tasks by key: confirmed ones take the new values, open ones missing from the new list expire, new ones join."""
    o = old.select(key, F.col("status").alias("_s"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    n = new.select(key, F.lit(True).alias("_new"), *columns)
    j = o.join(n, key, "full")
    state = (
        F.when(F.col("_s").isNull(), "inserted")
        .when(F.col("_new").isNull() & (F.col("_s") == "open"), "expired")
        .when(F.col("_new").isNull(), F.col("_s"))
        .otherwise("confirmed")
    )
    return j.select(key, state.alias("state"), *[F.coalesce(c, f"_o_{c}").alias(c) for c in columns])


def new_records(working: DataFrame, published: DataFrame, key: str) -> DataFrame:
    """Keys of the working set that the published set lacks."""
    return working.select(key).distinct().join(published.select(key), key, "left_anti")


def leftover_points(points: DataFrame, point: str, used: DataFrame, fact: str, current: Column) -> DataFrame:
    """Points with a fact that no current merged text uses; ``points`` holds one row per point and fact."""
    live = used.filter(current).select(fact).distinct()
    return points.join(live, fact, "left_anti").select(point).distinct()


def fact_union_latest(old: DataFrame, new: DataFrame, entity: str, fact: str, order: str, most: int) -> DataFrame:
    """Old facts with replaced texts plus new ones, the newest ``most`` per entity."""
    from florilege.operators.primitives import newest_per_key, top_per_key

    both = old.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)))
    last = newest_per_key(both, [entity, fact], ["_v"]).drop("_v")
    return top_per_key(last, [entity], [F.desc(order), F.desc(fact)], most)


def save_leads(leads: DataFrame, known: DataFrame, fingerprint: str, depth: str, most: int, order: str) -> DataFrame:
    """New leads by fingerprint up to a depth; of equal ones the first."""
    rows = leads.filter(F.col(depth) <= most)
    rest = [c for c in rows.columns if c != fingerprint]
    firsts = rows.groupBy(fingerprint).agg(F.min_by(F.struct(*rest), order).alias("_f")).select(fingerprint, "_f.*").select(*leads.columns)
    return firsts.join(known.select(fingerprint), fingerprint, "left_anti")


def distinct_ordered(rows: DataFrame, value: str, pos: str) -> DataFrame:
    """Distinct values with the place of their first occurrence."""
    return rows.groupBy(value).agg(F.min(pos).alias("first_at"))


def asked_and_used(log: DataFrame, entity: str, at: str, since: Column, query: str, urls: Sequence[str]) -> DataFrame:
    """Queries asked in the window and all addresses and domains used, per entity as rows."""
    asked = log.filter(F.col(at) >= since).select(entity, F.lit("asked").alias("what"), F.col(query).alias("value"))
    each = F.array(*[F.col(u) for u in urls])
    used = log.select(entity, F.explode(each).alias("value")).filter("value <> ''")
    domain = F.regexp_extract("value", r"^[a-z]+://([^/?#]*)", 1)
    rows = asked.unionByName(used.select(entity, F.lit("used_url").alias("what"), "value"))
    rows = rows.unionByName(used.select(entity, F.lit("used_domain").alias("what"), domain.alias("value")))
    return rows.filter("value IS NOT NULL").distinct()


def known_texts(facts: DataFrame, entity: str, text: str, live: Column, documents: DataFrame, fields: Column) -> DataFrame:
    """Texts of live statements and the hand-written fields of the entity documents."""
    own = documents.select(entity, F.explode(F.filter(fields, lambda x: F.coalesce(x, F.lit("")) != "")).alias("text"))
    return facts.filter(live).select(entity, F.col(text).alias("text")).unionByName(own)
