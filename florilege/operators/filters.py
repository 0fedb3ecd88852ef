"""Filters and bulk updates over items, sources, tasks and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from florilege.functions.text import filled, norm_text


def item_filter(
    items: DataFrame,
    kinds: Sequence[str] | None = None,
    status: str | None = None,
    source: str | None = None,
    q: str | None = None,
    duplicates: bool = False,
    columns: Sequence[str] = ("kind", "status", "source", "duplicate_of", "title", "url"),
) -> DataFrame:
    """Items by any mix of kind, status, source and a substring; duplicates hidden unless asked for."""
    kind, state, src, dup, title, url = columns
    rows = items if duplicates else items.filter(F.col(dup).isNull())
    if kinds:
        rows = rows.filter(F.col(kind).isin(*kinds))
    if status:
        rows = rows.filter(F.col(state) == status)
    if source:
        rows = rows.filter(F.col(src) == source)
    if q:
        rows = rows.filter(F.contains(F.col(title), F.lit(q)) | F.contains(F.col(url), F.lit(q)))
    return rows


def site_filter(sites: DataFrame, country: str | None, status: str | None, q: str | None, limit: int = 200) -> DataFrame:
    """Found sites by country, status and substring, best first."""
    rows = sites
    for name, value in (("country", country), ("status", status)):
        if value:
            rows = rows.filter(F.col(name) == value)
    if q:
        rows = rows.filter(F.contains(F.lower("domain"), F.lit(q.lower())))
    return rows.orderBy(F.desc("score"), "site").limit(limit)


def entity_browse(entities: DataFrame, origin: str | None, q: str | None, missing: str | None, by_coverage: bool) -> DataFrame:
    """Entities by origin, name and missing slot, in order of coverage or name."""
    rows = entities
    if origin:
        rows = rows.filter(F.col("origin") == origin)
    if q:
        rows = rows.filter(F.col("name").ilike(f"%{q}%"))
    if missing:
        rows = rows.filter(F.array_contains("missing", missing))
    return rows.orderBy(*(["coverage", "name"] if by_coverage else ["name"]), "entity")


def unenriched(items: DataFrame, raw: str, path: str, marker: str) -> DataFrame:
    """Records whose JSON names no method, or one other than the rules."""
    how = F.get_json_object(raw, path)
    return items.filter(how.isNull() | ~how.startswith(marker))


def still_pending(items: DataFrame, item: str, chosen: DataFrame, status: str, work: str) -> DataFrame:
    """Of a chosen list, the items still in the work status."""
    return items.filter(F.col(status) == work).join(chosen.select(item).distinct(), item, "left_semi")


def unscanned(items: DataFrame, text: str, scanned: str, item: str, limit: int) -> DataFrame:
    """Items with text and without a scan date, newest first."""
    return items.filter(F.col(text).isNotNull() & F.col(scanned).isNull()).orderBy(F.desc(item)).limit(limit)


def recheck_due(items: DataFrame, status: str, method: str, prefix: str, deferred: str) -> DataFrame:
    """Rejected rows that a model decided or that were put off."""
    return items.filter((F.col(status) == "skipped") & (F.col(method).startswith(prefix) | (F.col(method) == deferred)))


def prediction_review(log: DataFrame, task: str | None, decision: str | None, uncertain_first: bool, item: str) -> DataFrame:
    """Decision log by task and decision; ``disagreement`` and ``uncertain`` are views of it."""
    rows = log if task is None else log.filter(F.col("task") == task)
    if decision == "disagreement":
        rows = rows.filter(F.col("agree") == F.lit(False))
    elif decision == "uncertain":
        rows = rows.filter(F.col("human_label").isNull())
    elif decision:
        rows = rows.filter(F.col("decision") == decision)
    return rows.orderBy(*([F.asc("confidence")] if uncertain_first else []), F.desc(item))


def topic_filter(text: Column, names: Sequence[str], topic_stems: Sequence[str], least: int) -> Column:
    """Reason why a text is on topic, or why it is not."""
    low = F.lower(text)
    named = F.exists(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(low, n))
    score = F.size(F.filter(F.array(*[F.lit(s) for s in topic_stems]), lambda s: F.contains(low, s)))
    return (
        F.when(~named, "no_name")
        .when(score < least, F.concat(F.lit("too_little:"), score.cast("string")))
        .otherwise(F.concat(F.lit("topic:"), score.cast("string")))
    )


def media_filter(rows: DataFrame, hosts: Sequence[str], excluded: Sequence[str], min_width: int) -> DataFrame:
    """Raster images of enough width under a free licence on an allowed host, without excluded words."""
    words_out = "(?i)" + "|".join(excluded)
    return rows.filter(
        F.col("mime").isin("image/jpeg", "image/png", "image/webp", "image/tiff")
        & (F.col("width") >= min_width)
        & F.col("licence").rlike("(?i)^(cc0|cc[ -]by|public domain|pd)")
        & ~F.col("licence").rlike("(?i)nc|nd")
        & F.col("host").isin(*hosts)
        & ~F.col("title").rlike(words_out)
    )


def palette_fits(text: Column, status: Column, url: Column, topic: str, off_topic: str, low: int, high: int) -> Column:
    """A checked statement on the topic, of fitting length, with an address, and not only about the other topic."""
    n = norm_text(text)
    return status.isin("verified", "applied") & F.length(text).between(low, high) & url.startswith("http") & n.rlike(topic) & ~(n.rlike(off_topic) & ~n.rlike(topic))


def profile_recheck(items: DataFrame, status: str, reason: str, fails: Column, why: Column, live: Sequence[str]) -> DataFrame:
    """Rows that no longer pass the filter become skipped with a reason."""
    hit = F.col(status).isin(*live) & fails
    return items.withColumn(reason, F.when(hit, why).otherwise(F.col(reason))).withColumn(status, F.when(hit, "skipped").otherwise(F.col(status)))


def paused(rows: DataFrame, until: str, now: Column) -> DataFrame:
    return rows.filter(F.col(until) > now)


def stale_reviews(texts: DataFrame, key: str, text_hash: Column, reviews: DataFrame) -> DataFrame:
    """Texts without review, or reviewed in another wording. ``reviews`` holds the latest ``(key, reviewed_hash)``."""
    j = texts.withColumn("_h", text_hash).join(reviews, key, "left")
    return j.filter(F.col("reviewed_hash").isNull() | (F.col("reviewed_hash") != F.col("_h"))).drop("_h")


def odd_layout(docs: DataFrame, doc: str) -> DataFrame:
    """Documents that lack ``id`` but hold ``gatunek``."""
    has = lambda k: F.try_variant_get(doc, f"$.{k}", "string").isNotNull()
    return docs.filter(~has("id") & has("gatunek"))


def names_due(entities: DataFrame, latin: str, checked: str, names: str, before: Column, preferred: Column, entity: str, limit: int) -> DataFrame:
    """Entities whose names are missing or were not checked lately, preferred origin first."""
    due = F.col(names).isNull() | F.col(checked).isNull() | (F.col(checked) < before)
    return entities.filter(filled(F.col(latin)) & due).orderBy(~preferred, entity).limit(limit)


def document_states(docs: DataFrame, entity: str, doc: str) -> DataFrame:
    """State of each JSON document: gallery, facts, sections and merged text, with the waiting counts."""
    size = lambda path: F.coalesce(F.size(F.try_variant_get(doc, path, "array<variant>")), F.lit(0))
    gallery, facts, sections = size("$.zdjecia"), size("$.wiedza.fakty"), size("$.wiedza.sekcje")
    merged = F.try_variant_get(doc, "$.scalone", "string").isNotNull()
    return docs.select(
        entity,
        (gallery == 0).alias("no_gallery"),
        ((facts > 0) & (sections == 0)).alias("unorganized"),
        ((sections > 0) & ~merged).alias("unmerged"),
        facts.alias("facts"),
    )


def blocked_runs(runs: DataFrame, stats: str, refusals: str, writes: Sequence[str]) -> DataFrame:
    """Runs that were refused and wrote nothing."""
    m = F.from_json(stats, "map<string,int>")
    wrote = F.exists(F.map_entries(F.map_filter(m, lambda k, v: k.isin(*writes))), lambda e: e["value"] > 0)
    return runs.filter((F.coalesce(F.try_element_at(m, F.lit(refusals)), F.lit(0)) > 0) & ~F.coalesce(wrote, F.lit(False)))


def open_conflicts(log: DataFrame, item: str, limit: int) -> DataFrame:
    """Unresolved conflicts, newest first, with their total."""
    rows = log.filter((F.col("decision") == "conflict") & F.col("human_label").isNull())
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc(item)).limit(limit).crossJoin(total)  # total is one row


def bulk_status(items: DataFrame, match: Column, status: str, new: str, allowed: Column) -> DataFrame:
    """Set a status on all matching rows where it is allowed."""
    return items.withColumn(status, F.when(match & allowed, new).otherwise(F.col(status)))


def task_list(tasks: DataFrame, filters: dict[str, str | None], item: str, page: int, size: int) -> DataFrame:
    """One page of tasks by any of status, kind and agent, with the total."""
    rows = tasks
    for name, value in filters.items():
        if value:
            rows = rows.filter(F.col(name) == value)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(F.desc(item)).offset((page - 1) * size).limit(size).crossJoin(total)  # total is one row


def idea_view(ideas: DataFrame, view: str) -> DataFrame:
    """Ideas of one view: pool, rejected, used, risky or all."""
    views = {
        "pool": F.col("status").isin("new", "rated") & ~F.col("risky") & ~F.col("used"),
        "rejected": F.col("status") == "rejected",
        "used": F.col("used"),
        "risky": F.col("risky"),
        "all": F.lit(True),
    }
    return ideas.filter(views[view])


def blocked_domains(rows: DataFrame, domain: str, blocked: DataFrame) -> DataFrame:
    """Rows whose domain and parent domains are all off the list; a list of any size joins on equality."""
    labels = F.split(F.col(domain), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hit = rows.select(domain).distinct().select(domain, F.explode(suffixes).alias("_s")).join(blocked.select(F.col(domain).alias("_s")), "_s").select(domain).distinct()
    return rows.filter(F.col(domain).isNotNull()).join(hit, domain, "left_anti")


def missing_slots(entities: DataFrame, slots: dict[str, Column]) -> DataFrame:
    """The list of slots without content."""
    return entities.withColumn("missing", F.array_compact(F.array(*[F.when(~c, F.lit(s)) for s, c in slots.items()])))

