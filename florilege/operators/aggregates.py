"""Counts, coverage, scorecards and other grouped reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.operators.primitives import count_where, few, share, top_per_key

ARCHIVE_DAY = "archiwum"  # fixed value: day under which old counters are summed


def status_pivot(items: DataFrame, kind: str, status: str, kinds: Sequence[str], statuses: Sequence[str]) -> DataFrame:
    """One row per kind with a count column per status; kinds and statuses without rows show zero."""
    spark = items.sparkSession
    every = spark.createDataFrame([(k,) for k in kinds], f"{kind} string")
    counts = items.groupBy(kind).agg(*[count_where(F.col(status) == s).alias(f"n_{s}") for s in statuses])
    return every.join(counts, kind, "left").na.fill(0)


def source_kind_counts(items: DataFrame, source: str, kind: Column, kinds: Sequence[str], filled: Column, at: Column) -> DataFrame:
    """Per source: rows per kind, share of rows with content, and the last harvest."""
    return items.groupBy(source).agg(
        *[count_where(kind == k).alias(f"n_{k}") for k in kinds],
        F.count("*").alias("n_all"),
        F.round(share(count_where(filled), F.count("*")), 6).alias("coverage"),
        F.max(at).alias("last_harvest"),
    )


def fact_funnel(facts: DataFrame, status: Column, at: Column, now: Column, days: int = 7) -> DataFrame:
    """Stage counts over all rows and the intake of the last days, in one row."""
    return facts.agg(
        count_where(status == "new").alias("collected"),
        count_where(status == "verified").alias("verified"),
        count_where(status == "applied").alias("in_files"),
        count_where(status == "rejected").alias("rejected"),
        count_where(at >= now - F.expr(f"INTERVAL {days} DAYS")).alias("collected_recent"),
    )


def intake_totals(facts: DataFrame, queries: DataFrame, since: Column, good: Sequence[str]) -> DataFrame:
    """New and verified facts since a time, queries asked and how many hit or gave facts, in one row."""
    a = facts.filter(F.col("created_at") >= since).agg(
        F.count("*").alias("new_facts"), count_where(F.col("status").isin(*good)).alias("new_verified")
    )
    b = queries.filter(F.col("created_at") >= since).agg(
        F.count("*").alias("queries"),
        count_where(F.coalesce(F.col("used_url"), F.lit("")) != "").alias("queries_hit"),
        count_where(F.coalesce(F.col("facts"), F.lit(0)) > 0).alias("queries_with_facts"),
    )
    return a.crossJoin(b)  # one row each


def intake_by_language(facts: DataFrame, since: Column, good: Sequence[str], lang: Column, k: int = 12) -> DataFrame:
    """Languages with the most verified facts since a time."""
    rows = facts.filter((F.col("created_at") >= since) & F.col("status").isin(*good))
    return rows.groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(k)


def section_counts(facts: DataFrame, entity: str, section: str, keep: Column) -> DataFrame:
    """Verified facts per entity and section."""
    return facts.filter(keep).groupBy(entity, section).agg(F.count("*").alias("n"))


def as_count_map(counts: DataFrame, entity: str, section: str) -> DataFrame:
    """Section counts folded to one map per entity; the vocabulary of sections bounds the map."""
    pairs = F.array_sort(F.collect_list(F.struct(section, "n")))
    return counts.groupBy(entity).agg(F.map_from_entries(pairs).alias("sections"))


def slot_coverage(entities: DataFrame, slots: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """State of each slot of each entity as rows ``(…, slot, state)``.

    A slot names three conditions: merged text exists, own text exists, statements from the web wait.
    """
    states = []
    for name, (merged, own, waiting) in slots.items():
        state = (
            F.when(merged, "merged")
            .when(own & waiting, "own+web")
            .when(own, "own")
            .when(waiting, "waiting")
            .otherwise("missing")
        )
        states.append(F.struct(F.lit(name).alias("slot"), state.alias("state")))
    return entities.select("*", F.inline(F.array(*states)))


def coverage_summary(cover: DataFrame, entity: str) -> DataFrame:
    """Percent of filled slots and the list of missing ones; the slot list bounds each group."""
    filled = F.col("state").isin("merged", "own+web", "own")
    missing = F.array_sort(F.collect_list(F.when(F.col("state") == "missing", F.col("slot"))))
    return cover.groupBy(entity).agg(
        F.bround(100.0 * count_where(filled) / F.count("*")).cast("long").alias("percent"),
        F.array_join(missing, ",").alias("missing"),
    )


def slot_summary(cover: DataFrame) -> DataFrame:
    """How many entities lack or wait for each slot."""
    missing = count_where(F.col("state") == "missing")
    return cover.groupBy("slot").agg(
        missing.alias("n_missing"),
        count_where(F.col("state") == "waiting").alias("n_waiting"),
        F.bround(100.0 * missing / F.count("*")).cast("long").alias("percent_missing"),
    )


def duplicate_keys(rows: DataFrame, key: str, entity: str) -> DataFrame:
    """Keys that more than one entity carries, as one row per entity with the number of holders."""
    many = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(entity).alias("holders"))
    return rows.join(many.filter(F.col("holders") > 1), key).select(key, entity, "holders").distinct()


def identity_problems(rows: DataFrame, key: str, entity: str, stored: str) -> DataFrame:
    """Rows whose stored id differs from the file id, and natural keys that several files share."""
    wrong = rows.filter(F.col(stored) != F.col(entity)).select(
        F.lit("id_mismatch").alias("problem"), F.col(entity).cast("string").alias("entity"), F.col(stored).cast("string").alias("detail")
    )
    shared = duplicate_keys(rows, key, entity).select(
        F.lit("shared_key").alias("problem"), F.col(entity).cast("string").alias("entity"), F.col(key).cast("string").alias("detail")
    )
    return wrong.unionByName(shared)


def category_counts(rows: DataFrame, category: Column, foreign: Column, plain: str) -> DataFrame:
    """Rows per category, and how many foreign ones outside the plain category."""
    return rows.groupBy(category.alias("category")).agg(
        F.count("*").alias("n"), count_where(foreign & (category != plain)).alias("n_foreign_special")
    )


def counter_tiles(counters: DataFrame, today: str, week: str, since: str) -> DataFrame:
    """Per kind: today, the week, the period, and all time. Day strings compare in date order."""
    live = F.col("day") != ARCHIVE_DAY

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("long")

    return counters.groupBy("kind").agg(
        total(live & (F.col("day") == today)).alias("today"),
        total(live & (F.col("day") >= week)).alias("week"),
        total(live & (F.col("day") >= since)).alias("period"),
        F.sum("n").cast("long").alias("all_time"),
    )


def counter_top(counters: DataFrame, since: str, k: int) -> DataFrame:
    """Most counted keys of each kind in the period; the part after the first colon names a section."""
    live = counters.filter((F.col("day") >= since) & (F.col("day") != ARCHIVE_DAY) & (F.col("key") != ""))
    named = live.withColumn("label", F.regexp_replace("key", "^[^:]*:", ""))
    sums = named.groupBy("kind", "label").agg(F.sum("n").cast("long").alias("n"))
    return top_per_key(sums, ["kind"], [F.desc("n"), F.asc("label")], k)


def counter_series(counters: DataFrame, first: str, last: str, kinds: Sequence[str]) -> DataFrame:
    """Daily totals with zero days, and the peak of the first kind."""
    spark = counters.sparkSession
    days = spark.range(1).select(
        F.explode(F.transform(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date")), lambda d: d.cast("string"))).alias("day")
    )
    sums = counters.filter(F.col("day").between(first, last)).groupBy("day").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).cast("long").alias(f"n_{k}") for k in kinds]
    )
    filled = days.join(sums, "day", "left").na.fill(0)
    peak = filled.agg(F.greatest(F.lit(1), F.max(f"n_{kinds[0]}")).cast("long").alias("peak"))
    return filled.crossJoin(peak)  # peak is one row


def archive_rollup(counters: DataFrame, cut: str) -> DataFrame:
    """Recent days row by row; older ones summed to one archive row per kind and key, zero sums dropped."""
    recent = counters.filter((F.col("day") >= cut) & (F.col("day") != ARCHIVE_DAY)).select("day", "kind", "key", "n")
    old = (
        counters.filter((F.col("day") < cut) | (F.col("day") == ARCHIVE_DAY))
        .groupBy("kind", "key")
        .agg(F.sum("n").cast("long").alias("n"))
        .filter(F.col("n") != 0)
        .select(F.lit(ARCHIVE_DAY).alias("day"), "kind", "key", "n")
    )
    return recent.unionByName(old)


def counter_digest(counters: DataFrame, names: DataFrame, cut: str, kind: str, k: int = 4) -> DataFrame:
    """Top keys of one kind since a day, with names where known."""
    rows = counters.filter((F.col("kind") == kind) & (F.col("day") >= cut) & (F.col("day") != ARCHIVE_DAY) & (F.col("key") != ""))
    top = rows.groupBy("key").agg(F.sum("n").cast("long").alias("n")).orderBy(F.desc("n"), "key").limit(k)
    return top.join(names, "key", "left").select("key", F.coalesce("name", "key").alias("name"), "n")


def entity_value(counters: DataFrame, references: DataFrame, since: str, weights: dict[str, float], per_reference: float = 2.0) -> DataFrame:
    """Reader value per entity: weighted views since a day plus a bonus per referencing record."""
    weight = F.coalesce(*[F.when(F.col("kind") == k, F.lit(w)) for k, w in weights.items()])
    views = counters.filter(F.col("kind").isin(*weights) & (F.col("day") >= since)).select(
        F.substring_index("key", ":", 1).alias("entity"), (F.col("n") * weight).alias("value")
    )
    refs = references.select(F.col("entity").cast("string").alias("entity"), F.lit(per_reference).alias("value"))
    both = views.unionByName(refs).filter(F.coalesce(F.col("entity"), F.lit("")) != "")
    return both.groupBy("entity").agg(F.round(F.sum("value"), 6).alias("value"))


def source_yield(items: DataFrame, source: str, recipe: Column, fact: Column, min_pages: int = 200, min_share: float = 0.05) -> DataFrame:
    """Useful rows per source and the verdict that switches poor sources off."""
    n = items.groupBy(source).agg(
        F.count("*").alias("pages"), count_where(recipe).alias("recipes"), count_where(fact).alias("facts")
    )
    poor = (F.col("pages") >= min_pages) & (F.col("recipes") == 0) & (F.col("facts") / F.greatest(F.col("pages"), F.lit(1)) < min_share)
    return n.withColumn("auto_off", poor)


def misfit_sources(items: DataFrame, source: str, off_topic: Column, good: Column, least: int = 5, times: int = 3, empty_pages: int = 40) -> DataFrame:
    """Sources with mostly off-topic rows, or with many pages and no good row."""
    n = items.groupBy(source).agg(
        F.count("*").alias("pages"), count_where(off_topic).alias("n_off"), count_where(good).alias("n_good")
    )
    mostly_off = (F.col("n_off") >= least) & (F.col("n_off") > times * F.col("n_good"))
    return n.filter(mostly_off | ((F.col("pages") >= empty_pages) & (F.col("n_good") == 0)))


def provider_yield(log: DataFrame, provider: str, min_asked: int) -> DataFrame:
    """Per provider: asked, found, facts, last use, and whether it never gave anything."""
    facts = F.coalesce(F.sum("facts"), F.lit(0)).cast("long")
    return log.groupBy(provider).agg(
        F.count("*").alias("asked"),
        count_where(F.coalesce(F.col("used_url"), F.lit("")) != "").alias("found"),
        facts.alias("facts"),
        F.max("created_at").alias("last_asked"),
        ((F.count("*") >= min_asked) & (facts == 0)).alias("useless"),
    )


def closed_gaps(log: DataFrame, entity: str, slot: str, since: Column, asked: int) -> DataFrame:
    """Gaps asked often enough in the window without a useful answer."""
    n = log.filter(F.col("created_at") >= since).groupBy(entity, slot).agg(
        F.count("*").alias("asked"), F.max(F.coalesce(F.col("facts"), F.lit(0))).alias("best")
    )
    return n.filter((F.col("asked") >= asked) & (F.col("best") <= 0)).drop("best")


def wilson_bounds(ok: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a share, clipped to 0..1 and 0 for no rows."""
    trials = F.nullif(n, F.lit(0)).cast("double")
    p = ok / trials
    centre = p + z * z / (2 * trials)
    spread = z * F.sqrt(p * (1 - p) / trials + z * z / (4 * trials * trials))
    width = 1 + z * z / trials
    low = F.coalesce(F.greatest(F.lit(0.0), (centre - spread) / width), F.lit(0.0))
    high = F.coalesce(F.least(F.lit(1.0), (centre + spread) / width), F.lit(0.0))
    return low, high


def class_quality(log: DataFrame, label: str, agree: Column, confidence: Column, threshold: float) -> DataFrame:
    """Agreement per predicted class among confident rows with a known answer."""
    rows = log.filter(agree.isNotNull() & (confidence >= threshold))
    n = rows.groupBy(label).agg(F.count("*").alias("n"), count_where(agree).alias("agreed"))
    low, _ = wilson_bounds(F.col("agreed"), F.col("n"))
    return n.select(label, "n", "agreed", F.round(F.col("agreed") / F.col("n"), 6).alias("agreement"), F.round(low, 6).alias("lower"))


def task_digest(log: DataFrame, task: str, since: Column, ready_rows: int, ready_share: float) -> DataFrame:
    """Per task since a time: decisions, agreement, audited accuracy, conflicts, and readiness."""
    agree = F.col("agree")
    recent = log.filter(F.col("created_at") >= since)
    n_yes, n_no = count_where(agree), count_where(~agree)
    audit = F.col("decision") == "audit"
    out = recent.groupBy(task).agg(
        F.count("*").alias("total"),
        *[count_where(F.col("decision") == d).alias(f"n_{d}") for d in ("accept", "audit", "defer")],
        n_yes.alias("agreed"),
        n_no.alias("disagreed"),
        share(n_yes, n_yes + n_no).alias("agreement"),
        share(count_where(audit & agree), count_where(audit & agree.isNotNull())).alias("audit_accuracy"),
        count_where((agree == F.lit(False)) & F.col("human_label").isNull()).alias("conflicts"),
    )
    ready = (F.col("agreed") + F.col("disagreed") >= ready_rows) & (F.col("agreement") >= ready_share)
    return out.withColumn("ready", ready)


def group_report(rows: DataFrame, key: Column, means: Sequence[str], publishable: Column, published: Column) -> DataFrame:
    """Per group: rows, means that skip NULL, percent publishable, and published rows."""
    return rows.groupBy(key.alias("key")).agg(
        F.count("*").alias("n"),
        *[F.round(F.avg(m), 1).alias(f"avg_{m}") for m in means],
        F.bround(100.0 * count_where(publishable) / F.count("*")).cast("long").alias("percent_publishable"),
        count_where(published).alias("n_published"),
    )


def bucket_report(rows: DataFrame, value: Column, buckets: Sequence[tuple[str, Column]]) -> DataFrame:
    """Mean per ordered bucket; the best bucket among those with two rows or more is marked."""
    label = F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in buckets])
    place = F.coalesce(*[F.when(F.col("bucket") == name, F.lit(i)) for i, (name, _) in enumerate(buckets)])
    n = rows.groupBy(label.alias("bucket")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    n = n.filter(F.col("bucket").isNotNull()).withColumn("place", place)
    best = n.filter(F.col("n") >= 2).agg(F.max_by("bucket", F.struct(F.round("mean", 1), -F.col("place"))).alias("best"))
    return n.crossJoin(best).select(  # best is one row
        "bucket", "place", "n", F.round("mean", 6).alias("mean"), F.coalesce(F.col("bucket") == F.col("best"), F.lit(False)).alias("is_best")
    )


def score_histogram(rows: DataFrame, score: Column, bins: int = 10, width: int = 10) -> DataFrame:
    """Rows per bin; the last bin is closed and empty bins show zero."""
    spot = F.least(F.lit(bins - 1), F.floor(score / width)).cast("int").alias("bin")
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(rows.groupBy(spot).agg(F.count("*").alias("n")), "bin", "left").na.fill(0)


def daily_trend(rows: DataFrame, day: Column, value: Column, days: int = 30) -> DataFrame:
    """Mean and count per day in the days before the last one."""
    daily = rows.groupBy(day.alias("day")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    last = daily.agg(F.max("day").alias("last"))
    kept = daily.crossJoin(last).filter(F.col("day") >= F.date_sub("last", days))  # last is one row
    return kept.select(F.col("day").cast("string").alias("day"), F.round("mean", 6).alias("mean"), "n")


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; NULL under three pairs or without spread."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    usable = (F.count(a) >= 3) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    return F.when(usable, F.corr(a, b))


def issue_rates(rows: DataFrame, codes: Column) -> DataFrame:
    """Percent of rows that show each issue code at least once."""
    total = rows.agg(F.count("*").alias("total"))
    n = rows.select(F.explode(F.array_distinct(codes)).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))
    return n.crossJoin(total).select("issue", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percent"))  # total is one row


def reviewer_gap(rows: DataFrame, reviewer: str, expert: Column, code: Column) -> DataFrame:
    """Per reviewer: rows with an expert score, both means, and the mean difference."""
    return rows.filter(expert.isNotNull()).groupBy(reviewer).agg(
        F.count("*").alias("n"),
        F.round(F.avg(expert), 6).alias("expert"),
        F.round(F.avg(code), 6).alias("code"),
        F.round(F.avg(expert - code), 6).alias("gap"),
    )


def mean_by_prediction(rows: DataFrame, prediction: Column, actual: Column, none: str) -> DataFrame:
    """Mean outcome per predicted class, with a name for rows without prediction."""
    kept = rows.filter(actual.isNotNull())
    return kept.groupBy(F.coalesce(prediction, F.lit(none)).alias("predicted")).agg(
        F.count("*").alias("n"), F.round(F.avg(actual), 6).alias("mean_actual")
    )


def criteria_means(rows: DataFrame, scores: Column, weakest: int = 2) -> DataFrame:
    """Mean and count per criterion of a score map; the weakest ones are marked."""
    n = rows.select(F.explode(scores).alias("criterion", "score")).groupBy("criterion").agg(
        F.avg("score").alias("mean"), F.count("score").alias("n")
    )
    low = n.orderBy("mean", "criterion").limit(weakest).select("criterion", F.lit(True).alias("is_weakest"))
    return n.join(low, "criterion", "left").select(
        "criterion", F.round("mean", 6).alias("mean"), "n", F.coalesce("is_weakest", F.lit(False)).alias("is_weakest")
    )


def usage_rollup(log: DataFrame, today: str, days: int, budgets: dict[str, int]) -> DataFrame:
    """Per purpose: cloud, local and requests of today, the total of the last days, and the budget flag."""
    day = F.col("day")
    now = day == today
    recent = day > F.date_sub(F.lit(today).cast("date"), days).cast("string")

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("tokens")).otherwise(0)).cast("long")

    budget = F.coalesce(*[F.when(F.col("purpose") == p, F.lit(b)) for p, b in budgets.items()], F.lit(0))
    n = log.filter(recent & (day <= today)).groupBy("purpose").agg(
        total(now & ~F.col("local")).alias("cloud_today"),
        total(now & F.col("local")).alias("local_today"),
        count_where(now).alias("requests_today"),
        total(F.lit(True)).alias("week_total"),
    )
    return n.withColumn("over_budget", (budget > 0) & (F.col("cloud_today") >= budget))


def char_usage(log: DataFrame, month: Column, day: Column, today: str, knowledge: Column, budget: int) -> DataFrame:
    """Characters per engine and month, the part spent on knowledge, today's part, and what the budget leaves."""
    chars = F.col("chars")
    return log.filter(chars > 0).groupBy("engine", month.alias("month")).agg(
        F.sum(chars).cast("long").alias("total"),
        F.sum(F.when(knowledge, chars).otherwise(0)).cast("long").alias("knowledge"),
        F.sum(F.when(day == today, chars).otherwise(0)).cast("long").alias("today"),
        F.greatest(F.lit(0), F.lit(budget) - F.sum(chars)).cast("long").alias("budget_left"),
    )


def url_pattern_stats(visits: DataFrame, site: str, pattern: str, hit: Column, parent: str) -> DataFrame:
    """Per site and pattern: hits, misses, pages it led to, smoothed productivity, hub value, dead flag."""
    own = visits.select(site, F.col(pattern).alias("pattern"), F.when(hit, 1).otherwise(0).alias("h"), F.when(hit, 0).otherwise(1).alias("m"), F.lit(0).alias("d"))
    led = visits.filter(hit & F.col(parent).isNotNull()).select(site, F.col(parent).alias("pattern"), F.lit(0).alias("h"), F.lit(0).alias("m"), F.lit(1).alias("d"))
    n = own.unionByName(led).groupBy(site, "pattern").agg(
        F.sum("h").cast("long").alias("hits"), F.sum("m").cast("long").alias("misses"), F.sum("d").cast("long").alias("discovered")
    )
    return n.select(
        "*",
        F.round((F.col("hits") + 1) / (F.col("hits") + F.col("misses") + 2), 6).alias("productivity"),
        F.round(F.least(F.lit(1.0), F.col("discovered") / (F.col("hits") + F.col("misses") + 1)), 6).alias("hub_value"),
        ((F.col("misses") >= 8) & (F.col("hits") == 0) & (F.col("discovered") == 0)).alias("dead"),
    )


def kind_yields(runs: DataFrame, kind: str, value: Column, minutes: Column) -> DataFrame:
    """Runs, value and value per minute of each kind; a run counts for a minute at least."""
    n = runs.groupBy(kind).agg(
        F.count("*").alias("n"), F.sum(value).alias("value"), F.sum(F.greatest(F.lit(1.0), minutes)).alias("minutes")
    )
    return n.withColumn("per_minute", F.round(F.col("value") / F.col("minutes"), 4))


def ucb_bonus(yields: DataFrame, explore: float = 0.5, most: float = 10.0) -> DataFrame:
    """Clipped upper-confidence bonus of each kind against the best kind."""
    whole = yields.agg(F.sum("n").alias("all_n"), F.max("per_minute").alias("best"))
    best = F.when(F.col("best") == 0, F.lit(1.0)).otherwise(F.col("best"))
    ucb = F.col("per_minute") / best + explore * F.sqrt(F.log(F.col("all_n") + 1.0) / (F.col("n") + 1))
    raised = F.least(F.lit(most), F.greatest(F.lit(-most / 2), most * (ucb - 0.5)))
    return yields.crossJoin(whole).withColumn("bonus", F.round(raised, 2)).drop("all_n", "best")  # whole is one row


def layout_usage(placed: DataFrame, entity: str, place: str, part: str) -> DataFrame:
    """Points per place and part, and how many entities use the place."""
    return placed.groupBy(place, part).agg(F.count("*").alias("points"), F.countDistinct(entity).alias("entities"))


def gate_summary(rejections: DataFrame, waiting: DataFrame, entity: str, now: Column) -> DataFrame:
    """Rejected entities with the verified facts that wait behind the rejection."""
    n = waiting.groupBy(entity).agg(F.count("*").alias("waiting"))
    return rejections.join(n, entity, "left").select(
        entity, F.coalesce("waiting", F.lit(0)).alias("waiting"), F.coalesce(F.col("blocked_until") > now, F.lit(False)).alias("blocked")
    )


def daily_changelog(entries: DataFrame, day: Column, entity: str, amount: Column, language: Column) -> DataFrame:
    """Per day and entity: summed changes and the set of languages; the language list bounds the set."""
    return entries.groupBy(day.alias("day"), entity).agg(
        F.sum(amount).cast("long").alias("added"),
        F.array_join(F.array_sort(F.collect_set(language)), ",").alias("languages"),
    )


def provider_utility(calls: DataFrame, model: str, ok: Column, latency: Column, base: Column, rerank_after: int = 20) -> DataFrame:
    """Base score times the Beta mean of success times a latency penalty; models with few calls keep the base."""
    n = calls.groupBy(model).agg(
        F.count("*").alias("calls"), count_where(ok).alias("successes"), F.avg(latency).alias("latency"), F.max(base).alias("base")
    )
    slow = 1 + F.log10(1 + F.col("latency") / 5.0)
    score = F.col("base") * (F.col("successes") + 1) / (F.col("calls") + 2) / slow
    scored = n.withColumn("utility", F.when(F.col("calls") >= rerank_after, score).otherwise(F.col("base")))
    order = Window.orderBy(F.desc("utility"), F.asc(model))  # one row per model
    return scored.withColumn("rank", F.row_number().over(order))


def term_counts(terms: DataFrame, term: Column, known: DataFrame, least_chars: int = 3) -> DataFrame:
    """Cleaned terms that no known name covers, counted."""
    clean = terms.select(term.alias("term")).filter(F.length("term") >= least_chars)
    return clean.groupBy("term").agg(F.count("*").alias("n")).join(known, "term", "left_anti")


def backlog(groups: dict[str, DataFrame], item: str, first: int) -> DataFrame:
    """Named groups of waiting items with their size and first items, as rows."""
    parts = [df.select(F.lit(name).alias("group"), F.col(item).alias("item")) for name, df in groups.items()]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    sizes = rows.groupBy("group").agg(F.count("*").alias("size"))
    heads = top_per_key(rows, ["group"], [F.asc("item")], first)
    return sizes.join(heads, "group")


def item_overview(items: DataFrame, mapping: DataFrame, facts: DataFrame, item: str, entity: str) -> DataFrame:
    """Per item: statements of its mapped entities in all, on topic, and still to verify."""
    per_entity = facts.groupBy(entity).agg(
        F.count("*").alias("n_all"), count_where(F.col("on_topic")).alias("n_topic"), count_where(F.col("status") == "new").alias("n_to_verify")
    )
    # pairs of the mapping stay where they are made: counts of entities go to them, and only sums of items are shuffled
    sums = mapping.join(few(per_entity, 1_000_000), entity).groupBy(item).agg(*[F.sum(c).cast("long").alias(c) for c in ("n_all", "n_topic", "n_to_verify")])
    return items.join(sums, item, "left").na.fill(0, ["n_all", "n_topic", "n_to_verify"])


def label_origin_stats(samples: DataFrame, label: str, origin: str) -> DataFrame:
    """Counts per label and per origin of a training set, tagged by facet."""
    a = samples.groupBy(F.col(label).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit("label").alias("facet"), "value", "n")
    b = samples.groupBy(F.col(origin).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit("origin").alias("facet"), "value", "n")
    return a.unionByName(b)


def facet_counts(rows: DataFrame, facets: dict[str, Column], k: int) -> DataFrame:
    """Top values of several facets in one pass: rows are unfolded once and counted per facet and value."""
    pairs = F.array(*[F.struct(F.lit(f).alias("facet"), c.cast("string").alias("value")) for f, c in facets.items()])
    n = rows.select(F.inline(pairs)).filter(F.col("value").isNotNull()).groupBy("facet", "value").agg(F.count("*").alias("n"))
    return top_per_key(n, ["facet"], [F.desc("n"), F.asc("value")], k)


def load_summary(jobs: DataFrame, calls: DataFrame, since: Column, max_jobs: int, max_queue: int = 2) -> DataFrame:
    """Open model jobs, success of recent remote calls, the local queue, and the reasons for overload."""
    a = jobs.agg(count_where(F.col("status").isin("queued", "running")).alias("jobs"))
    b = calls.filter(F.col("called_at") >= since).agg(
        count_where(~F.col("local")).alias("remote_calls"),
        count_where(~F.col("local") & F.col("ok")).alias("remote_ok"),
        count_where(F.col("local") & ~F.col("ok")).alias("local_queue"),
    )
    down = (F.col("remote_calls") >= 6) & (share(F.col("remote_ok"), F.col("remote_calls")) < 0.3)
    reasons = F.concat_ws(
        ";",
        F.when(F.col("jobs") >= max_jobs, "jobs"),
        F.when(down, "remote"),
        F.when(F.col("local_queue") >= max_queue, "queue"),
    )
    return a.crossJoin(b).withColumn("reasons", reasons).withColumn("overloaded", reasons != "")  # one row each


def topic_sets(rows: DataFrame, entity: str, language: Column) -> DataFrame:
    """Per entity: covered languages (a bounded list) and the number of topic statements."""
    return rows.groupBy(entity).agg(
        F.array_join(F.array_sort(F.collect_set(language)), ",").alias("languages"), F.count("*").alias("n_facts")
    )


def entity_scorecard(n: DataFrame, entity: str, weights: dict[str, float]) -> DataFrame:
    """Five scores of 0 to 100, their weighted total, and the flags of what is missing.

    ``n`` holds per entity: percent, hard, languages, distant, stories_own, stories_web, stories_foreign, recipes,
    special_recipes, sources, photos, merged, points.
    """

    def capped(value: Column) -> Column:
        return F.least(F.lit(100.0), value.cast("double"))

    def yes(name: str, bonus: int) -> Column:
        return F.when(F.col(name), bonus).otherwise(0)

    scored = n.select(
        "*",
        capped(F.col("percent")).alias("completeness"),
        capped(F.col("hard") * 5 + F.col("languages") * 10 + F.when(F.col("distant") > 0, 20).otherwise(0)).alias("hard_knowledge"),
        capped((F.col("stories_own") + F.col("stories_web") + F.col("stories_foreign")) * 6).alias("stories"),
        capped(F.col("special_recipes") * 15 + F.when(F.col("recipes") > 0, 10).otherwise(0)).alias("recipe_score"),
        capped(F.col("sources") * 10 + yes("photos", 20) + yes("merged", 10)).alias("source_score"),
    )
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + F.col(name) * weight
    few_stories = (F.col("stories_own") + F.col("stories_web") < 4) | (F.col("stories_foreign") == 0)
    flags = F.concat_ws(
        ",",
        F.when(F.col("points") == 0, "no_points"),
        F.when(few_stories, "few_stories"),
        F.when(F.col("distant") == 0, "nothing_distant"),
        F.when((F.col("points") > 0) & ~F.col("merged"), "to_merge"),
        F.when(~F.col("photos"), "no_photos"),
        F.when(F.col("percent") < 60, "low_coverage"),
        F.when(F.col("special_recipes") == 0, "no_recipes"),
    )
    return scored.select(entity, *weights, F.round(total, 1).alias("score"), flags.alias("flags"))


def corpus_kpis(cards: DataFrame) -> DataFrame:
    """Totals and averages over all scorecards, in one row."""
    return cards.agg(
        F.count("*").alias("entities"),
        F.round(F.avg("score"), 1).alias("avg_score"),
        F.round(F.avg("completeness"), 1).alias("avg_completeness"),
        count_where(~F.array_contains(F.split("flags", ","), "few_stories")).alias("with_stories"),
        count_where(F.array_contains(F.split("flags", ","), "no_recipes")).alias("without_recipes"),
    )


def flag_counts(cards: DataFrame) -> DataFrame:
    """How many scorecards carry each flag."""
    flag = F.explode(F.filter(F.split("flags", ","), lambda f: f != ""))
    return cards.select(flag.alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def version_changes(old: DataFrame, new: DataFrame, entity: str, parts: Sequence[str]) -> DataFrame:
    """Per entity: elements added to and removed from each array column between two versions."""
    a = old.select(entity, *[F.col(p).alias(f"old_{p}") for p in parts])
    b = new.select(entity, *[F.col(p).alias(f"new_{p}") for p in parts])
    both = a.join(b, entity, "full")

    def size(left: str, right: str) -> Column:
        empty = F.array().cast("array<string>")
        return F.size(F.array_except(F.coalesce(F.col(left), empty), F.coalesce(F.col(right), empty)))

    cols = []
    for p in parts:
        cols += [size(f"new_{p}", f"old_{p}").alias(f"added_{p}"), size(f"old_{p}", f"new_{p}").alias(f"removed_{p}")]
    changed = both.select(entity, F.col(f"old_{parts[0]}").isNull().alias("is_new"), *cols)
    touched = sum((F.col(f"added_{p}") + F.col(f"removed_{p}") for p in parts[1:]), F.col(f"added_{parts[0]}") + F.col(f"removed_{parts[0]}"))
    return changed.filter((touched > 0) | F.col("is_new"))
