"""Newest rows, streaks, retention and thresholds over ordered rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.operators.primitives import count_where, newest_per_key, numbered, quantile_bucket, running, top_per_key
from florilege.session import cut_lineage


def streaks(rows: DataFrame, key: str, order: Sequence[str], reset: Column, counted: Column) -> DataFrame:
    """Per key: counted rows after the last reset and the order of the last one.

    Two grouped aggregates and one join: no key is ever sorted in one task.
    """
    marked = rows.select(key, F.struct(*order).alias("_at"), reset.alias("_reset"), counted.alias("_counted"))
    last = marked.groupBy(key).agg(F.max(F.when(F.col("_reset"), F.col("_at"))).alias("_last_reset"))
    after = F.col("_counted") & (F.col("_last_reset").isNull() | (F.col("_at") > F.col("_last_reset")))
    return marked.join(last, key).groupBy(key).agg(
        count_where(after).alias("streak"), F.max(F.when(after, F.col("_at"))).alias("last_counted")
    )


def low_yield_backoff(runs: DataFrame, key: str, order: Sequence[str], yielded: Column, least: int = 2, days: Sequence[int] = (7, 14, 30)) -> DataFrame:
    """From the second low run in a row a key pauses for growing numbers of days; a good run clears the pause."""
    out = streaks(runs, key, order, yielded >= least, yielded < least)
    step = F.least(F.col("streak") - 1, F.lit(len(days))).cast("int")
    pause = F.when(F.col("streak") >= 2, F.element_at(F.array(*[F.lit(d) for d in days]), step))
    until = F.col("last_counted")[order[0]] + F.make_dt_interval(pause)
    return out.select(key, F.col("streak").alias("low_runs"), F.coalesce(pause, F.lit(0)).alias("pause_days"), until.alias("paused_until"))


def block_backoff(runs: DataFrame, key: str, order: Sequence[str], success: Column, blocked: Column, hours: Sequence[int] = (1, 6, 24)) -> DataFrame:
    """Blocks in a row pause a source for growing hours; one more switches it off; success clears the count."""
    out = streaks(runs, key, order, success, blocked)
    off = F.col("streak") > len(hours)
    step = F.least(F.greatest(F.col("streak"), F.lit(1)), F.lit(len(hours))).cast("int")
    pause = F.when((F.col("streak") > 0) & ~off, F.element_at(F.array(*[F.lit(h) for h in hours]), step))
    until = F.col("last_counted")[order[0]] + F.make_dt_interval(F.lit(0), pause)
    return out.select(key, F.col("streak").alias("blocks"), off.alias("switched_off"), until.alias("paused_until"))


def circuit_breaker(rows: DataFrame, key: str, order: Sequence[str], same: Sequence[str], trips: int, hours: int, now: Column) -> DataFrame:
    """Blocks a key whose last rejections repeat one reason and signature until time passes.

    ``same`` columns are NULL for a success, which clears the count.
    """
    newest = newest_per_key(rows.select(key, *order, *same), [key], order)
    newest = newest.select(key, *[F.col(c).alias(f"_last_{c}") for c in same])
    joined = rows.join(newest, key)
    differs = F.lit(False)
    for c in same:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_last_{c}"))
    out = streaks(joined, key, order, differs | F.col(same[0]).isNull(), F.col(same[0]).isNotNull() & ~differs)
    fresh = F.col("last_counted")[order[0]] >= now - F.expr(f"INTERVAL {hours} HOURS")
    return out.join(newest, key).select(
        key,
        *[F.col(f"_last_{c}").alias(c) for c in same],
        F.col("streak").alias("repeats"),
        F.coalesce((F.col("streak") >= trips) & fresh, F.lit(False)).alias("blocked"),
    )


def choose_threshold(rows: DataFrame, confidence: Column, correct: Column, target: float, least: int = 20) -> DataFrame:
    """Lowest confidence whose rows at or above it reach the target accuracy; 1.01 when there is none.

    Rows are first grouped by confidence, so ties stay together; the running sums go over its quantiles.
    """
    per = rows.groupBy(confidence.alias("conf")).agg(F.count("*").alias("n"), count_where(correct).alias("ok"))
    total = per.agg(F.sum("n").alias("total"))
    cum = running(per, [], [F.desc("conf")], -quantile_bucket(per, ["conf"]), {"cum_n": ("sum", F.col("n")), "cum_ok": ("sum", F.col("ok"))})
    fits = cum.filter((F.col("cum_n") >= least) & (F.col("cum_ok") / F.col("cum_n") >= target))
    best = fits.agg(F.min_by(F.struct("conf", "cum_n", "cum_ok"), "conf").alias("b"))
    return best.crossJoin(total).select(  # one row each
        F.coalesce(F.round("b.conf", 4), F.lit(1.01)).alias("threshold"),
        F.coalesce(F.round(F.col("b.cum_n") / F.col("total"), 6), F.lit(0.0)).alias("coverage"),
        F.round(F.col("b.cum_ok") / F.col("b.cum_n"), 6).alias("accuracy"),
        F.coalesce("b.cum_n", F.lit(0)).alias("n"),
    )


def coverage_curve(rows: DataFrame, confidence: Column, correct: Column, points: int = 21) -> DataFrame:
    """For evenly spaced thresholds: share of rows at or above, and their accuracy.

    Rows are counted per highest threshold they reach; the curve sums these few counts from the top.
    """
    step = points - 1
    reach = rows.groupBy(F.floor(confidence * step + 1e-9).cast("int").alias("i")).agg(F.count("*").alias("n"), count_where(correct).alias("ok"))
    every = rows.sparkSession.range(points).select(F.col("id").cast("int").alias("i"))
    down = Window.orderBy(F.desc("i"))  # one row per threshold
    filled = every.join(reach, "i", "left").na.fill(0)
    cum = filled.select("i", F.sum("n").over(down).alias("n"), F.sum("ok").over(down).alias("ok"))
    total = reach.agg(F.greatest(F.sum("n"), F.lit(1)).alias("total"))
    return cum.crossJoin(total).select(  # total is one row
        F.round(F.col("i") / step, 2).alias("threshold"),
        F.round(F.col("n") / F.col("total"), 6).alias("coverage"),
        F.when(F.col("n") > 0, F.round(F.col("ok") / F.nullif("n", F.lit(0)), 6)).alias("accuracy"),
        "n",
    )


def repeated_failures(runs: DataFrame, key: str, order: Sequence[str], since: Column, n: int = 3) -> DataFrame:
    """Keys whose last ``n`` runs in the window all failed with one error signature."""
    recent = runs.filter(F.col(order[0]) >= since)
    last = top_per_key(recent, [key], [F.desc(c) for c in order], n)
    g = last.groupBy(key).agg(
        F.count("*").alias("n"), count_where(F.col("status") == "failed").alias("failed"),
        F.count("signature").alias("signed"), F.min("signature").alias("signature"), F.max("signature").alias("_other"),
    )
    return g.filter((F.col("n") == n) & (F.col("failed") == n) & (F.col("signed") == n) & (F.col("signature") == F.col("_other"))).select(key, "signature")


def retry_depth(jobs: DataFrame, job: str, retry_of: str, cap: int = 50) -> DataFrame:
    """Length of each retry chain by pointer doubling: the known distance doubles with every join."""
    state = jobs.select(F.col(job).alias("job"), F.col(retry_of).alias("up"), F.when(F.col(retry_of).isNull(), 0).otherwise(1).alias("depth"))
    reach = 1
    while reach < cap:
        above = state.select(F.col("job").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        joined = state.join(above, "up", "left")
        state = joined.select(
            "job",
            F.col("_up").alias("up"),
            F.least(F.lit(cap), F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
        )
        state = cut_lineage(state)
        reach *= 2
        if state.filter(F.col("up").isNotNull() & (F.col("depth") < cap)).isEmpty():
            break
    return state.select("job", "depth")


def entity_history(scores: DataFrame, entity: str, order: Sequence[str], score: str, bucket: Column) -> DataFrame:
    """Scores of an entity over time with the change to the score before."""
    before = running(scores, [entity], [F.asc(c) for c in order], bucket, {"_before": ("max", F.struct(*order, score))}, inclusive=False)
    return before.select(*scores.columns, F.round(F.col(score) - F.col(f"_before.{score}"), 6).alias("delta"))


def best_label_per_ref(labels: DataFrame, ref: str, label: str, origin_rank: Column, newest: str, weight: Column) -> DataFrame:
    """One label per reference: the highest teacher rank, then the newest."""
    return labels.groupBy(ref).agg(F.max_by(F.struct(F.col(label).alias("label"), weight.alias("weight")), F.struct(origin_rank, newest)).alias("b")).select(ref, "b.label", "b.weight")


def cap_groups(rows: DataFrame, group: str, order: str, bucket: Column, max_share: float = 0.08, least: int = 10) -> DataFrame:
    """Groups larger than a share of all rows are split in contiguous sub-groups ``g#k``."""
    total = rows.agg(F.greatest(F.lit(least), F.floor(F.count("*") * max_share)).cast("long").alias("_cap"))
    seen = numbered(rows, [group], [F.asc(order)], bucket, "_nr").crossJoin(total)  # one row
    part = F.floor((F.col("_nr") - 1) / F.col("_cap")).cast("long")
    name = F.when(part == 0, F.col(group)).otherwise(F.concat(F.col(group), F.lit("#"), part.cast("string")))
    return seen.select(*rows.columns, name.alias("capped_group"))


def keep_newest(rows: DataFrame, key: str, order: Sequence[str], k: int, current: Column) -> DataFrame:
    """Retention: the current row and the newest others, ``k`` in all per key."""
    ahead = rows.withColumn("_cur", F.when(current, 0).otherwise(1))
    return top_per_key(ahead, [key], [F.asc("_cur")] + [F.desc(c) for c in order], k).drop("_cur")


def section_cohesion(points: DataFrame, section: Sequence[str], place: str, scores: DataFrame, point: str, share_needed: float, gap: float, least_score: float) -> DataFrame:
    """Points follow their section's majority place when that place scores close enough for them.

    ``scores`` holds ``(point, place, score)``; sections of less than three points stay as they are.
    """
    sizes = points.groupBy(*section).agg(F.count("*").alias("_n"))
    votes = points.filter(F.col(place).isNotNull()).groupBy(*section, place).agg(F.count("*").alias("_votes"))
    top = votes.groupBy(*section).agg(F.max_by(F.struct(F.col(place).alias("place"), "_votes"), F.struct("_votes", place)).alias("_top"))
    lead = sizes.join(top, list(section)).filter((F.col("_n") >= 3) & (F.col("_top._votes") / F.col("_n") >= share_needed))
    led = points.join(lead.select(*section, F.col("_top.place").alias("_lead")), list(section), "left")
    each = led.select(point, "_lead", F.col(place).alias("_own")).join(scores.select(point, F.col("place").alias("_p"), F.col("score").alias("_s")), point)
    at = lambda c: F.max(F.when(F.col("_p") == F.col(c), F.col("_s")))
    both = each.groupBy(point).agg(at("_lead").alias("_lead_score"), at("_own").alias("_own_score"))
    joined = led.join(both, point, "left")
    moves = (F.col("_lead_score") >= least_score) & (F.col("_lead_score") >= F.coalesce("_own_score", F.lit(0.0)) - gap)
    return joined.select(*points.columns, F.when(F.coalesce(moves, F.lit(False)), F.col("_lead")).otherwise(F.col(place)).alias("final_place"))


def champion_challenger(models: DataFrame, task: str, version: str, score: Column, champion: Column, slack: float = 0.01) -> DataFrame:
    """The best candidate replaces the champion unless it is clearly worse; every model gets its status."""
    m = models.withColumn("_score", score).withColumn("_champ", champion)
    best = m.groupBy(task).agg(
        F.max_by(F.when(~F.col("_champ"), F.struct(F.col(version).alias("v"), F.col("_score").alias("s"))), F.when(~F.col("_champ"), F.struct("_score", -F.col(version)))).alias("best"),
        F.max(F.when(F.col("_champ"), F.col("_score"))).alias("champ"),
    )
    wins = F.col("champ").isNull() | (F.col("best.s") >= F.col("champ") - slack)
    status = (
        F.when(F.col("_champ"), F.when(wins & F.col("best").isNotNull(), "retired").otherwise("current"))
        .when((F.col(version) == F.col("best.v")) & wins, "current")
        .otherwise("rejected")
    )
    return m.join(best, task).select(task, version, F.round("_score", 6).alias("score"), status.alias("status"))


def least_recent_rotation(posts: DataFrame, kinds: DataFrame, kind: str, order: str, intro: str, intro_posts: int) -> DataFrame:
    """Kinds by last use, never used first; until the intro kind was used often enough only it is due."""
    used = posts.groupBy(kind).agg(F.max(order).alias("last_used"), F.count("*").alias("n"))
    done = used.agg(F.coalesce(F.max(F.when(F.col(kind) == intro, F.col("n"))), F.lit(0)).alias("_intro"))
    all_kinds = kinds.join(used, kind, "left").crossJoin(done)  # one row
    due = (F.col("_intro") >= intro_posts) | (F.col(kind) == intro)
    ranked = all_kinds.filter(due).withColumn("turn", F.row_number().over(Window.orderBy(F.asc_nulls_first("last_used"), kind)))  # a fixed list of kinds
    return ranked.select(kind, "last_used", "turn")


def silence(beats: DataFrame, job: str, at: str, live: DataFrame, now: Column, limit_minutes: int) -> DataFrame:
    """Minutes since the last sign of life per job; stalled over the limit, dead when no longer live."""
    last = beats.groupBy(job).agg(F.max(at).alias("last_sign"))
    minutes = F.floor(F.timestamp_diff("MINUTE", F.col("last_sign"), now)).cast("long")
    joined = last.join(live.select(job, F.lit(True).alias("_live")), job, "left").withColumn("silent_minutes", minutes)
    state = F.when(F.col("_live").isNull(), "dead").when(F.col("silent_minutes") >= limit_minutes, "stalled").otherwise("alive")
    return joined.select(job, "silent_minutes", state.alias("state"))


def outages(failures: DataFrame, provider: str, model: str, at: str, seconds: int, models: int) -> DataFrame:
    """Times at which several different models of a provider have failed within the window.

    A failure keeps its model "down" for the window. Overlapping spells of one model are merged, then starts and
    ends are summed in time order; each sum goes over time buckets, so a busy provider is spread out.
    """
    secs = F.col("_s")
    f = failures.select(provider, model, F.col(at).alias("_at"), F.unix_micros(F.col(at).cast("timestamp")).alias("_s"))
    width = seconds * 1_000_000
    day = F.floor(secs / 86_400_000_000)
    f = f.groupBy(provider, model, "_s").agg(F.min("_at").alias("_at"))
    f = running(f, [provider, model], [F.asc("_s")], day, {"_prev": ("max", secs)}, inclusive=False)
    f = running(f, [provider, model], [F.desc("_s")], -day, {"_next": ("min", secs)}, inclusive=False)
    starts = f.filter(F.col("_prev").isNull() | (secs - F.col("_prev") > width)).select(provider, model, "_at", "_s", F.lit(1).alias("_d"))
    ends = f.filter(F.col("_next").isNull() | (F.col("_next") - secs > width)).select(provider, model, "_at", (secs + width).alias("_s"), F.lit(-1).alias("_d"))
    moves = running(starts.unionByName(ends), [provider], [F.asc("_s"), F.desc("_d"), F.asc(model)], F.floor(F.col("_s") / 3_600_000_000), {"models_down": ("sum", F.col("_d"))})
    hit = moves.filter((F.col("_d") == 1) & (F.col("models_down") >= models))
    return hit.select(provider, F.col("_at").alias(at), "models_down")


def last_read(reads: DataFrame, entity: str, language: Column, at: str) -> DataFrame:
    """Latest read per entity and language; NULL when no read was ever timed."""
    return reads.filter(language.isNotNull()).groupBy(entity, language.alias("language")).agg(F.max(at).alias("read_at"))


def recent_mains(posts: DataFrame, order: Sequence[str], main: Column, n: int) -> DataFrame:
    """Distinct main entities of the newest posts."""
    return posts.orderBy(*[F.desc(c) for c in order]).limit(n).select(main.alias("entity")).filter("entity IS NOT NULL").distinct()




def cap_variants(rows: DataFrame, url: str, order: str, most: int) -> DataFrame:
    """The first ``most`` query variants of one address; addresses without a query all stay."""
    plain = rows.filter(~F.col(url).contains("?"))
    variants = rows.filter(F.col(url).contains("?")).withColumn("_base", F.substring_index(url, "?", 1))
    return plain.unionByName(top_per_key(variants, ["_base"], [F.asc(order)], most).select(*rows.columns))
