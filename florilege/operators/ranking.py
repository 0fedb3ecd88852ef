"""Sorts, limits, budgeted picks and interleaved query lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from florilege.operators.primitives import numbered, top_per_key


def entities_to_research(entities: DataFrame, entity: str, skip: Sequence[DataFrame], limit: int) -> DataFrame:
    """Never researched first by value, mentions and name; then lowest coverage, oldest. Skipped sets anti-join out."""
    rows = entities
    for odd in skip:
        rows = rows.join(odd.select(entity).distinct(), entity, "left_anti")
    never = F.col("last_research").isNull()
    order = [
        F.when(never, 0).otherwise(1),
        F.when(never, -F.coalesce("value", F.lit(0.0))).otherwise(F.coalesce("coverage", F.lit(0.0))),
        F.when(never, -F.coalesce("mentions", F.lit(0))).otherwise(F.lit(0)),
        F.when(never, F.lit(None)).otherwise(F.col("last_research")),
        F.col("name"),
    ]
    return rows.orderBy(*order, entity).limit(limit)


def entities_for_topic(entities: DataFrame, entity: str, counts: DataFrame, searches: DataFrame, leads: DataFrame, famous: Column, limit: int) -> DataFrame:
    """Not searched or with open leads first, famous groups first, then fewest topic facts, oldest search."""
    j = entities.join(counts, entity, "left").join(searches, entity, "left").join(leads, entity, "left")
    searched = F.col("last_search").isNotNull() & (F.coalesce("open_leads", F.lit(0)) == 0)
    return j.orderBy(searched, ~famous, F.coalesce("n_facts", F.lit(0)), F.asc_nulls_first("last_search"), entity).limit(limit)


def lead_order(leads: DataFrame, covered: DataFrame, language: str, lead: str, limit: int) -> DataFrame:
    """Shallow leads first, uncovered languages first, then the best parents, then the oldest."""
    j = leads.join(covered.select(language, F.lit(True).alias("_covered")).distinct(), language, "left")
    order = [F.col("depth"), F.coalesce("_covered", F.lit(False)), F.desc("parent_yield"), F.col(lead)]
    return j.orderBy(*order).limit(limit).drop("_covered")


def recipe_leads_due(leads: DataFrame, lead: str, max_attempts: int, limit: int) -> DataFrame:
    """Open leads by attempts, never searched first, then the longest ago."""
    rows = leads.filter((F.col("status") == "open") & (F.col("attempts") < max_attempts))
    return rows.orderBy("attempts", F.col("last_search").isNotNull(), "last_search", lead).limit(limit)


def diverse_pick(rows: DataFrame, entity: str, kinds: Sequence[str], rank: str, limit: int) -> DataFrame:
    """Best sources per entity, one of each kind first while there are more than fit, then filled up."""
    best = Window.partitionBy(entity, *kinds).orderBy(rank)
    first = F.when(F.row_number().over(best) == 1, 0).otherwise(1)
    return top_per_key(rows.withColumn("_again", first), [entity], [F.asc("_again"), F.asc(rank)], limit, "pick").drop("_again")


def language_plan(reads: DataFrame, entity: str, language: str, priority: Sequence[str], always: Sequence[str], per_run: int, refresh_before: Column) -> DataFrame:
    """Languages to read per entity: unread by priority, else the least recently read; some always on top.

    ``reads`` holds each available language of an entity with ``read`` and ``read_at``.
    """
    place = F.coalesce(*[F.when(F.col(language) == x, F.lit(i)) for i, x in enumerate(priority)], F.lit(len(priority)))
    fixed = F.col(language).isin(*always)
    due = F.col("read_at").isNull() | (F.col("read_at") < refresh_before)
    rows = reads.filter(fixed | ~F.col("read") | due).withColumn("_place", place)
    kept = rows.filter(fixed).select(entity, language, F.lit("always").alias("why"))
    order = [F.col("read").asc(), F.when(F.col("read"), F.col("read_at")).asc_nulls_first(), F.asc("_place"), F.asc(language)]
    turn = top_per_key(rows.filter(~fixed), [entity], order, per_run)
    chosen = turn.select(entity, language, F.when(F.col("read"), "refresh").otherwise("new").alias("why"))
    return chosen.unionByName(kept)


def one_per_label(rows: DataFrame, entity: str, label: Column, labels: Sequence[str], order: str, most: int) -> DataFrame:
    """First row of each label in a fixed label order, at most ``most`` per entity."""
    place = F.coalesce(*[F.when(F.col("label") == x, F.lit(i)) for i, x in enumerate(labels)], F.lit(len(labels)))
    firsts = rows.withColumn("label", label).groupBy(entity, "label").agg(F.min(order).alias(order))
    return top_per_key(firsts.withColumn("_place", place), [entity], [F.asc("_place"), F.asc("label")], most).drop("_place")


def season_score(tasks: Column, months: Column, harvest: Column, recipes: Column, facts: Column) -> Column:
    """3 for tasks this month, 2 for a harvest among them, 1 for recipes, half for facts."""
    now = F.arrays_overlap(tasks, months)
    score = F.when(now, 3.0).otherwise(0.0) + F.when(now & harvest, 2.0).otherwise(0.0)
    return score + F.when(recipes, 1.0).otherwise(0.0) + F.when(facts, 0.5).otherwise(0.0)


def season_months(day: Column) -> Column:
    """The month of a day and, from the 21st on, the next one."""
    month = F.month(day)
    return F.when(F.dayofmonth(day) > 20, F.array(month, month % 12 + 1)).otherwise(F.array(month))


def seeded_noise(key: Column, seed: int, width: float) -> Column:
    """Repeatable noise between 0 and ``width`` from a hash instead of a random generator."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) / 10_000 * width


def season_pick(entities: DataFrame, entity: str, score: Column, recent: DataFrame, limit: int) -> DataFrame:
    """Best scored entities; those of recent posts fall behind by ten points."""
    j = entities.join(recent.select(entity, F.lit(10.0).alias("_minus")).distinct(), entity, "left")
    return j.withColumn("score", F.round(score - F.coalesce("_minus", F.lit(0.0)), 6)).drop("_minus").orderBy(F.desc("score"), entity).limit(limit)


def idea_pool(ideas: DataFrame, idea: str, used: DataFrame, month: int, limit: int, bonus: float = 8.0) -> DataFrame:
    """Rated, unused ideas without risk; those of the season rank higher."""
    live = ideas.filter(F.col("status").isin("new", "rated") & ~F.col("risky")).join(used.select(idea).distinct(), idea, "left_anti")
    total = F.col("score") + F.when(F.array_contains("months", month), bonus).otherwise(0.0)
    return live.withColumn("total", total).orderBy(F.desc("total"), idea).limit(limit)


def recipe_score(foreign: Column, distant: Column, unusual: Column, tradition: Column) -> Column:
    """3 for a foreign record, 1 for distant origin, 1.5 for an unusual type, 1 for a tradition note."""
    parts = ((foreign, 3.0), (distant, 1.0), (unusual, 1.5), (tradition, 1.0))
    total = F.lit(0.0)
    for condition, points in parts:
        total = total + F.when(condition, points).otherwise(0.0)
    return total


def best_unused(rows: DataFrame, key: str, used: DataFrame, score: Column) -> DataFrame:
    """The single best row that was not used yet; a global maximum without a sort."""
    live = rows.join(used.select(key).distinct(), key, "left_anti").withColumn("score", score)
    return live.agg(F.max_by(F.struct(key, "score"), F.struct("score", -F.col(key))).alias("b")).select("b.*")


def gap_list(cover: DataFrame, part_gaps: DataFrame, entity: str, topic_of: dict[str, str], priority: Sequence[str]) -> DataFrame:
    """Empty slots and empty part fields of each entity with their topic and its priority."""
    topic = F.coalesce(*[F.when(F.col("slot") == s, F.lit(x)) for s, x in topic_of.items()], F.lit(priority[-1]))
    slots = cover.filter(F.col("state") == "missing").select(entity, "slot", topic.alias("topic"))
    rows = slots.unionByName(part_gaps.select(entity, "slot", "topic"))
    return rows.withColumn("place", F.coalesce(*[F.when(F.col("topic") == x, F.lit(i)) for i, x in enumerate(priority)], F.lit(len(priority))))


def gap_queries(gaps: DataFrame, entity: str, names: DataFrame, topics: DataFrame, asked: DataFrame, max_topics: int = 4, per_topic: int = 2) -> DataFrame:
    """Queries for the first topics of an entity, a few languages each, without those asked before.

    ``names`` holds ``(entity, lang, name)``, ``topics`` holds ``(topic, lang, words, lang_order)``. A topic whose
    queries were all asked takes no place.
    """
    firsts = gaps.groupBy(entity, "topic").agg(F.min("place").alias("place"))
    query = F.concat(F.lit('"'), F.col("name"), F.lit('" '), F.col("words"))
    rows = firsts.join(topics, "topic").join(names, [entity, "lang"]).withColumn("query", query)
    rows = rows.join(asked.select(entity, "query").distinct(), [entity, "query"], "left_anti")
    rows = top_per_key(rows, [entity, "topic"], [F.asc("lang_order"), F.asc("lang")], per_topic)
    seen = Window.partitionBy(entity).orderBy("place", "topic")  # a fixed list of topics times per_topic
    return rows.withColumn("_t", F.dense_rank().over(seen)).filter(F.col("_t") <= max_topics).select(entity, "topic", "lang", "query")


def template_queries(names: DataFrame, words: Sequence[str], general: Sequence[str], used: DataFrame, limit: int) -> DataFrame:
    """Name and preparation combinations in rounds, every third query a general one, unused only.

    ``names`` holds ``(name, pos)`` with positions from 0.
    """
    spark = names.sparkSession
    n = len(words)
    rounds = spark.range(n).select(F.col("id").cast("int").alias("r"))
    word = F.element_at(F.array(*[F.lit(w) for w in words]), F.pmod(F.col("pos") + F.col("r"), F.lit(n)).cast("int") + 1)
    combos = names.crossJoin(F.broadcast(rounds)).select(  # a fixed list of words
        F.concat_ws(" ", "name", word).alias("query"), "r", "pos"
    )
    combos = combos.groupBy("query").agg(F.min(F.struct("r", "pos")).alias("o"))
    combos = combos.withColumn("_low", F.lower("query")).join(used.select(F.lower("query").alias("_low")).distinct(), "_low", "left_anti")
    # only the first rows can be taken, so a limited sort comes before the numbering
    firsts = combos.orderBy("o").limit(limit)
    nr = F.row_number().over(Window.orderBy("o")) - 1
    a = firsts.select("query", F.floor(nr / 2).cast("long").alias("grp"), F.lit(0).alias("late"), (nr % 2).alias("nr"))
    g = spark.createDataFrame([(q, i) for i, q in enumerate(dict.fromkeys(general))], "query string, i int")
    g = g.withColumn("_low", F.lower("query")).join(used.select(F.lower("query").alias("_low")).distinct(), "_low", "left_anti")
    gn = F.row_number().over(Window.orderBy("i")) - 1  # a fixed list
    b = g.select("query", gn.cast("long").alias("grp"), F.lit(1).alias("late"), F.lit(0).alias("nr"))
    return a.unionByName(b).orderBy("grp", "late", "nr").limit(limit).select("query")


def interleave(streams: DataFrame, entity: str, limit: int, archive_every: int = 3) -> DataFrame:
    """Merges three ranked streams per entity: every third place an archive query, else leads and concepts in turn.

    ``streams`` holds ``(entity, stream, rank, query)`` with streams ``lead``, ``concept`` and ``archive``; only the
    first ``limit`` of each can be taken, so the arrays stay that short.
    """
    head = top_per_key(streams, [entity, "stream"], [F.asc("rank")], limit, "_r")

    def items(stream: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("stream") == stream, F.struct("_r", "query"))))
        return F.transform(rows, lambda x: x["query"])

    g = head.groupBy(entity).agg(*[items(s).alias(s) for s in ("lead", "concept", "archive")])

    def step(state: Column, n: Column) -> Column:
        left = {s: state[s] for s in ("lead", "concept", "archive")}
        has = {s: F.size(left[s]) > 0 for s in left}
        pick = (
            F.when((n % archive_every == archive_every - 1) & has["archive"], "archive")
            .when((n % 2 == 0) & has["lead"], "lead")
            .when(has["concept"], "concept")
            .when(has["lead"], "lead")
            .when(has["archive"], "archive")
        )
        rest = {s: F.when(pick == s, F.slice(left[s], 2, limit)).otherwise(left[s]).alias(s) for s in left}
        first = F.coalesce(*[F.when(pick == s, F.get(left[s], F.lit(0))) for s in left])
        out = F.when(pick.isNull(), state["out"]).otherwise(F.array_append(state["out"], first))
        return F.struct(rest["lead"], rest["concept"], rest["archive"], out.alias("out"))

    start = F.struct("lead", "concept", "archive", F.array().cast("array<string>").alias("out"))
    merged = F.aggregate(F.sequence(F.lit(0), F.lit(limit - 1)), start, step, lambda s: s["out"])
    return g.select(entity, F.posexplode(merged).alias("place", "query"))


def page_of(rows: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """One page of rows with the total and whether more follow."""
    total = rows.agg(F.count("*").alias("total"))
    part = rows.orderBy(*order).offset((page - 1) * size).limit(size)
    return part.crossJoin(total).withColumn("has_next", F.col("total") > page * size)  # total is one row


def chunked(rows: DataFrame, kind: str, entity: str, order: Sequence[Column], size: int, chunks: int) -> DataFrame:
    """Flagged entities of each kind cut in chunks; chunks beyond the limit are left out."""
    top = top_per_key(rows, [kind], order, size * chunks)
    return top.select(kind, entity, (F.floor((F.col("rank") - 1) / size) + 1).cast("long").alias("chunk"))


def expert_override(recs: DataFrame, overrides: DataFrame, number: str, added: DataFrame | None = None, additions: int = 5, top: int = 5) -> DataFrame:
    """Reviewed priorities, held between 1 and ``top``, for known numbers only; rows that nobody reviewed stay as they are.

    Unknown numbers are listed as rejected. ``added`` holds new recommendations (position, priority); the first
    ``additions`` of them are numbered on from the largest known number.
    """
    held = lambda p: F.greatest(F.lit(1), F.least(F.lit(top), p)).cast("long")
    o = overrides.select(number, F.col("priority").alias("_priority"))
    changed = recs.join(o, number, "left").select(
        number,
        F.when(F.col("_priority").isNull(), F.col("priority").cast("long")).otherwise(held(F.col("_priority"))).alias("priority"),
        F.when(F.col("_priority").isNull(), "kept").otherwise("changed").alias("outcome"),
    )
    unknown = overrides.join(recs, number, "left_anti").select(number, "priority", F.lit("rejected").alias("outcome"))
    out = changed.unionByName(unknown)
    if added is None:
        return out
    first = added.orderBy("position").limit(additions)  # a few rows, so the place is counted in one task
    place = first.select("position", "priority", F.row_number().over(Window.orderBy("position")).alias("_place"))
    largest = recs.agg(F.max(number).alias("_last"))  # one row
    new = place.crossJoin(largest).select((F.coalesce("_last", F.lit(0)) + F.col("_place")).alias(number), held(F.coalesce("priority", F.lit(3))).alias("priority"), F.lit("added").alias("outcome"))
    return out.unionByName(new)


def budget_fold(chunks: Column, budget: int) -> Column:
    """Greedy choice of ordered text chunks within a character budget; a later smaller chunk may still fit.

    The first chunk is cut to the budget when nothing fits before it.
    """

    def step(state: Column, chunk: Column) -> Column:
        fits = state["size"] + F.length(chunk) <= budget
        cut = ~fits & (F.size(state["out"]) == 0)
        add = F.when(cut, F.left(chunk, F.lit(budget))).otherwise(chunk)
        out = F.when(fits | cut, F.array_append(state["out"], add)).otherwise(state["out"])
        size = F.when(fits, state["size"] + F.length(chunk)).otherwise(state["size"])
        return F.struct(size.alias("size"), out.alias("out"))

    start = F.struct(F.lit(0).alias("size"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(chunks, start, step, lambda s: s["out"])


def recency_narrow(tasks: DataFrame, task: str, entity: str, recent: DataFrame) -> DataFrame:
    """Task and entity rows without recently ordered entities; tasks left empty vanish by themselves."""
    left = tasks.join(recent.select(entity).distinct(), entity, "left_anti")
    sizes = left.groupBy(task).agg(F.count("*").alias("left"))
    return left.join(sizes, task)


def grouped_pick(facts: DataFrame, groups: Sequence[str], fact: str, weight: Column, noise: Column, k: int = 3) -> DataFrame:
    """Best group of facts by size and best weight; its best ``k`` facts."""
    w = facts.withColumn("_w", weight)
    scored = w.groupBy(*groups).agg(F.count("*").alias("n"), F.max("_w").alias("best"))
    score = F.least("n", F.lit(3)) * 3 + F.col("best") + noise
    top = scored.withColumn("_score", score).orderBy(F.desc("_score"), *groups).limit(1)
    return w.join(top.select(*groups, "_score"), list(groups)).orderBy(F.desc("_w"), fact).limit(k).select(*groups, fact, F.round("_score", 6).alias("score"))


def url_templates(names: DataFrame, templates: Sequence[tuple[str, str]], name: str, latin: str) -> DataFrame:
    """Addresses from a fixed list of ``(base, template)`` with percent-encoded names."""

    def quoted(c: str) -> Column:
        return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))

    filled = F.replace(F.col("template"), F.lit("{name}"), quoted(name))
    filled = F.replace(filled, F.lit("{latin_plus}"), F.url_encode(latin))
    filled = F.replace(filled, F.lit("{latin}"), quoted(latin))
    every = F.array(*[F.struct(F.lit(b).alias("base"), F.lit(x).alias("template")) for b, x in templates])
    return names.select("*", F.inline(every)).select(*names.columns, "base", filled.alias("url"))


def rank_all(rows: DataFrame, order: Sequence[Column], bucket: Column, name: str = "rank") -> DataFrame:
    """Number every row in a global order without a single-task sort."""
    return numbered(rows, [], order, bucket, name)
