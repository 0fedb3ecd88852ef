"""Readers of JSON stores, dated files, sitemaps and feeds, and writers that keep versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from florilege.functions.text import norm_text, short_sha
from florilege.functions.urls import normalize_url, registrable_domain, site_key
from florilege.operators.primitives import top_per_key

FILE_STEM = r"([^/]+?)(?:\.[A-Za-z0-9]+)?$"
DATED_NAME = r"^(.+?)_(\d{4}-\d{2}-\d{2})(?:_(\d{4}))?\.json$"  # fixed value: series, day and time of a store file


def json_documents(spark: SparkSession, folder: str, entity: str = FILE_STEM) -> DataFrame:
    """One variant per file, named by a pattern over its path; unreadable files and non-objects drop out."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder)
    rows = raw.select(F.regexp_extract(F.col("_metadata.file_path"), entity, 1).alias("entity"), F.try_parse_json("value").alias("doc"))
    return rows.filter(F.schema_of_variant("doc").startswith("OBJECT"))


def record_stores(spark: SparkSession, folder: str, title: str = "tytul") -> DataFrame:
    """Records of files that hold a list, or an object whose first list, whatever its key, is the list; templates and mentions drop out.

    Of records with one id, or one title where there is no id, the first file wins.
    """
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(folder)
    doc = F.try_parse_json("value")
    rows = raw.select(F.col("_metadata.file_path").alias("path"), "value", doc.alias("doc")).filter("doc IS NOT NULL")
    whole = F.try_variant_get("doc", "$", "array<variant>")
    values = F.map_values(F.from_json("value", "map<string,variant>"))
    inner = F.try_variant_get(F.get(F.filter(values, lambda v: F.schema_of_variant(v).startswith("ARRAY")), F.lit(0)), "$", "array<variant>")
    each = rows.select("path", F.posexplode(F.coalesce(whole, inner)).alias("pos", "rec")).filter(F.schema_of_variant("rec").startswith("OBJECT"))
    text = lambda k: F.try_variant_get("rec", f"$.{k}", "string")
    usable = each.filter(~F.contains("path", F.lit("szablon")) & (F.coalesce(text("wzmianka"), F.lit("false")) != "true"))
    key = F.coalesce(text("id"), norm_text(text(title)))
    keyed = usable.select(key.alias("key"), F.struct("path", "pos").alias("o"), F.to_json("rec").alias("rec"))
    return keyed.groupBy("key").agg(F.min_by("rec", "o").alias("rec")).select("key", F.parse_json("rec").alias("rec"))


def file_catalog(spark: SparkSession, folder: str, name: str = r"([^/]+)$") -> DataFrame:
    """Every store file with its series, stamp and whether it is the newest of its series; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    named = files.withColumn("file", F.regexp_extract("path", name, 1))
    stamp = F.concat(F.regexp_extract("file", DATED_NAME, 2), F.lit("_"), F.regexp_extract("file", DATED_NAME, 3))
    parsed = named.withColumn("series", F.nullif(F.regexp_extract("file", DATED_NAME, 1), F.lit(""))).withColumn("stamp", stamp)
    newest = parsed.filter("series IS NOT NULL").groupBy("series").agg(F.max(F.struct("stamp", "path")).alias("_n"))
    j = parsed.join(newest, "series", "left")
    return j.select("path", "file", "series", "stamp", "length", (F.col("series").isNull() | (F.col("path") == F.col("_n.path"))).alias("live"))


def newest_per_series(catalog: DataFrame) -> DataFrame:
    """Live files only."""
    return catalog.filter("live").select("series", "file", "path", "stamp")


def sitemap_urls(spark: SparkSession, folder: str, site: str, keywords: Sequence[str], limit: int | None = None) -> DataFrame:
    """Addresses of sitemap files on one site, those of promising maps first, distinct."""
    rows = spark.read.format("xml").option("rowTag", "url").schema("loc string").load(folder).select(F.col("loc").alias("url"), F.col("_metadata.file_name").alias("map"))
    clean = rows.withColumn("url", normalize_url(F.trim("url"))).filter(site_key(F.col("url")) == site)
    low = F.lower("map")
    rank = (
        F.when(low.rlike("|".join(keywords)), 2).otherwise(0)
        + F.when(low.rlike("post|recipe|przepis|rezept"), 1).otherwise(0)
        - F.when(low.rlike("tag|category|author|image|product|page-sitemap"), 3).otherwise(0)
    )
    best = clean.groupBy("url").agg(F.max(rank).alias("rank"))
    return best if limit is None else best.orderBy(F.desc("rank"), "url").limit(limit)


def feed_urls(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """Links of RSS items and Atom entries, normalized and distinct."""
    rss = spark.read.format("xml").option("rowTag", "item").schema("link string").load(folder).select(F.col("link").alias("url"))
    atom = spark.read.format("xml").option("rowTag", "entry").schema("link struct<_href:string>").load(folder).select(F.col("link._href").alias("url"))
    found = rss.unionByName(atom).select(normalize_url(F.trim("url")).alias("url")).filter("url IS NOT NULL").distinct()
    return found if limit is None else found.orderBy("url").limit(limit)


def merge_search_results(results: Sequence[DataFrame], url: str) -> DataFrame:
    """Results of several engines, one row per address with the engines that found it."""
    rows = results[0]
    for part in results[1:]:
        rows = rows.unionByName(part)
    return rows.groupBy(url).agg(F.min_by("title", F.struct("engine", "pos")).alias("title"), F.array_sort(F.collect_set("engine")).alias("engines"))


def export_records(items: DataFrame, sources: DataFrame, folder: str, series: str, stamp: str) -> DataFrame:
    """Writes approved primaries with all their sources as JSON lines under series and date; returns the new statuses.

    A record has one line for each source (its number, address and whether it is the record's own), so that a
    record with many sources is never one row: readers group by ``item``.
    """
    live = items.filter((F.col("status") == "approved") & F.col("duplicate_of").isNull())
    each = sources.select(F.col("primary").alias("item"), F.col("url").alias("source_url"), "is_primary")
    out = live.drop("status", "duplicate_of", "url").join(each, "item", "left")
    out.write.mode("overwrite").json(f"{folder}/series={series}/date={stamp}")
    done = live.select("item", F.lit(True).alias("_done"))
    return items.join(done, "item", "left").withColumn("status", F.when(F.col("_done"), "exported").otherwise(F.col("status"))).drop("_done")


def content_signature(rows: DataFrame, ignore: Sequence[str] = ()) -> DataFrame:
    """Hash of a table that does not depend on the order of its rows, and their number."""
    cols = [c for c in rows.columns if c not in ignore]
    h = F.xxhash64(F.to_json(F.struct(*cols)))
    return rows.agg(F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash"), F.count("*").alias("n"))


def write_if_changed(rows: DataFrame, folder: str, ignore: Sequence[str] = ("stamp",)) -> bool:
    """Writes the next version only when the content differs from the last one; two summary rows decide."""
    spark = rows.sparkSession
    now = content_signature(rows, ignore).first()
    try:
        log = spark.read.json(f"{folder}/versions").orderBy(F.desc("version")).first()
    except Exception:  # noqa: BLE001 - no version was written so far
        log = None
    if log is not None and (log["hash"], log["n"]) == (now["hash"], now["n"]):
        return False
    version = 1 if log is None else log["version"] + 1
    rows.write.mode("overwrite").parquet(f"{folder}/data/version={version}")
    spark.createDataFrame([(version, now["hash"], now["n"])], "version int, hash string, n long").coalesce(1).write.mode("append").json(f"{folder}/versions")
    return True


def upsert_counters(current: DataFrame, feed: DataFrame, order: str) -> DataFrame:
    """Counters by day, kind and key: the last value of a feed wins, malformed rows are skipped, keys are clipped."""
    day, kind = F.left("day", F.lit(10)), F.left("kind", F.lit(32))
    key = F.left(F.coalesce("key", F.lit("")), F.lit(120))
    good = feed.select(day.alias("day"), kind.alias("kind"), key.alias("key"), F.expr("try_cast(n AS BIGINT)").alias("n"), order).filter("day IS NOT NULL AND kind IS NOT NULL AND n IS NOT NULL")
    last = good.groupBy("day", "kind", "key").agg(F.max_by("n", order).alias("_new"))
    j = current.select("day", "kind", "key", "n").join(last, ["day", "kind", "key"], "full")
    return j.select("day", "kind", "key", F.coalesce("_new", "n").alias("n"))


def refresh_pages(stored: DataFrame, fetched: DataFrame, url: str, columns: Sequence[str]) -> DataFrame:
    """New addresses join; a refresh overwrites only rows that are raw, skipped or in error."""
    new = fetched.select(url, F.lit(True).alias("_new"), *[F.col(c).alias(f"_n_{c}") for c in columns])
    j = stored.join(new, url, "full")
    open_ = F.col("_new") & F.coalesce(F.col("status"), F.lit("raw")).isin("raw", "skipped", "error")
    take = lambda c: F.when(F.coalesce(open_, F.lit(False)), F.col(f"_n_{c}")).otherwise(F.col(c))
    return j.select(url, F.coalesce(F.when(open_ & (F.col("status") != "raw"), "raw"), "status", F.lit("raw")).alias("status"), *[take(c).alias(c) for c in columns])


def change_log(changes: DataFrame, link: str, order: str, keep: int) -> DataFrame:
    """Newest ``keep`` real changes per link with added and removed lines and sizes."""
    from florilege.operators.versions import line_changes

    real = changes.filter(~F.col("before").eqNullSafe(F.col("after")))
    counts = line_changes(real, [link, order], "before", "after")
    sized = real.select(link, order, F.coalesce(F.length("before"), F.lit(0)).alias("size_before"), F.length("after").alias("size_after"), F.col("before").isNull().alias("is_new"))
    return top_per_key(counts.join(sized, [link, order]), [link], [F.desc(order)], keep)


def usage_ledger(ledgers: DataFrame, raw: str) -> DataFrame:
    """Nested JSON ``day -> purpose -> counters`` as rows."""
    doc = F.from_json(raw, "map<string,map<string,struct<chmura:long,lokalnie:long,zapytania:long>>>")
    days = ledgers.select(F.explode(doc).alias("day", "purposes"))
    return days.select("day", F.explode("purposes").alias("purpose", "c")).select("day", "purpose", "c.*")


def cleanup_known(found: DataFrame, item: str, url: str, sources: DataFrame) -> DataFrame:
    """Found sites by their recomputed domain: no known sources, the first of each domain stays."""
    d = found.withColumn("domain", registrable_domain(F.col(url))).filter("domain IS NOT NULL")
    fresh = d.join(sources.select("domain"), "domain", "left_anti")
    return fresh.groupBy("domain").agg(F.min(item).alias(item))


def promote_verified(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Verified finds become sources unless their domain is one: site root, two-letter language, English by default."""
    new = found.filter("status = 'verified'").groupBy("domain").agg(F.min("root").alias("root"), F.min("lang").alias("lang"))
    new = new.join(sources.select("domain"), "domain", "left_anti")
    language = F.coalesce(F.nullif(F.left(F.lower("lang"), F.lit(2)), F.lit("")), F.lit("en"))
    return sources.select("domain", "root", "lang").unionByName(new.select("domain", "root", language.alias("lang")))


def sync_registry(registry: DataFrame, current: DataFrame, legacy: DataFrame) -> DataFrame:
    """Registry of entities from current documents and legacy ones not among them; an old Latin name is kept."""
    files = current.select("entity", "name", "latin").unionByName(legacy.join(current.select("entity"), "entity", "left_anti").select("entity", "name", "latin"))
    f = files.select("entity", F.col("name").alias("_name"), F.col("latin").alias("_latin"))
    j = registry.join(f, "entity", "full")
    return j.select("entity", F.coalesce("_name", "name").alias("name"), F.coalesce(F.nullif("_latin", F.lit("")), "latin").alias("latin"))


def unique_ids(records: DataFrame, record: str, item: str, taken: DataFrame) -> DataFrame:
    """Record ids with a suffix where the id is taken already."""
    t = taken.select(F.col(record), F.lit(True).alias("_taken")).distinct()
    suffix = F.concat(F.col(record).cast("string"), F.lit("_s"), F.col(item).cast("string"))
    return records.join(t, record, "left").select(item, F.when(F.col("_taken"), suffix).otherwise(F.col(record).cast("string")).alias("id"))


def convert_archive(rows: DataFrame, record: str, steps: Column, required: Sequence[str]) -> DataFrame:
    """Old records in the current form: steps split and numbered, incomplete rows dropped."""
    parts = F.filter(F.transform(F.split(steps, r"\n+|(?<=[.!?])\s+(?=[A-ZĄĆĘŁŃÓŚŹŻ])"), lambda s: F.trim(F.regexp_replace(s, r"(?i)^(krok\s*\d+[:.)]\s*|\d+[.)]\s*)", ""))), lambda s: s != "")
    numbered = F.transform(parts, lambda s, i: F.concat(F.lit("Krok "), (i + 1).cast("string"), F.lit(": "), s))
    out = rows.withColumn("steps", numbered)
    for c in required:
        out = out.filter(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return out.filter(F.size("steps") > 0)


def row_hash(*columns: str) -> Column:
    return short_sha(F.to_json(F.struct(*columns)))
