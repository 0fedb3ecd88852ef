"""Registered streams: each runs over the rows that are there and stops."""

from __future__ import annotations

from pyspark.sql import functions as F

from florilege.plans.registry import Tables, query
from florilege.plans.standins import STANDINS, cte, standin
from florilege.session import scratch_folder
from florilege.streaming import streams as L


def stream_of(t: Tables, rows, name: str, parts: int = 4, order: str = "ts"):
    """Rows in time order, written in one job by all tasks and read back as a stream of about ``parts`` steps.

    Each range partition is a file. The source takes files by modification time, so these are set to their order,
    as if the files had come one after another; only names and times pass through the driver.
    """
    folder = scratch_folder(t.spark, name)
    files = max(parts, t.spark.sparkContext.defaultParallelism)
    rows.repartitionByRange(files, order).write.parquet(folder)
    path = t.spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(t.spark._jsc.hadoopConfiguration())
    written = sorted((s.getPath().getName(), s.getPath(), s.getModificationTime()) for s in store.listStatus(path) if s.getPath().getName().startswith("part-"))
    first = min((m for _, _, m in written), default=0) - 1000 * len(written)
    for i, (_, file, _) in enumerate(written):
        store.setTimes(file, first + 1000 * i, -1)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", -(-files // parts)).parquet(folder)


@query("stream_counter_upsert", cte("counter_feed") + " SELECT day, kind, key, arg_max(n, seq) AS n FROM counter_feed GROUP BY 1, 2, 3")
def stream_counter_upsert(t: Tables):
    feed = stream_of(t, standin(t, "counter_feed"), "feed", order="seq")
    table = L.VersionedTable(t.spark, scratch_folder(t.spark, "counters"), "day string, kind string, key string, n long, seq long", ["day", "kind", "key"])
    return L.counter_upsert(feed, table, "seq", scratch_folder(t.spark, "ck"))


def timed_documents(t: Tables):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id"))
    return t.documents.select("source", F.col("doc_id"), "text", at.alias("ts"))


@query("stream_new_paragraphs")
def stream_new_paragraphs(t: Tables):
    twice = timed_documents(t).unionByName(timed_documents(t))
    out = L.new_paragraph_stream(stream_of(t, twice, "pages"), ["source", "doc_id"], "text", "ts")
    got = L.run_to_table(out, scratch_folder(t.spark, "out"), scratch_folder(t.spark, "ck"))
    return got.groupBy("source", "doc_id").agg(F.count("*").alias("paragraphs"))


@query("stream_stall_detect")
def stream_stall_detect(t: Tables):
    beats = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = L.stall_stream(stream_of(t, beats, "beats"), "user_id", "ts", 24 * 60)
    got = L.run_to_table(out, scratch_folder(t.spark, "out"), scratch_folder(t.spark, "ck"))
    return got.select("job", F.timestamp_millis("last_ms").cast("string").alias("last_sign"))


@query(
    "stream_daily_usage",
    cte("calls") + " SELECT day, purpose, CAST(sum(tokens) AS BIGINT) AS tokens, sum(tokens) >= 50000 AS over_budget FROM calls WHERE CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(called_at) FROM calls) - INTERVAL 1 DAY GROUP BY 1, 2",
)
def stream_daily_usage(t: Tables):
    """Closed days of the stream: the last ones stay open behind the watermark."""
    calls = t.events.selectExpr(*STANDINS["calls"][1]).withColumn("ts", F.col("called_at").cast("timestamp"))
    out = L.daily_usage_stream(stream_of(t, calls, "calls"), "ts", "purpose", F.col("tokens"), 50_000)
    return L.run_to_table(out, scratch_folder(t.spark, "out"), scratch_folder(t.spark, "ck")).withColumn("day", F.col("day").cast("string"))


@query(
    "stream_outage",
    """WITH f AS (SELECT DISTINCT epoch_us(ts) // 1000 AS ms, user_id % 4 AS provider, user_id % 12 AS model FROM events WHERE value < 15), p AS (SELECT DISTINCT provider, ms FROM f),
    c AS (SELECT p.provider, p.ms, count(DISTINCT f.model) AS models FROM p JOIN f ON f.provider = p.provider AND f.ms BETWEEN p.ms - 3600000 AND p.ms GROUP BY 1, 2)
    SELECT provider, ms, CAST(models AS INT) AS models FROM c WHERE models >= 2 AND ms <= (SELECT max(ms) FROM f) - 3600000""",
)
def stream_outage(t: Tables):
    """Outages up to the watermark, which stands an hour before the last failure."""
    f = t.events.filter("value < 15").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 4).alias("provider"), (F.col("user_id") % 12).alias("model"))
    out = L.outage_stream(stream_of(t, f, "failures"), "ts", "provider", "model", 3600, 2)
    return L.run_to_table(out, scratch_folder(t.spark, "out"), scratch_folder(t.spark, "ck"))


@query("stream_page_ingest", "SELECT DISTINCT url, 'raw' AS status FROM pages")
def stream_page_ingest(t: Tables):
    pages = t.pages.select("url", F.length("html").alias("size"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")).alias("ts"))
    table = L.VersionedTable(t.spark, scratch_folder(t.spark, "stored"), "url string, status string, size int", ["url"])
    return L.page_ingest(stream_of(t, pages.unionByName(pages), "fetched"), table, "url", "ts", ["size"], scratch_folder(t.spark, "ck")).select("url", "status")


@query("stream_resume", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def stream_resume(t: Tables):
    """The same stream started twice on one checkpoint reads every row once."""
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    stream = stream_of(t, rows, "orders", order="o_orderkey")
    out, checkpoint = scratch_folder(t.spark, "out"), scratch_folder(t.spark, "ck")
    L.run_to_table(stream, out, checkpoint)
    return L.run_to_table(stream, out, checkpoint).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


FEED_SQL = """j AS (SELECT event_id AS id, CASE WHEN value > 330 AND event_id > 9000 THEN 'running' WHEN value < 5 THEN 'failed' ELSE 'done' END AS status, event_type AS kind, ts AS at_ FROM events), r AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'open' END AS status, o_orderpriority AS kind, o_orderdate + INTERVAL 9000 DAY AS at_ FROM orders)"""


def feed_tables(t: Tables):
    status = F.when((F.col("value") > 330) & (F.col("event_id") > 9000), "running").when(F.col("value") < 5, "failed").otherwise("done")
    jobs = t.events.select(F.col("event_id").alias("id"), status.alias("status"), F.col("event_type").alias("kind"), F.col("ts").alias("at"))
    runs = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("open").alias("status"), F.col("o_orderpriority").alias("kind"), (F.col("o_orderdate") + F.expr("INTERVAL 9000 DAYS")).alias("at"))
    return jobs, runs


@query(
    "stream_event_feed",
    f"""WITH {FEED_SQL}, e AS (SELECT 'job:' || id AS event, at_, kind AS text FROM j WHERE id > 500 AND status = 'done' AND kind IN ('view', 'click') UNION ALL SELECT 'run:' || id, at_, kind FROM r WHERE id > 1000 AND status = 'done') SELECT event, text FROM e ORDER BY at_ DESC, event LIMIT 30""",
)
def stream_event_feed(t: Tables):
    """Events that arrive twice are in the feed once; the newest are shown."""
    jobs, runs = feed_tables(t)
    rows = L.event_rows(jobs, runs, 500, 1000, ["view", "click"]).withColumn("at", F.col("at").cast("timestamp"))
    out = L.event_feed_stream(stream_of(t, rows.unionByName(rows), "feed", order="at"), "at")
    got = L.run_to_table(out, scratch_folder(t.spark, "out"), scratch_folder(t.spark, "ck"))
    return got.orderBy(F.desc("at"), "event").limit(30).select("event", "text")


@query("event_feed_cursors", f"WITH {FEED_SQL} SELECT greatest(500, least((SELECT max(id) FROM j), coalesce((SELECT min(id) FROM j WHERE status = 'running') - 1, (SELECT max(id) FROM j)))) AS job_cursor, greatest(1000, (SELECT max(id) FROM r)) AS run_cursor")
def event_feed_cursors(t: Tables):
    jobs, runs = feed_tables(t)
    return L.event_feed(jobs, runs, 500, 1000, ["view", "click"], 30)[1]
