"""Structured Streaming twins of the stateful operators.

Late rows: a watermark of one day by default; counters are idempotent, so replays are safe.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from florilege.functions.text import paragraphs, text_hash
from florilege.sources.stores import refresh_pages


def run_batch(stream: DataFrame, fold: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now and stop."""
    query = stream.writeStream.outputMode(mode).foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def run_to_table(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Append a stream to a folder until what is there now is read, and read it back."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(folder)


class VersionedTable:
    """A parquet table that a stream replaces version by version, in a folder that outlives the process.

    A version is there once Spark has marked it as whole; the newest one before the running batch is read, so a
    replayed batch starts from the same state and writes the same version again. Rows are dealt to ``parts``
    buckets by key, and a batch writes only the buckets it touches; a bucket's newest version counts.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], parts: int = 16):
        self.spark, self.folder, self.schema, self.keys, self.parts = spark, folder, schema, keys, parts

    def _versions(self) -> list[int]:
        """Committed versions in order; only names are listed, never rows."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        whole = [s.getPath() for s in files.listStatus(path) if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in whole if p.getName().startswith("version="))

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def read(self, before: int | None = None) -> DataFrame:
        """The rows as of the newest version, or of the newest one before a batch."""
        versions = [v for v in self._versions() if before is None or v < before]
        empty = self.spark.createDataFrame([], self.schema)
        if not versions:
            return empty
        paths = [f"{self.folder}/version={v}" for v in versions]
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in empty.schema)
        rows = self.spark.read.option("basePath", self.folder).schema(f"{fields}, version int, _bucket int").parquet(*paths)
        newest = rows.groupBy("_bucket").agg(F.max("version").alias("version"))  # one row a bucket
        return rows.join(F.broadcast(newest), ["_bucket", "version"]).select(*empty.columns)

    def write(self, rows: DataFrame, batch: int) -> None:
        """Replace the buckets of ``rows``, which holds them whole, as version ``batch``."""
        rows.withColumn("_bucket", self.bucket()).write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.folder}/version={batch}")

    def touched(self, rows: DataFrame, batch: int) -> DataFrame:
        """The stored rows of the buckets that ``rows`` falls in."""
        hit = F.broadcast(rows.select(self.bucket().alias("_b")).distinct())  # at most ``parts`` rows
        stored = self.read(batch)
        return stored.join(hit, self.bucket() == F.col("_b"), "left_semi")


def counter_upsert(feed: DataFrame, table: VersionedTable, order: str, checkpoint: str) -> DataFrame:
    """Counter feed folded into the counter table; per key the value of the highest order wins, whenever it arrives."""

    def fold(rows: DataFrame, batch: int) -> None:
        n = F.expr("try_cast(n AS BIGINT)").alias("n")
        good = rows.select("day", "kind", "key", n, order).filter("day IS NOT NULL AND kind IS NOT NULL AND n IS NOT NULL")
        both = table.touched(good, batch).unionByName(good)
        table.write(both.groupBy("day", "kind", "key").agg(F.max_by("n", order).alias("n"), F.max(order).alias(order)), batch)

    run_batch(feed, fold, checkpoint)
    return table.read().select("day", "kind", "key", "n")


def new_paragraph_stream(pages: DataFrame, keys: list[str], text: str, at: str, delay: str = "1 day") -> DataFrame:
    """Paragraphs of a page that were not read within the watermark."""
    each = pages.withWatermark(at, delay).select(*keys, at, F.explode(paragraphs(F.col(text))).alias("paragraph"))
    return each.withColumn("hash", text_hash(F.col("paragraph"))).dropDuplicatesWithinWatermark([*keys, "hash"])


def stall_stream(beats: DataFrame, job: str, at: str, minutes: int, delay: str = "1 minute") -> DataFrame:
    """One event per silence: a job without a sign of life for the limit, by event time."""

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get[0]
            state.remove()
            yield pd.DataFrame({"job": [key[0]], "last_ms": [last]})
            return
        newest = max(int(b["ms"].max()) for b in batches)
        last = max(newest, state.get[0]) if state.exists else newest
        state.update((last,))
        state.setTimeoutTimestamp(max(last + minutes * 60_000, state.getCurrentWatermarkMs() + 1))

    rows = beats.withWatermark(at, delay).select(F.col(job).alias("job"), F.col(at), F.unix_millis(at).alias("ms"))
    return rows.groupBy("job").applyInPandasWithState(watch, "job long, last_ms long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def daily_usage_stream(calls: DataFrame, at: str, purpose: str, tokens: Column, budget: int, delay: str = "1 day") -> DataFrame:
    """Tokens per purpose and day with the over-budget flag."""
    day = F.window(at, "1 day")
    n = calls.withWatermark(at, delay).groupBy(day.alias("w"), F.col(purpose).alias("purpose")).agg(F.sum(tokens).alias("tokens"))
    return n.select(F.to_date("w.start").alias("day"), "purpose", "tokens", (F.col("tokens") >= budget).alias("over_budget"))


def outage_stream(failures: DataFrame, at: str, provider: str, model: str, seconds: int, models: int, delay: str = "1 hour") -> DataFrame:
    """Failures of a provider at which ``models`` different models had failed within ``seconds``, counted exactly.

    State per provider: the failures of the last ``seconds`` and those that the watermark has not passed. A failure
    is judged once the watermark is past it, so that late ones before it are counted; the end of a finished feed
    is judged when a later row or the next run moves the watermark on.
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        judged, times, names = state.get if state.exists else (-(1 << 62), [], [])
        rows = list(zip(times, names))
        if not state.hasTimedOut:
            for b in batches:
                rows += list(zip(b["ms"].astype("int64"), b["model"]))
        rows.sort()
        ready = state.getCurrentWatermarkMs()
        out, recent = [], {}
        start = 0
        for i, (ms, name) in enumerate(rows):
            recent[name] = recent.get(name, 0) + 1
            while rows[start][0] < ms - 1000 * seconds:
                old = rows[start][1]
                recent[old] -= 1
                if not recent[old]:
                    del recent[old]
                start += 1
            last_of_time = i + 1 == len(rows) or rows[i + 1][0] > ms
            if last_of_time and judged < ms <= ready and len(recent) >= models:
                out.append((key[0], int(ms), len(recent)))
        kept = [(int(ms), name) for ms, name in rows if ms > ready - 1000 * seconds]
        state.update((max(judged, ready), [ms for ms, _ in kept], [name for _, name in kept]))
        waiting = [ms for ms, _ in kept if ms > ready]
        if waiting:
            state.setTimeoutTimestamp(max(min(waiting), ready + 1))
        yield pd.DataFrame(out, columns=["provider", "ms", "models"])

    rows = failures.withWatermark(at, delay).select(F.col(provider).alias("provider"), F.col(model).alias("model"), F.col(at), F.unix_millis(at).alias("ms"))
    return rows.groupBy("provider").applyInPandasWithState(
        judge, "provider long, ms long, models int", "judged long, times array<long>, names array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


def page_ingest(pages: DataFrame, table: VersionedTable, url: str, at: str, columns: list[str], checkpoint: str, delay: str = "1 day") -> DataFrame:
    """Pages of a stream: an address once per watermark, stored pages refreshed by the rules of the page table."""
    once = pages.withWatermark(at, delay).dropDuplicatesWithinWatermark([url])
    run_batch(once, lambda rows, batch: table.write(refresh_pages(table.touched(rows, batch), rows, url, columns), batch), checkpoint)
    return table.read()


def event_rows(jobs: DataFrame, runs: DataFrame, job_cursor: int, run_cursor: int, kinds: list[str]) -> DataFrame:
    """Finished jobs and runs past the cursors as events with an id that repeats when they are read again."""
    done = jobs.filter((F.col("id") > job_cursor) & (F.col("status") == "done") & F.col("kind").isin(*kinds))
    a = done.select(F.concat(F.lit("job:"), F.col("id").cast("string")).alias("event"), "at", F.col("kind").alias("text"))
    b = runs.filter((F.col("id") > run_cursor) & (F.col("status") == "done")).select(F.concat(F.lit("run:"), F.col("id").cast("string")).alias("event"), "at", F.col("kind").alias("text"))
    return a.unionByName(b)


def event_feed(jobs: DataFrame, runs: DataFrame, job_cursor: int, run_cursor: int, kinds: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """New feed events past two cursors with an idempotent id, and the next cursors.

    The job cursor stays before the oldest job still active, so that nothing is passed over.
    """
    events = event_rows(jobs, runs, job_cursor, run_cursor, kinds).orderBy(F.desc("at"), "event").limit(limit)
    active = jobs.filter(F.col("status").isin("queued", "running")).agg(F.min("id").alias("_active"))
    top = jobs.agg(F.max("id").alias("_top")).crossJoin(active)  # one row each
    next_job = F.greatest(F.lit(job_cursor), F.least(F.col("_top"), F.coalesce(F.col("_active") - 1, F.col("_top"))))
    cursors = top.crossJoin(runs.agg(F.max("id").alias("_run"))).select(next_job.alias("job_cursor"), F.greatest(F.lit(run_cursor), F.col("_run")).alias("run_cursor"))
    return events, cursors


def event_feed_stream(events: DataFrame, at: str, delay: str = "1 day") -> DataFrame:
    """A feed in which an event id comes once."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(["event"])
