"""Stand-in rows: the given tables read as work items, counters, facts, posts and logs.

Each stand-in is a list of SQL expressions over one table, valid in Spark SQL and in ANSI SQL alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

NOW = "2024-01-31 00:00:00"  # fixed value: the end of the given event stream

STANDINS: dict[str, tuple[str, list[str]]] = {
    # counters per day, kind and key
    "counter_feed": (
        "events",
        [
            "CAST(CAST(ts AS DATE) AS STRING) AS day",
            "event_type AS kind",
            "CASE WHEN event_type = 'click' THEN concat('c', CAST(user_id AS STRING), ':', substring(CAST(user_id + 100 AS STRING), 3, 1)) ELSE concat('c', CAST(user_id AS STRING)) END AS key",
            "CAST(floor(value) AS BIGINT) AS n",
            "event_id AS seq",
        ],
    ),
    # statements about entities with a status
    "facts": (
        "events",
        [
            "event_id AS fact_id",
            "user_id AS entity",
            "CASE event_type WHEN 'view' THEN 'new' WHEN 'click' THEN 'verified' WHEN 'purchase' THEN 'applied' WHEN 'error' THEN 'rejected' ELSE 'new' END AS status",
            "CASE user_id % 5 WHEN 0 THEN 'pl' WHEN 1 THEN 'en' WHEN 2 THEN 'de' WHEN 3 THEN 'zh' ELSE 'ja' END AS lang",
            "concat('sec', CAST(event_id % 7 AS STRING)) AS section",
            "value",
            "ts AS created_at",
        ],
    ),
    # search log
    "query_log": (
        "events",
        [
            "event_id AS query_id",
            "user_id AS entity",
            "concat('slot', CAST(user_id % 3 AS STRING), event_type) AS slot",
            "concat('base', CAST(user_id % 20 AS STRING)) AS provider",
            "CASE WHEN value > 60 THEN concat('http://q', CAST(user_id AS STRING), '.example.com/', event_type) ELSE '' END AS used_url",
            "CAST(floor(value / 90) AS BIGINT) AS facts",
            "ts AS created_at",
        ],
    ),
    # runs of jobs with an outcome
    "runs": (
        "events",
        [
            "event_id AS run_id",
            "user_id AS job",
            "event_type AS kind",
            "CASE WHEN value < 12 THEN 'failed' WHEN event_type = 'error' THEN 'blocked' ELSE 'done' END AS status",
            "CASE WHEN value < 12 THEN concat('E', CAST(floor(value / 6) AS STRING)) ELSE NULL END AS signature",
            "CAST(floor(value / 20) AS BIGINT) AS yielded",
            "value",
            "ts AS at",
        ],
    ),
    # calls of a service: purpose, tokens, success
    "calls": (
        "events",
        [
            "event_id AS call_id",
            "event_type AS purpose",
            "concat('m', CAST(user_id % 12 AS STRING)) AS model",
            "user_id % 3 = 0 AS local",
            "value >= 8 AS ok",
            "value AS latency",
            "CAST(100 - user_id % 12 * 5 AS DOUBLE) AS base",
            "CAST(floor(value * 10) AS BIGINT) AS tokens",
            "CAST(CAST(ts AS DATE) AS STRING) AS day",
            "ts AS called_at",
        ],
    ),
    # posts with scores
    "posts": (
        "orders",
        [
            "o_orderkey AS post_id",
            "o_custkey AS author",
            "o_orderpriority AS kind",
            "CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'O' THEN 'draft' ELSE 'rejected' END AS status",
            "CAST(floor(o_totalprice / 100) % 101 AS DOUBLE) AS overall",
            "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(floor(o_totalprice / 37) % 101 AS DOUBLE) END AS expert",
            "CAST(floor(o_totalprice / 53) % 101 AS DOUBLE) AS code",
            "concat('r', CAST(o_custkey % 11 AS STRING)) AS reviewer",
            "CAST(o_orderdate AS DATE) AS day",
        ],
    ),
    # predictions of a model: class, truth, confidence; two thirds have a known answer
    "decisions": (
        "documents",
        [
            "doc_id AS ref",
            "source",
            "lang AS label",
            "CASE WHEN (doc_id * 7919) % 100 < 12 THEN 'en' WHEN (doc_id * 104729) % 50 < 4 THEN 'de' ELSE lang END AS predicted",
            "CAST((n_chars * 31 + doc_id * 17) % 1000 AS DOUBLE) / 1000 AS confidence",
            "concat('task', CAST(doc_id % 3 AS STRING)) AS task",
            "CASE WHEN doc_id % 10 < 5 THEN 'accept' WHEN doc_id % 10 < 7 THEN 'audit' ELSE 'defer' END AS decision",
            "doc_id % 10 <> 9 AS known",
        ],
    ),
}


def standin(tables, name: str) -> DataFrame:
    """The rows of a stand-in as a DataFrame."""
    table, exprs = STANDINS[name]
    return getattr(tables, table).selectExpr(*exprs)


def cte(*names: str) -> str:
    """A WITH clause that states the same stand-ins in SQL."""
    parts = []
    for name in names:
        table, exprs = STANDINS[name]
        parts.append(f"{name} AS (SELECT {', '.join(exprs)} FROM {table})")
    return "WITH " + ",\n".join(parts)
