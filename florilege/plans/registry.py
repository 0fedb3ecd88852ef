"""Registry of queries and of the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# tables whose rows are long texts, so that work per row outweighs a shuffle
TEXT_TABLES = ("documents", "pages", "conversations")


def spread(frame: DataFrame) -> DataFrame:
    """Rows over all cores where a table is fewer files than there are cores (a small file is one row group, which Spark
    does not split); tables of many files stay as read."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(cores) if len(frame.inputFiles()) < cores else frame


class Tables:
    """The parquet tables of one folder as attributes, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        frame = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        if name in TEXT_TABLES:
            frame = spread(frame)
        setattr(self, name, frame)
        return frame


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name`` with its SQL twin."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add
