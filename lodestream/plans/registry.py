"""Every registered query: a name, a function of (spark, sf_dir), and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; time columns become TIMESTAMP (session time zone UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as ticks: (symbol, ts, event_id, user_id, price)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), "ts", "event_id", "user_id", F.col("value").alias("price"))


MODULES = ("cleaning", "timing", "joining", "summing", "rolling", "ranking", "statistics", "series", "fields", "contrasts", "panels", "modelling", "streams", "ledgers", "scans")
for _m in MODULES:
    import_module(f"lodestream.plans.{_m}")
