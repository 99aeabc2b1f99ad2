"""Unions, deduplication and merges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .primitives import keep_last

__all__ = ["content_dedup", "keep_last", "mentions", "replace_segments", "unexpired", "union_frames"]


def union_frames(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def content_dedup(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each content: smallest key, hash, number of copies. Only hashes are shuffled."""
    h = df.where(F.col(text).isNotNull()).select(key, F.sha2(F.col(text).cast("binary"), 256).alias("hash"))
    return h.groupBy("hash").agg(F.min(key).alias(key), F.count("*").alias("copies"))


def unexpired(df: DataFrame, ts: str, ttl: str, now: float) -> DataFrame:
    return df.where(F.col(ts) + F.col(ttl) > now)


def replace_segments(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """New segments, and old ones of owners that are not replaced."""
    return old.join(new.select(owner).distinct(), owner, "left_anti").select(*old.columns).unionByName(new)


def mentions(texts: DataFrame, text: str, registered: DataFrame, key: str, pattern: str) -> DataFrame:
    """Ids found in texts but not registered, and registered ids that no text has."""
    found = texts.select(F.explode(F.regexp_extract_all(text, F.lit(pattern), 0)).alias(key)).distinct()
    known = registered.select(key).distinct()
    return found.join(known, key, "left_anti").withColumn("status", F.lit("unregistered")).union(known.join(found, key, "left_anti").withColumn("status", F.lit("unmentioned")))
