"""File sources and sinks. Paths are Spark paths; nothing is read or written outside Spark."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_OWN: dict[str, str] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` (an own temporary folder only where the session names none)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        base = _OWN.setdefault(app, "file://" + tempfile.mkdtemp(prefix="spark-lodestream-"))
    return f"{base.rstrip('/')}/lodestream/{name}-{uuid.uuid4().hex}"


def with_checkpoints(spark: SparkSession) -> None:
    """Let ``checkpoint()`` write below a folder of our own where the session names none."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_path(spark, "checkpoints"))


def read_tick_csv(spark: SparkSession, path: str, schema: StructType | str, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Good rows by an explicit schema, and the raw text of rows that do not fit it or miss a required value."""
    s = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    full = StructType([*s.fields]).add("_corrupt", "string")
    df = spark.read.schema(full).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").csv(path)
    missing = F.lit(False)
    for c in required:
        missing |= F.col(c).isNull()
    bad = F.col("_corrupt").isNotNull() | missing
    return df.where(~bad).drop("_corrupt"), df.where(bad)


def read_columns(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*cols)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_sessions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One folder for each session; sessions whose status is OK, with the folder's name.

    The folders are looked up by tasks, as a pattern in the path has the driver list one after the other.
    """
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/session=([^/]+)/[^/]+$", 1)
    return df.withColumn("session", name).where("status = 'OK' AND session <> ''")


def read_economic_csv(spark: SparkSession, path: str) -> DataFrame:
    """Two columns (date, value) in which a dot stands for a missing value."""
    return spark.read.schema("date date, value double").option("header", True).option("nullValue", ".").csv(path)


def candle_closes(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, open_time, close) from JSON arrays of candles."""
    x = df.select(key, F.explode(F.from_json(col, "array<array<string>>")).alias("c"))
    return x.select(key, F.col("c")[0].cast("long").alias("open_time"), F.col("c")[4].cast("double").alias("close"))


def epoch_to_timestamp(c: str):
    """Epoch seconds, milli-, micro- or nanoseconds, told apart by size, as microseconds since 1970."""
    v = F.abs(c)
    return F.when(v >= 10**18, F.floor(F.col(c) / 1000)).when(v >= 10**15, F.col(c)).when(v >= 10**12, F.col(c) * 1000).otherwise(F.col(c) * 1_000_000).cast("long")


def contract_errors(df: DataFrame, keys: list[str], ts: str, tie: str, positive: list[str], not_null: list[str], ohlc: tuple[str, str, str, str] | None = None) -> DataFrame:
    """One row for each broken rule: time not increasing, sign, null, low/high order."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(tie)
    rules = [F.when(F.col(ts) < F.lag(ts).over(w), "time")]
    rules += [F.when(F.col(c) <= 0, f"sign:{c}") for c in positive] + [F.when(F.col(c).isNull(), f"null:{c}") for c in not_null]
    if ohlc:
        o, h, lo, c = ohlc
        rules.append(F.when((F.col(lo) > F.least(o, c)) | (F.col(h) < F.greatest(o, c)), "ohlc"))
    found = df.withColumn("errors", F.array_compact(F.array(*rules)))
    return found.select(*keys, tie, F.explode("errors").alias("error"))


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    df.repartition(*by).write.partitionBy(*by).mode("append").parquet(path)


def batch_notice(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count("*").alias("n"))


def row_hash(cols: list[str]):
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols]), 256)


def fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """Order-free digest of a table: number of rows, and sums of the hash's first digits, which any partitioning gives alike."""
    h = row_hash(cols)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    return df.agg(F.count("*").alias("n"), part(0).cast("string").alias("a"), part(1).cast("string").alias("b"))


def merkle_root(df: DataFrame, group: str, path: str, digest: str) -> DataFrame:
    line = F.concat(F.col(path).cast("string"), F.lit(":"), digest)
    return df.groupBy(group).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("root"))


def latest_versions(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    from lodestream.operators.primitives import keep_last

    return keep_last(df, keys, [version])


def retention_tier(age, hot: int, warm: int, cold: int):
    return F.when(age <= hot, "hot").when(age <= warm, "warm").when(age <= cold, "cold").otherwise("drop")


def publish_json(df: DataFrame, path: str, key: str) -> None:
    """Messages (key, value) as a broker takes them, into a file sink."""
    df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*sorted(df.columns))).alias("value")).write.json(path)
