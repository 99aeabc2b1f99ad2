"""Structured Streaming jobs over files; each drains what is there (availableNow) and ends."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lodestream.sources.files import work_path


def feed(df: DataFrame, by: str, files: int | None = None, batches: int = 2) -> DataFrame:
    """A stream of the rows of ``df`` in the order of ``by``, rows without it first, in so many ``batches``.

    One job writes the rows, dealt by range; the times of the files are then set in the order of the ranges, which is the
    order in which a file stream reads them.
    """
    spark = df.sparkSession
    path = work_path(spark, "feed")
    n = files or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartitionByRange(n, by).write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(f.getPath().toString() for f in fs.listStatus(where) if f.getPath().getName().startswith("part-"))
    for i, part in enumerate(parts):
        fs.setTimes(spark._jvm.org.apache.hadoop.fs.Path(part), 1_000_000_000_000 + 1000 * i, -1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-len(parts) // batches))).parquet(path)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def drain(stream: DataFrame, mode: str = "append", provider: str | None = None) -> DataFrame:
    """Run a stream to its end into files, and read them; ``provider`` names the state store of this stream alone.

    In update mode a batch's rows are written under its number, so a batch that runs again replaces what it wrote.
    """
    spark = stream.sparkSession
    out, marks = work_path(spark, "drained"), work_path(spark, "marks")
    before = spark.conf.get(PROVIDER, None)
    if provider:
        spark.conf.set(PROVIDER, provider)
    try:
        write = stream.writeStream
        if mode == "update":
            write = write.foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"))
        else:
            write = write.format("parquet").option("path", out)
        write.option("checkpointLocation", marks).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    finally:
        if provider:
            spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)
    return spark.read.schema(StructType([*stream.schema]).add("batch", "long") if mode == "update" else stream.schema).parquet(out)


def materialise(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep-last within a batch, only keys not stored yet, each batch written once under its number."""
    spark = stream.sparkSession
    out, marks = work_path(spark, "view"), work_path(spark, "marks")

    def store(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        others = [c for c in batch.columns if c not in keys]
        last = batch.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")).select(*keys, "r.*").select(*batch.columns)
        if number:
            # what earlier batches stored; a batch that is run again does not see itself
            old = s.read.parquet(out).where(F.col("batch") < number)
            last = last.join(old.select(*keys), keys, "left_anti").select(*batch.columns)
        last.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(store).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


def sliding_mean(stream: DataFrame, keys: list[str], ts: str, value: str, width: str, step: str, late: str) -> DataFrame:
    g = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, width, step).alias("w")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean", "n")


def sessions(stream: DataFrame, keys: list[str], ts: str, gap: str, late: str) -> DataFrame:
    g = stream.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_each(stream: DataFrame, keys: list[str], ts: str, late: str) -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def lag_by_source(df: DataFrame, source: str, event: str, arrival: str) -> DataFrame:
    return df.groupBy(source).agg(F.count("*").alias("n"), F.avg(F.unix_micros(arrival) - F.unix_micros(event)).alias("lag"))


def running_means(stream: DataFrame, key: str, order: list[str], value: str, alpha: float) -> DataFrame:
    """Exponentially weighted mean of each key kept as state; a row for each key and batch, the last one is current."""

    def update(k, frames, state: GroupState):
        mean, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(frames)).sort_values(order)
        for v in rows[value]:
            mean = v if mean is None else mean + alpha * (v - mean)
            n += 1
        state.update((float(mean), int(n)))
        yield pd.DataFrame({key: [k[0]], "mean": [mean], "n": [n]})

    t = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(update, f"{key} {t}, mean double, n long", "mean double, n long", "update", GroupStateTimeout.NoTimeout)


def dead_letters(df: DataFrame, key: str, payload: str, failed, toxic: int) -> DataFrame:
    """Failed payloads with their digest, number of failures and whether they are toxic."""
    return df.where(failed).groupBy(F.sha2(payload, 256).alias("digest")).agg(F.count("*").alias("failures"), F.min(key).alias("first")).withColumn("toxic", F.col("failures") >= toxic)


def book_state(diffs: DataFrame, snapshots: DataFrame, book: str, side: str, price: str, qty: str, seq: str) -> DataFrame:
    """Levels after the last snapshot and the diffs behind it; quantity 0 deletes a level."""
    last = snapshots.groupBy(book).agg(F.max(seq).alias("_s"))
    base = snapshots.join(last, book).where(F.col(seq) == F.col("_s")).drop("_s")
    d = diffs.join(last, book).where(F.col(seq) > F.col("_s")).drop("_s")
    state = base.unionByName(d).groupBy(book, side, price).agg(F.max_by(qty, F.struct(seq, qty)).alias(qty))
    return state.where(F.col(qty) > 0)


def sequence_gaps(diffs: DataFrame, book: str, seq: str) -> DataFrame:
    before = F.lag(seq).over(Window.partitionBy(book).orderBy(seq))
    return diffs.withColumn("_b", before).where(F.col(seq) > F.col("_b") + 1).select(book, (F.col("_b") + 1).alias("from"), (F.col(seq) - 1).alias("to"))


def replay(log: DataFrame, ts: str, since) -> DataFrame:
    return log.where(F.col(ts) >= F.lit(since).cast("timestamp"))

