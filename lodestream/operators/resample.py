"""Resampling of ticks and bars, gaps, and series of mixed frequency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .primitives import bucket, fill_backward, fill_forward, grid, keep_last


def ticks_to_last(ticks: DataFrame, seconds: int, keys: list[str], ts: str, tie: str, cols: list[str]) -> DataFrame:
    """Last value of each column in each bucket; empty buckets carry the value before."""
    t = ticks.withColumn("bucket", bucket(ts, seconds))
    last = t.groupBy(*keys, "bucket").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(ts, tie))).alias(c) for c in cols])
    full = grid(last, keys, "bucket", seconds).join(last, [*keys, "bucket"], "left")
    return fill_forward(full, keys, ["bucket"], cols)


def bars(ticks: DataFrame, seconds: int, keys: list[str], ts: str, tie: str, price: str, size: str | None = None, closed: str = "left") -> DataFrame:
    """Open, high, low, close, volume and count; volume is NULL where no row has a size; no empty bars."""
    o = F.struct(ts, tie)
    volume = F.sum(size) if size else F.lit(None).cast("double")
    t = ticks.where(F.col(price).isNotNull()).withColumn("bucket", bucket(ts, seconds, closed))
    return t.groupBy(*keys, "bucket").agg(F.min_by(price, o).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, o).alias("close"), volume.alias("volume"), F.count("*").alias("n"))


def coarser_bars(b: DataFrame, seconds: int, keys: list[str], label: str = "left", closed: str = "left") -> DataFrame:
    """Bars of a longer bucket from bars; label="right" names a bar by its end."""
    c = b.withColumn("wide", bucket("bucket", seconds, closed))
    g = c.groupBy(*keys, "wide").agg(F.min_by("open", "bucket").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bucket").alias("close"), F.sum("volume").alias("volume"), F.sum("n").alias("n"))
    end = F.timestamp_micros(F.unix_micros("wide") + seconds * 1_000_000)
    return g.withColumn("bucket", end if label == "right" else F.col("wide")).drop("wide")


def interpolate(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    """Linear by row position; leading and trailing NULLs take the nearest value."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = df.withColumn("_i", F.row_number().over(w))
    up, down = (x.rowsBetween(Window.unboundedPreceding, 0) for x in (w, Window.partitionBy(*keys).orderBy(F.desc("_i"))))  # a frame that ends with the key is read anew for each row
    for c in cols:
        at = F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).alias("v")))
        a, b = F.last(at, ignorenulls=True).over(up), F.last(at, ignorenulls=True).over(down)
        d = d.withColumn("_a", a).withColumn("_b", b)
        between = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_i") - F.col("_a.i")) / (F.col("_b.i") - F.col("_a.i"))
        d = d.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c)).when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull(), F.col("_a.v")).otherwise(between))
    return d.drop("_i", "_a", "_b")


def gaps(existing: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """[start, end) ranges of grid buckets that are missing, with their number of buckets."""
    have = existing.select(*keys, ts).distinct()
    missing = grid(have, keys, ts, seconds).join(have, [*keys, ts], "left_anti")
    w = Window.partitionBy(*keys).orderBy(ts)
    m = missing.withColumn("run", F.unix_seconds(ts) - F.row_number().over(w) * seconds)
    g = m.groupBy(*keys, "run").agg(F.min(ts).alias("start"), F.max(ts).alias("last"), F.count("*").alias("buckets"))
    return g.select(*keys, "start", F.timestamp_micros(F.unix_micros("last") + seconds * 1_000_000).alias("end"), "buckets")


def backfill(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which the fresh row of a key wins."""
    return keep_last(existing.withColumn("_p", F.lit(0)).unionByName(fresh.withColumn("_p", F.lit(1))), keys, ["_p"]).drop("_p")


def order_book(levels: DataFrame, seconds: int, keys: list[str], ts: str, bids: list[str], asks: list[str]) -> DataFrame:
    """Mean sizes, imbalance and microprice-like weight of each bucket; filled forward, backward, then 0."""
    g = levels.groupBy(*keys, bucket(ts, seconds).alias("bucket")).agg(*[F.avg(c).alias(c) for c in [*bids, *asks]])
    g = grid(g, keys, "bucket", seconds).join(g, [*keys, "bucket"], "left")
    bid, ask = sum((F.col(c) for c in bids), F.lit(0.0)), sum((F.col(c) for c in asks), F.lit(0.0))
    g = g.withColumn("imbalance", F.coalesce((bid - ask) / F.nullif(bid + ask, F.lit(0.0)), F.lit(0.0)))
    g = g.withColumn("micro", (F.col(bids[0]) * ask + F.col(asks[0]) * bid) / F.nullif(bid + ask, F.lit(0.0)))
    g = fill_backward(fill_forward(g, keys, ["bucket"], ["micro"]), keys, ["bucket"], ["micro"])
    return g.withColumn("micro", F.coalesce("micro", F.lit(0.0)))


def monthly_last(series: DataFrame, keys: list[str], ts: str, value: str, lag_days: int) -> DataFrame:
    """Last value of each month, missing months carried forward, available ``lag_days`` after the month's end."""
    m = series.withColumn("month", F.trunc(ts, "month"))
    last = m.groupBy(*keys, "month").agg(F.max_by(value, F.struct(ts, value)).alias(value))
    span = last.groupBy(*keys).agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    full = span.select(*keys, F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("month")).join(last, [*keys, "month"], "left")
    full = fill_forward(full, keys, ["month"], [value])
    return full.select(*keys, F.last_day("month").alias("period_end"), value, F.date_add(F.last_day("month"), lag_days).alias("available_at"))


def merge_streams(history: DataFrame, live: DataFrame, keys: list[str], start, end, ts: str) -> DataFrame:
    """History and live ticks within bounds; live wins on equal keys."""
    d = history.withColumn("_p", F.lit(0)).unionByName(live.withColumn("_p", F.lit(1)))
    d = d.where((F.col(ts) >= F.lit(start).cast("timestamp")) & (F.col(ts) < F.lit(end).cast("timestamp")))
    return keep_last(d, keys, ["_p"]).withColumnRenamed("_p", "live")


def uniform_grid(series: DataFrame, keys: list[str], ts: str, value: str, seconds: int) -> DataFrame:
    """Values on an even grid by linear interpolation in time between the readings around each grid point."""
    g = grid(series.withColumn("g", bucket(ts, seconds)), keys, "g", seconds).select(*keys, F.col("g").alias("t"), F.lit(None).cast("double").alias("v"))
    r = series.groupBy(*keys, F.col(ts).alias("t")).agg(F.avg(value).alias("v"))
    both = r.withColumn("is_grid", F.lit(False)).unionByName(g.withColumn("is_grid", F.lit(True)))
    up, down = (Window.partitionBy(*keys).orderBy(*o).rowsBetween(Window.unboundedPreceding, 0) for o in (["t", "is_grid"], [F.desc("t"), F.desc("is_grid")]))
    at = F.when(F.col("v").isNotNull(), F.struct(F.unix_micros("t").alias("t"), "v"))
    both = both.withColumn("a", F.last(at, ignorenulls=True).over(up)).withColumn("b", F.last(at, ignorenulls=True).over(down))
    x = F.unix_micros("t")
    out = F.when(F.col("a").isNull() | F.col("b").isNull(), None).when(F.col("a.t") == x, F.col("a.v")).otherwise(F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (x - F.col("a.t")) / (F.col("b.t") - F.col("a.t")))
    return both.where("is_grid").select(*keys, F.col("t").alias(ts), out.alias(value)).where(F.col(value).isNotNull())
