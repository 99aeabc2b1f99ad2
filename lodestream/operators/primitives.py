"""Building blocks: grids, fills, as-of joins by union, islands, positions, global ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(ts: Column | str, seconds: int, closed: str = "left") -> Column:
    """Begin of the bucket of ``seconds`` that holds a time; with closed="right" a bound belongs to the bucket it ends."""
    t = F.col(ts) if isinstance(ts, str) else ts
    micros = F.unix_micros(t)
    width = seconds * 1_000_000
    if closed == "right":
        return F.timestamp_micros((F.ceil(micros / F.lit(width)) - 1) * width)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(width)))


def grid(df: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """Every bucket between the first and the last one of each key."""
    g = df.groupBy(*keys).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    return g.select(*keys, F.explode(F.expr(f"sequence(lo, hi, interval {seconds} seconds)")).alias(ts))


def fill_forward(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def fill_backward(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    # from the end on: a frame that ends with the key is read anew for each row
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def asof(left: DataFrame, right: DataFrame, keys: list[str], ts: str, right_ts: str, cols: list[str], direction: str = "backward") -> DataFrame:
    """For each left row the last right row at or before its time (or the first at or after), in one shuffle.

    Both sides are put under each other and a window carries the right row along; no range join is made.
    """
    back = direction == "backward"
    payload = F.struct(F.col(right_ts).alias("at"), *[F.col(c) for c in cols])
    a = left.select(*keys, F.struct(*left.columns).alias("row"), F.col(ts).alias("t"), F.lit(1 if back else 0).alias("side"), F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("p"))
    b = right.select(*keys, F.lit(None).cast(a.schema["row"].dataType).alias("row"), F.col(right_ts).alias("t"), F.lit(0 if back else 1).alias("side"), payload.alias("p"))
    order = [F.col(c) if back else F.desc(c) for c in ("t", "side", "p.at")]  # forward: from the end on, for the same frame
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = a.union(b).withColumn("m", F.last("p", ignorenulls=True).over(frame)).where("row IS NOT NULL")
    return out.select("row.*", F.col("m.at").alias(f"{right_ts}_matched"), *[F.col(f"m.{c}").alias(c) for c in cols])


def asof_sliced(left: DataFrame, right: DataFrame, keys: list[str], ts: str, right_ts: str, cols: list[str], seconds: int) -> DataFrame:
    """Backward as-of join for keys that hold very many rows: both sides are cut into slices of time.

    Each slice gets, beside its own right rows, the last right row before it; only one row a slice is looked at to find
    that, so neither side of a key meets in one task.
    """
    a = left.withColumn("_slice", bucket(ts, seconds))
    b = right.select(*keys, right_ts, *cols).withColumn("_slice", bucket(right_ts, seconds))
    last = b.groupBy(*keys, "_slice").agg(F.max_by(F.struct(right_ts, *cols), right_ts).alias("_last"))
    every = a.select(*keys, "_slice").distinct().join(last, [*keys, "_slice"], "full")
    w = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    opening = every.withColumn("_open", F.last("_last", ignorenulls=True).over(w)).where("_open IS NOT NULL").select(*keys, "_slice", "_open.*")
    both = b.unionByName(opening)
    return asof(a, both, [*keys, "_slice"], ts, right_ts, cols).drop("_slice")


def islands(df: DataFrame, keys: list[str], order: list[str], changed: Column, name: str = "island") -> DataFrame:
    """Number the runs of rows: a new one begins where ``changed`` holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.coalesce(changed, F.lit(False)).cast("long")).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the last by ``order``."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("r")).select(*keys, "r.*")


def global_position(df: DataFrame, order: list[str], name: str = "pos", slices: int | None = None) -> DataFrame:
    """0-based position in the order of all rows, without a window over all rows in one task.

    Rows are dealt by range, numbered inside their slice, and slices are offset by the counts before them.  The dealt
    rows are written once: bounds of ranges are sampled, and a second run would sample others.
    """
    from lodestream.sources.files import work_path

    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(n, *order).withColumn("_slice", F.spark_partition_id())
    path = work_path(df.sparkSession, "slices")
    d.write.parquet(path)
    d = df.sparkSession.read.schema(d.schema).parquet(path)
    w = Window.partitionBy("_slice").orderBy(*order)
    d = d.withColumn("_nth", F.row_number().over(w) - 1)
    sizes = d.groupBy("_slice").agg(F.count("*").alias("_n"))  # one number for each slice
    before = sizes.select("_slice", (F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("_slice")) - F.col("_n")).alias("_before"))
    return d.join(F.broadcast(before), "_slice").withColumn(name, F.col("_nth") + F.col("_before")).drop("_slice", "_nth", "_before")
