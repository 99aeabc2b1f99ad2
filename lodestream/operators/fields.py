"""Scalar fields on grids: clusters across tiles, size distributions, phases of rows, order parameter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from lodestream.sources.files import work_path

from .lags import join_null_safe
from .panels import components


def label_tile(r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """For each cell of a tile the place of the first cell of its cluster; cells touch along sides."""
    at = {(a, b): i for i, (a, b) in enumerate(zip(r.tolist(), c.tolist(), strict=True))}
    root = list(range(len(at)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for (a, b), i in at.items():
        for other in ((a - 1, b), (a, b - 1)):
            if (j := at.get(other)) is not None:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(len(root))], np.int64)


def clusters(cells: DataFrame, keys: list[str], r: str, c: str, on: str, tile: int = 256) -> DataFrame:
    """(keys, r, c, cluster) of the cells where ``on`` holds: 4-neighbour clusters, named by a number each.

    Tiles of ``tile`` x ``tile`` cells are labelled by themselves; only cells along tile borders are joined across them, and
    the graph of tile clusters is reduced to components.  Cells repeated within a field count once.
    """
    spark = cells.sparkSession
    lit = cells.where(on).select(*keys, F.col(r).cast("long").alias("_r"), F.col(c).cast("long").alias("_c")).distinct()
    lit = lit.withColumn("_tr", F.floor(F.col("_r") / tile)).withColumn("_tc", F.floor(F.col("_c") / tile))
    kind = StructType([*cells.select(*keys).schema]).add("_r", "long").add("_c", "long").add("_hr", "long").add("_hc", "long")

    def label(t: pa.Table) -> pa.Table:
        a, b = t.column("_r").to_numpy(), t.column("_c").to_numpy()
        o = np.lexsort((b, a))
        home = o[label_tile(a[o], b[o])]
        out_r, out_c = np.empty_like(a), np.empty_like(b)
        out_r[o], out_c[o] = a[home], b[home]
        return pa.table([*(t.column(k) for k in keys), t.column("_r"), t.column("_c"), pa.array(out_r), pa.array(out_c)], kind.names)

    path = work_path(spark, "tile-clusters")
    named = lit.groupBy(*keys, "_tr", "_tc").applyInArrow(label, kind)
    # a cluster of a tile is named by its first cell
    named.withColumn("_own", F.xxhash64(*keys, *[F.col(k).isNull() for k in keys], "_hr", "_hc")).write.parquet(path)
    named = spark.read.parquet(path)
    edge = named.where((F.pmod(F.col("_r"), F.lit(tile)) == 0) | (F.pmod(F.col("_c"), F.lit(tile)) == 0))
    last = named.where((F.pmod(F.col("_r"), F.lit(tile)) == tile - 1) | (F.pmod(F.col("_c"), F.lit(tile)) == tile - 1))
    last = last.select(*keys, F.col("_own").alias("_other"), F.explode(F.array(F.struct((F.col("_r") + 1).alias("_r"), F.col("_c").alias("_c")), F.struct(F.col("_r").alias("_r"), (F.col("_c") + 1).alias("_c")))).alias("n")).select(*keys, "_other", "n.*")
    met = join_null_safe(edge.select(*keys, "_r", "_c", "_own"), last, [*keys, "_r", "_c"]).where("_own <> _other")
    joined = components(met.select(F.col("_own").alias("a"), F.col("_other").alias("b")))
    out = named.join(joined, F.col("_own") == F.col("v"), "left")
    return out.select(*keys, F.col("_r").alias(r), F.col("_c").alias(c), F.coalesce("component", "_own").alias("cluster"))


def size_law(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, clusters, exponent, r2) of cluster sizes: minus the slope of ln share on ln size over distinct sizes.

    Fewer than five clusters or three distinct sizes give zeros.
    """
    per = sizes.groupBy(*keys, "size").agg(F.count("*").alias("_n"))
    total = per.groupBy(*keys).agg(F.sum("_n").alias("clusters"), F.count("*").alias("_distinct"))
    d = join_null_safe(per, total, keys).withColumn("_x", F.ln("size")).withColumn("_y", F.ln(F.col("_n") / F.col("clusters")))
    g = d.groupBy(*keys).agg(F.first("clusters").alias("clusters"), F.first("_distinct").alias("_distinct"), (-F.regr_slope("_y", "_x")).alias("_t"), F.regr_r2("_y", "_x").alias("_q"), F.var_pop("_y").alias("_vy"))
    ok = (F.col("clusters") >= 5) & (F.col("_distinct") >= 3)
    spread = F.col("_vy") * F.col("_distinct")
    return g.select(*keys, "clusters", F.when(ok, F.col("_t")).otherwise(0.0).alias("exponent"), F.when(ok, F.greatest(F.lit(0.0), 1 - spread * (1 - F.coalesce("_q", F.lit(1.0))) / (spread + 1e-12))).otherwise(0.0).alias("r2"))


def correlation_lengths(cells: DataFrame, keys: list[str], r: str, c: str, value: str) -> DataFrame:
    """(keys, length): the smallest radius, up to a quarter of the rows, at which the mean of the circular autocorrelation
    over cells of that distance (rounded down) falls under 1/e; 0 for a field without variance.

    A field is one group, as its transform needs it whole: 8 bytes a cell, so 134 MB for 4096 x 4096.  Missing cells count
    as the mean.
    """
    kind = StructType([*cells.select(*keys).schema]).add("length", "double")

    def measure(t: pa.Table) -> pa.Table:
        y, x, v = (t.column(k).to_numpy() for k in (r, c, value))
        y, x = y - y.min(), x - x.min()
        u = np.zeros((int(y.max()) + 1, int(x.max()) + 1))
        u[y, x] = v - v.mean()
        found, var = 0.0, float(u.var())
        if var >= 1e-12:
            acf = np.fft.fftshift(np.fft.ifft2(np.abs(np.fft.fft2(u)) ** 2).real) / (var * u.size)
            i, j = np.ogrid[: u.shape[0], : u.shape[1]]
            radius = np.sqrt((i - u.shape[0] // 2) ** 2 + (j - u.shape[1] // 2) ** 2).astype(int).ravel()
            most = u.shape[0] // 4
            near = radius < most
            mean = np.bincount(radius[near], acf.ravel()[near], most) / np.maximum(np.bincount(radius[near], minlength=most), 1) if most else np.zeros(0)
            low = np.flatnonzero(mean[1:] < max(mean[0], 0.0) / np.e) if most else []
            found = float(low[0] + 1) if len(low) else float(most)
        return pa.table([*(t.column(k).slice(0, 1) for k in keys), pa.array([found])], kind.names)

    d = cells.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(r).cast("long").alias(r), F.col(c).cast("long").alias(c), F.col(value).cast("double").alias(value))
    return d.groupBy(*keys).applyInArrow(measure, kind)


def slowing(means: DataFrame, run: list[str], step: str, mean: str) -> DataFrame:
    """(run, slow): the lag at which the autocorrelation of a run's mean values falls under 1/e, or their number if it never
    does; 0 for fewer than ten steps or no variance.  A run is one row of one number a step."""
    m = means.groupBy(*run).agg(F.transform(F.array_sort(F.collect_list(F.struct(step, mean))), lambda s: s[mean]).alias("_m"))
    m = m.withColumn("_a", F.aggregate("_m", F.lit(0.0), lambda a, x: a + x) / F.size("_m")).withColumn("_d", F.transform("_m", lambda x: x - F.col("_a")))
    m = m.withColumn("_z", F.aggregate("_d", F.lit(0.0), lambda a, x: a + x * x)).withColumn("_n", F.size("_d"))
    product = lambda k: F.aggregate(F.zip_with(F.slice(F.col("_d"), 1, F.col("_n") - k), F.slice(F.col("_d"), k + 1, F.col("_n") - k), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    low = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("_n") - 1)), lambda k: product(k) / (F.col("_z") + 1e-12) < 0.36787944117144233)
    slow = F.when((F.col("_n") < 10) | (F.col("_z") / F.col("_n") <= 1e-12), 0).otherwise(F.coalesce(F.try_element_at(low, F.lit(1)), F.col("_n")))
    return m.select(*run, slow.cast("double").alias("slow"))


def criticality(cells: DataFrame, run: list[str], step: str, r: str, c: str, value: str, tile: int = 256) -> DataFrame:
    """(run, step, clusters, exponent, r2, length, susceptibility, slow, score, verdict) of the field (r, c, value) of each step.

    Clusters are cells above the field's median; susceptibility is cells times the variance; ``slow`` is that of the whole
    run.  The score averages four parts between 0 and 1: an exponent near 2 with a good fit, a long correlation length, a
    large susceptibility, slowing down.  Null and not-a-number cells are left out.
    """
    keys = [*run, step]
    good = cells.where(F.col(value).isNotNull() & ~F.isnan(value))
    rows = F.count_distinct(r).alias("_rows")
    stats = good.groupBy(*keys).agg(F.count("*").alias("_cells"), rows, F.median(value).alias("_median"), F.avg(value).alias("_mean"), F.var_pop(value).alias("_var"))
    marked = join_null_safe(good, stats.select(*keys, "_median"), keys)
    named = clusters(marked, keys, r, c, F.col(value) > F.col("_median"), tile)
    law = size_law(named.groupBy(*keys, "cluster").agg(F.count("*").alias("size")), keys)
    t = stats.select(*keys, "_cells", "_rows", (F.col("_cells") * F.col("_var")).alias("susceptibility"))
    t = join_null_safe(t, slowing(stats.select(*keys, "_mean"), run, step, "_mean"), run)
    t = join_null_safe(t, correlation_lengths(good, keys, r, c, value), keys)
    out = join_null_safe(t, law, keys)
    one = lambda x: F.least(F.lit(1.0), x)
    parts = (
        F.greatest(F.lit(0.0), 1 - F.abs(F.col("exponent") - 2) / 1.5) * one(F.col("r2")),
        one(F.col("length") / (F.col("_rows") / 5)),
        one(F.col("susceptibility") / (F.col("_cells") * 0.01 + 1e-12)),
        one(F.col("slow") / 10),
    )
    out = out.withColumn("score", sum(parts[1:], parts[0]) / 4)
    # fixed values: bounds and names of the verdicts
    verdict = F.when(F.col("score") > 0.7, "critical").when(F.col("score") > 0.5, "edge_of_chaos").when(F.col("score") > 0.3, "supercritical").otherwise("subcritical")
    return out.select(*keys, "clusters", "exponent", "r2", "length", "susceptibility", "slow", "score", verdict.alias("verdict"))


def analytic_phase(x: np.ndarray) -> np.ndarray:
    """Phase of the analytic signal of each row: negative frequencies removed, positive ones doubled."""
    n = x.shape[1]
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.angle(np.fft.ifft(np.fft.fft(x, axis=1) * h, axis=1))


def order_parameter(cells: DataFrame, keys: list[str], r: str, c: str, value: str) -> DataFrame:
    """(keys, order, phase, state) of each field: length and angle of the mean of exp(i phase) over its cells.

    Phases are those of the analytic signal along each row of the field about the field's mean; rows are transformed by
    themselves in Arrow batches, and the sums of cosines and sines are Spark's.  A row is the cells of equal ``r`` by ``c``;
    nulls count as the mean.
    """
    mean = cells.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    d = join_null_safe(cells, mean, keys).select(*keys, r, c, F.coalesce(F.col(value) - F.col("_mean"), F.lit(0.0)).cast("double").alias("_x"))
    lines = d.groupBy(*keys, r).agg(F.transform(F.array_sort(F.collect_list(F.struct(c, "_x"))), lambda s: s["_x"]).alias("_x"))  # one row of a field
    kind = StructType([*cells.select(*keys).schema]).add("_n", "long").add("_cos", DoubleType()).add("_sin", DoubleType())

    def phases(batches):
        for b in batches:
            v = b.column(b.schema.get_field_index("_x"))
            size = v.value_lengths().to_numpy()
            off = np.append(0, np.cumsum(size))
            flat = v.flatten().to_numpy(zero_copy_only=False)
            co, si = np.zeros(b.num_rows), np.zeros(b.num_rows)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                p = analytic_phase(flat[off[at][:, None] + np.arange(n)])
                co[at], si[at] = np.cos(p).sum(axis=1), np.sin(p).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keys), pa.array(size.astype(np.int64)), pa.array(co), pa.array(si)], kind.names)

    g = lines.select(*keys, "_x").mapInArrow(phases, kind).groupBy(*keys).agg((F.sum("_cos") / F.sum("_n")).alias("_u"), (F.sum("_sin") / F.sum("_n")).alias("_w"))
    size = F.sqrt(F.col("_u") * F.col("_u") + F.col("_w") * F.col("_w"))
    turn = F.atan2("_w", "_u")
    state = F.when(size > 0.7, "synchronized").when(size > 0.3, "partial").otherwise("incoherent")  # fixed values
    return g.select(*keys, size.alias("order"), F.when(turn < 0, turn + 2 * np.pi).otherwise(turn).alias("phase"), state.alias("state"))
