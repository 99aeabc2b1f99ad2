"""Rolling windows and recurrences of series.

Recurrences that a window cannot express (resets, clamps) are folds over the sorted rows of one key, in the JVM.  A
series is cut by its key; keys bound what one task holds, so a fold is for keys of bounded length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lodestream.functions.scalars import logarithm, ratio

from .primitives import islands


def series(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def rolling_z(c: str, w: WindowSpec, n: int) -> Column:
    """Population z-score over the last n rows; NULL below a third of n values."""
    f = w.rowsBetween(-n + 1, 0)
    sd = F.stddev_pop(c).over(f)
    return F.when((F.count(c).over(f) >= max(1, n // 3)) & (sd > 0), (F.col(c) - F.avg(c).over(f)) / sd)


def mean_by_runs(df: DataFrame, w: WindowSpec, c: str, n: int, out: str, run: int = 16) -> DataFrame:
    """Mean over the last n rows, run <= n < 2 * run.  Rows of a key are numbered off into runs of ``run``; a run that lies in
    the frame as a whole is added up by itself, between the rows before and after it.

    That is the order in which the SQL adds.  Sums of doubles hang on it in their last digit only, but so do comparisons of
    means that are equal.
    """
    more = n - run
    d = df.withColumns({"_at": F.row_number().over(w), "_run": F.sum(c).over(w.rowsBetween(-run + 1, 0)), "_all": F.sum(c).over(w.rowsBetween(-n + 1, 0)), "_n": F.count(c).over(w.rowsBetween(-n + 1, 0))})
    after = F.col("_at") % run  # rows of the frame behind the run
    or_zero = lambda x: F.coalesce(x, F.lit(0.0))
    before = lambda k: F.lag(c, k).over(w)
    total = sum((or_zero(F.when(after <= k - run, before(k))) for k in range(n - 1, run - 1, -1)), F.lit(0.0))
    total = total + or_zero(F.coalesce(*[F.when(after == k, F.lag("_run", k).over(w)) for k in range(more + 1)]))
    total = sum((or_zero(F.when(after > k, before(k))) for k in range(more - 1, -1, -1)), total)
    d = d.withColumn("_all", F.when((F.col("_at") >= run) & (after <= more), total).otherwise(F.col("_all")))
    return d.withColumn(out, F.col("_all") / F.nullif("_n", F.lit(0))).drop("_at", "_run", "_all", "_n")


def change(c: str, w: WindowSpec, n: int = 1) -> Column:
    before = F.lag(c, n).over(w)
    return F.when(before != 0, F.col(c) / before - 1)


def transforms(df: DataFrame, w: WindowSpec, plan: list[tuple[str, str, int]]) -> DataFrame:
    """plan: (column, rolling_mean | diff | pct_change, n)."""
    kinds = {"rolling_mean": lambda c, n: F.avg(c).over(w.rowsBetween(-n + 1, 0)), "diff": lambda c, n: F.col(c) - F.lag(c, n).over(w), "pct_change": lambda c, n: change(c, w, n)}
    return df.withColumns({f"{c}_{k}_{n}": kinds[k](c, n) for c, k, n in plan})


def last_values(c: str, w: WindowSpec, n: int) -> Column:
    return F.collect_list(c).over(w.rowsBetween(-n + 1, 0))


def microstructure(df: DataFrame, w: WindowSpec, price: str, bid: str, ask: str, n: int) -> DataFrame:
    """Spread, imbalance, effective and realised spread, order flow, slope of price on flow, distance to rolling VWAP."""
    f = w.rowsBetween(-n + 1, 0)
    size = F.col(bid) + F.col(ask)
    flow = F.signum(F.col(price) - F.lag(price).over(w)) * size
    d = df.withColumn("flow", F.coalesce(flow, F.lit(0.0))).withColumn("dp", F.coalesce(F.col(price) - F.lag(price).over(w), F.lit(0.0)))
    d = d.withColumn("imbalance", (F.col(bid) - F.col(ask)) / F.nullif(size, F.lit(0.0)))
    d = d.withColumn("ofi", F.sum("flow").over(f)).withColumn("effective", 2 * F.abs(F.col(price) - F.avg(price).over(f)))
    d = d.withColumn("realised", 2 * F.abs(F.lead(price, n).over(w) - F.col(price)))
    d = d.withColumn("kyle", F.sum(F.col("dp") * F.col("flow")).over(f) / F.nullif(F.sum(F.col("flow") * F.col("flow")).over(f), F.lit(0.0)))
    return d.withColumn("to_vwap", F.col(price) - F.sum(F.col(price) * size).over(f) / F.nullif(F.sum(size).over(f), F.lit(0.0)))


def fracdiff_weights(d: float, floor: float = 1e-5, most: int = 200) -> list[float]:
    out = [1.0]
    while len(out) < most:
        w = -out[-1] * (d - len(out) + 1) / len(out)
        if abs(w) < floor:
            break
        out.append(w)
    return out


def fracdiff(c: str, w: WindowSpec, d: float, floor: float = 1e-5, most: int = 200) -> Column:
    """Weighted sum of the last values with the truncated binomial weights."""
    ws = fracdiff_weights(d, floor, most)
    path = F.reverse(F.collect_list(c).over(w.rowsBetween(-len(ws) + 1, 0)))
    weights = F.array(*[F.lit(x) for x in ws])
    return F.aggregate(F.zip_with(path, weights, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)


def realised_volatility(df: DataFrame, w: WindowSpec, price: str, n: int) -> DataFrame:
    f = w.rowsBetween(-n + 1, 0)
    d = df.withColumn("_b", F.lag(price).over(w)).withColumn("_q", ratio(F.col(price), F.col("_b"))).withColumn("_r", logarithm(F.col("_q"))).drop("_b", "_q")
    d = d.withColumn("rv", F.sqrt(F.sum(F.col("_r") * F.col("_r")).over(f)))
    return d.withColumn("vov", F.stddev_samp("rv").over(f)).drop("_r")


def volatility_regime(c: str, low: float, high: float, w: WindowSpec) -> Column:
    """calm, normal or wild; a missing value keeps the class before."""
    k = F.when(F.col(c) < low, "calm").when(F.col(c) < high, "normal").when(F.col(c).isNotNull(), "wild")
    return F.last(k, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def synchrony(panel: DataFrame, asset: str, ts: str, value: str, n: int, lag: int = 3) -> DataFrame:
    """Order parameter R of phases atan2(rolling sd, rolling mean) over assets, and its change over ``lag`` times."""
    f = Window.partitionBy(asset).orderBy(ts).rowsBetween(-n + 1, 0)
    p = panel.withColumn("phase", F.atan2(F.stddev_pop(value).over(f), F.avg(value).over(f)))
    g = p.groupBy(ts).agg(F.sqrt(F.pow(F.avg(F.cos("phase")), 2) + F.pow(F.avg(F.sin("phase")), 2)).alias("r"))
    w = Window.partitionBy(F.lit(1)).orderBy(ts)  # one row for each time
    return g.withColumn("dr", F.col("r") - F.lag("r", lag).over(w))


def adaptive_labels(df: DataFrame, w: WindowSpec, c: str, n: int) -> DataFrame:
    f = w.rowsBetween(-n + 1, 0)
    d = df.withColumn("_q", F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(f))
    iqr = F.col("_q")[2] - F.col("_q")[0]
    label = F.when(F.col(c) > F.col("_q")[1] + iqr + 1e-9, "high").when(F.col(c) < F.col("_q")[1] - iqr - 1e-9, "low").otherwise("mid")
    return d.withColumn("label", label).drop("_q")


def convergence(signals: DataFrame, name: str, ts: str, value: str, smooth: int) -> DataFrame:
    """Share of the majority sign, and mean size of the majority minus that of the others, sizes over their median."""
    w = Window.partitionBy(name).orderBy(ts)
    d = signals.withColumn("_c", F.avg(value).over(w.rowsBetween(-smooth + 1, 0)))
    d = d.withColumn("chg", F.col("_c") - F.lag("_c").over(w)).where("chg IS NOT NULL")
    med = d.groupBy(name).agg(F.percentile(F.abs("chg"), F.lit(0.5)).alias("med"))
    d = d.join(F.broadcast(med), name).withColumn("size", F.coalesce(F.abs("chg") / F.nullif("med", F.lit(0.0)), F.lit(0.0)))
    up, dn = F.col("chg") > 0, F.col("chg") < 0
    g = d.groupBy(ts).agg(F.count_if(up).alias("u"), F.count_if(dn).alias("d"), F.count("*").alias("n"), F.avg(F.when(up, F.col("size"))).alias("su"), F.avg(F.when(dn, F.col("size"))).alias("sd"))
    a, b = F.coalesce("su", F.lit(0.0)), F.coalesce("sd", F.lit(0.0))
    return g.select(ts, (F.greatest("u", "d") / F.col("n")).alias("support"), F.when(F.col("u") >= F.col("d"), a - b).otherwise(b - a).alias("strength"))


def volatility_shock(df: DataFrame, keys: list[str], order: list[str], ret: str, n: int) -> DataFrame:
    """Sd of the last n returns over that of the first n."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_i", F.row_number().over(w.orderBy(*order))).withColumn("_n", F.count("*").over(w))
    g = d.groupBy(*keys).agg(F.stddev_pop(F.when(F.col("_i") <= n, F.col(ret))).alias("first"), F.stddev_pop(F.when(F.col("_i") > F.col("_n") - n, F.col(ret))).alias("last"))
    return g.withColumn("shock", ratio(F.col("last"), F.col("first")))


def step_changes(cells: DataFrame, run: str, step: str, cell: list[str], value: str) -> DataFrame:
    """Mean absolute change of the cells at each step."""
    w = Window.partitionBy(run, *cell).orderBy(step)
    d = cells.withColumn("_d", F.abs(F.col(value) - F.lag(value).over(w))).where("_d IS NOT NULL")
    return d.groupBy(run, step).agg(F.avg("_d").alias("change"))


def change_point(steps: DataFrame, run: str, step: str) -> DataFrame:
    """Step of the largest robust z of the change, with a logistic score."""
    med = steps.groupBy(run).agg(F.percentile("change", F.lit(0.5)).alias("med"))
    d = steps.join(med, run).withColumn("dev", F.abs(F.col("change") - F.col("med")))
    mad = d.groupBy(run).agg(F.percentile("dev", F.lit(0.5)).alias("mad"))
    d = d.join(mad, run).withColumn("z", (F.col("change") - F.col("med")) / (1.4826 * F.col("mad") + 1e-12))
    g = d.groupBy(run).agg(F.max_by(step, F.struct("z", F.negative(step))).alias("at"), F.max("z").alias("z"))
    return g.withColumn("score", 1 / (1 + F.exp(-(F.col("z") - 3))))


def avalanches(counts: DataFrame, run: str, step: str, count: str, silence: int = 1) -> DataFrame:
    """Runs of activity parted by at least ``silence`` quiet steps: start, duration, size."""
    w = Window.partitionBy(run).orderBy(step)
    d = islands(counts.where(F.col(count) > 0), [run], [step], F.col(step) - F.lag(step).over(w) > silence, "burst")
    return d.groupBy(run, "burst").agg(F.min(step).alias("start"), (F.max(step) - F.min(step) + 1).alias("duration"), F.sum(count).alias("size"))


def backtest(bars: DataFrame, keys: list[str], order: list[str], close: str, signal: Column, fee: float) -> DataFrame:
    """Profit of holding the signal of the bar before: gain, cost, equity, drawdown at each bar."""
    w = Window.partitionBy(*keys).orderBy(*order)
    d = bars.withColumn("pos", F.coalesce(F.lag(signal).over(w), F.lit(0.0)))
    gain = F.col("pos") * F.coalesce(F.col(close) - F.lag(close).over(w), F.lit(0.0))
    cost = fee * F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0.0)))
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("pnl", gain - cost).withColumn("equity", F.sum("pnl").over(up))
    return d.withColumn("drawdown", F.greatest(F.lit(0.0), F.max("equity").over(up)) - F.col("equity"))


def decision(r: Column, dr: Column, kappa: Column) -> Column:
    return F.when((r < 0.3) & (kappa < 0), "KILL").when((r > 0.7) & (dr > 0), "EMERGENT").otherwise("CAUTION")


def phase_log(df: DataFrame, keys: list[str], order: str, phase: Column) -> DataFrame:
    """Rows where the phase changes, with the length of the phase that begins there."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.withColumn("phase", phase)
    d = islands(d, keys, [order], F.col("phase") != F.lag("phase").over(w), "part")
    return d.groupBy(*keys, "part").agg(F.min(order).alias("start"), F.first("phase").alias("phase"), F.count("*").alias("length"))


def conservation(df: DataFrame, keys: list[str], order: list[str], value: str, tolerance: float) -> DataFrame:
    """Count, share and maximum of steps whose relative change exceeds a tolerance."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rel = F.abs(F.col(value) - F.lag(value).over(w)) / F.greatest(F.abs(F.lag(value).over(w)), F.lit(1e-12))
    return df.withColumn("_e", rel).where("_e IS NOT NULL").groupBy(*keys).agg(F.count_if(F.col("_e") > tolerance).alias("violations"), F.avg((F.col("_e") > tolerance).cast("int")).alias("rate"), F.max("_e").alias("worst"))


def truth_guard(baseline: Column, observed: Column, confidence: Column, least: float, most: float) -> Column:
    rel = F.abs(observed - baseline) / F.greatest(F.abs(baseline), F.lit(1e-12))
    return F.when(confidence < least, "low confidence").when(rel > most, "drift").otherwise("quiet")


def warning_score(weights: dict[str, float], bias: float) -> Column:
    z = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in weights.items()), F.lit(bias))
    return 1 / (1 + F.exp(-z))
