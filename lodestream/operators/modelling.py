"""Labels, splits, intervals, regimes, scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .primitives import global_position
from .search import uniform


def purged_folds(df: DataFrame, order: list[str], end: str, folds: int, embargo: int) -> DataFrame:
    """(fold, pos, role): test rows of each fold and the training rows that neither overlap it nor lie in its embargo.

    ``end`` is the position at which a row's label ends.  The first n mod k folds have one row more.
    """
    d = global_position(df, order, "pos")
    n = d.count()
    base, more = divmod(n, folds)
    start = [i * base + min(i, more) for i in range(folds + 1)]
    bounds = F.array(*[F.struct(F.lit(i).alias("fold"), F.lit(start[i]).alias("lo"), F.lit(start[i + 1]).alias("hi")) for i in range(folds)])
    x = d.select("pos", end, F.explode(bounds).alias("f")).select("pos", end, "f.*")
    test = (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi"))
    train = ((F.col(end) <= F.col("lo")) | (F.col("pos") >= F.col("hi"))) & ~((F.col("pos") >= F.col("lo") - embargo) & (F.col("pos") < F.col("hi") + embargo))
    return x.withColumn("role", F.when(test, "test").when(train, "train")).where("role IS NOT NULL").select("fold", "pos", "role")


def walk_forward(df: DataFrame, keys: list[str], order: list[str], train: int, step: int) -> DataFrame:
    """(keys, split, i, role): each split trains on ``train`` rows and tests on the ``step`` rows behind them."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(w))
    last = F.floor((F.col("_n") - train - step) / step)
    lo = F.greatest(F.lit(0), F.ceil((F.col("i") - train - step + 1) / step))
    hi = F.least(last, F.floor(F.col("i") / step))
    d = d.where(hi >= lo).select(*keys, "i", F.explode(F.sequence(lo, hi)).alias("split"))
    return d.withColumn("role", F.when(F.col("i") < F.col("split") * step + train, "train").otherwise("test"))


def conformal_width(df: DataFrame, keys: list[str], order: list[str], residual: str, alpha: float, half_life: float, most: int = 2000) -> DataFrame:
    """The smallest score whose decayed weight share reaches 1 - alpha, over the last ``most`` residuals."""
    w = Window.partitionBy(*keys)
    d = df.withColumn("_age", F.row_number().over(w.orderBy(*[F.desc(c) for c in order])) - 1).where(F.col("_age") < most)
    d = d.withColumn("_w", F.pow(F.lit(0.5), F.col("_age") / half_life)).withColumn("_s", F.abs(residual))
    up = w.orderBy("_s", "_age").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_share", F.sum("_w").over(up) / F.sum("_w").over(w))
    return d.where(F.col("_share") >= 1 - alpha - 1e-12).groupBy(*keys).agg(F.min("_s").alias("width"))


def guardrails(df: DataFrame, keys: list[str], order: list[str], pnl: str, most_drawdown: float, most_losses: int, cooldown: int) -> DataFrame:
    """Drawdown, length of the losing streak, halt (also for ``cooldown`` rows after one), throttle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_c", F.sum(pnl).over(up))
    d = d.withColumn("drawdown", F.greatest(F.lit(0.0), F.max("_c").over(up)) - F.col("_c"))
    d = d.withColumn("_island", F.sum((F.col(pnl) >= 0).cast("int")).over(up))
    d = d.withColumn("losses", F.sum((F.col(pnl) < 0).cast("int")).over(Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_hit", ((F.col("drawdown") > most_drawdown) | (F.col("losses") >= most_losses)).cast("int"))
    return d.withColumn("halted", F.max("_hit").over(w.rowsBetween(-cooldown, 0)) == 1).drop("_c", "_island", "_hit")


def scenarios(spark, count: int, steps: int, drift: float, sd: float, seed: int = 1) -> DataFrame:
    """(scenario, step, price): geometric paths; normals from two hashed uniforms, so any cluster draws the same."""
    d = spark.range(count).select(F.col("id").alias("scenario"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    z = F.sqrt(-2 * F.ln(uniform(seed, "scenario", "step"))) * F.cos(2 * F.pi() * uniform(seed + 1, "scenario", "step"))
    d = d.withColumn("r", drift + sd * z)
    return d.withColumn("price", F.exp(F.sum("r").over(Window.partitionBy("scenario").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))))


def evaluate(bars: DataFrame, keys: list[str], order: list[str], close: str, strategies: DataFrame, fee: float) -> DataFrame:
    """One row for each strategy (name, span) and key: profit and trades of following the sign of the change over span bars (at most 64)."""
    w = Window.partitionBy("name", *keys).orderBy(*order)
    d = bars.crossJoin(F.broadcast(strategies))  # a few strategies
    past = F.try_element_at(F.collect_list(close).over(w.rowsBetween(-64, 0)), -F.col("span") - 1)
    d = d.withColumn("sig", F.coalesce(F.signum(F.col(close) - past), F.lit(0.0)))
    d = d.withColumn("pos", F.coalesce(F.lag("sig").over(w), F.lit(0.0))).withColumn("turn", F.abs(F.col("pos") - F.coalesce(F.lag("sig", 2).over(w), F.lit(0.0))))
    d = d.withColumn("pnl", F.col("pos") * F.coalesce(F.col(close) - F.lag(close).over(w), F.lit(0.0)) - fee * F.col("turn"))
    return d.groupBy("name", *keys).agg(F.sum("pnl").alias("pnl"), F.count_if(F.col("turn") > 0).alias("trades"))


def label_by_profile(df: DataFrame, cluster: str, feature: str, names: list[str]) -> DataFrame:
    """Clusters named by the order of their mean feature."""
    m = df.groupBy(cluster).agg(F.avg(feature).alias("_m"))
    r = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("_m"))  # a row for each cluster
    return df.join(F.broadcast(m.select(cluster, F.get(F.array(*[F.lit(n) for n in names]), r - 1).alias("regime"))), cluster)


