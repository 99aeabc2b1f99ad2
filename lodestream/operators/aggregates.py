"""Aggregations: buckets of news and metrics, execution quality, risk, agreement, ledgers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .primitives import bucket, fill_forward, grid


def news_buckets(df: DataFrame, keys: list[str], ts: str, score: str, source: str, seconds: int) -> DataFrame:
    """Count, mean, sd and sources of each bucket; empty buckets are 0."""
    g = df.groupBy(*keys, bucket(ts, seconds).alias("bucket")).agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"), F.count_distinct(source).alias("sources"))
    return grid(g, keys, "bucket", seconds).join(g, [*keys, "bucket"], "left").fillna(0, ["n", "mean", "sd", "sources"])


def latest_snapshot(df: DataFrame, order: list[str], score: str, source: str, n: int = 10) -> DataFrame:
    last = df.orderBy(*[F.desc(c) for c in order]).limit(n)
    return last.agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.count_distinct(source).alias("sources"))


def weighted_sentiment(df: DataFrame, keys: list[str], ts: str, score: str, volume: str, source: str, seconds: int) -> DataFrame:
    """Volume-weighted score (0 without volume) and the change of the unweighted mean from bucket to bucket."""
    sc, v = F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.col(score))), F.greatest(F.lit(0.0), F.col(volume))
    g = df.groupBy(*keys, bucket(ts, seconds).alias("bucket")).agg(F.sum(sc * v).alias("sv"), F.sum(v).alias("v"), F.avg(sc).alias("mean"), F.count_distinct(source).alias("sources"))
    w = Window.partitionBy(*keys).orderBy("bucket")
    return g.withColumn("weighted", F.when(F.col("v") > 0, F.col("sv") / F.col("v")).otherwise(0.0)).withColumn("momentum", F.col("mean") - F.lag("mean").over(w)).drop("sv", "v")


def pivot_metrics(df: DataFrame, ts: str, metric: str, value: str, metrics: list[str], seconds: int) -> DataFrame:
    """One column for each metric: mean of the bucket carried forward, and its change."""
    g = df.groupBy(bucket(ts, seconds).alias("bucket")).pivot(metric, metrics).agg(F.avg(value)).withColumn("one", F.lit(1))
    g = grid(g, ["one"], "bucket", seconds).join(g, ["one", "bucket"], "left")
    g = fill_forward(g, ["one"], ["bucket"], metrics)
    w = Window.partitionBy("one").orderBy("bucket")
    return g.withColumns({f"{m}_change": F.col(m) - F.lag(m).over(w) for m in metrics}).drop("one")


def execution_quality(fills: DataFrame, order: str, price: str, qty: str, benchmark: str, side: str, target: str) -> DataFrame:
    """VWAP, slippage against a benchmark in its direction, shortfall and fill rate of each order."""
    f = fills.where(F.col(qty) > 0)
    g = f.groupBy(order).agg((F.sum(F.col(price) * F.col(qty)) / F.sum(qty)).alias("vwap"), F.sum(qty).alias("filled"), F.first(benchmark).alias("bench"), F.first(side).alias("side"), F.first(target).alias("target"))
    sign = F.when(F.col("side") == "sell", -1.0).otherwise(1.0)
    g = g.withColumn("slippage", sign * (F.col("vwap") - F.col("bench"))).withColumn("shortfall", F.col("slippage") * F.col("filled"))
    return g.withColumn("fill_rate", F.least(F.lit(1.0), F.col("filled") / F.col("target"))).select(order, "vwap", "filled", "slippage", "shortfall", "fill_rate")


def latency_summary(df: DataFrame, keys: list[str], latency: str) -> DataFrame:
    q = F.percentile(latency, F.array(F.lit(0.5), F.lit(0.95)))
    g = df.groupBy(*keys).agg(F.count(latency).alias("n"), F.avg(latency).alias("mean"), q.alias("q"), F.max(latency).alias("worst"))
    return g.select(*keys, "n", "mean", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), "worst")


def imbalance(df: DataFrame, keys: list[str], buy: Column, sell: Column) -> DataFrame:
    g = df.groupBy(*keys).agg(F.sum(buy).alias("buy"), F.sum(sell).alias("sell"))
    return g.withColumn("imbalance", F.coalesce((F.col("buy") - F.col("sell")) / F.nullif(F.col("buy") + F.col("sell"), F.lit(0.0)), F.lit(0.0)))


def cumulative_delta(df: DataFrame, keys: list[str], order: list[str], signed: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("delta", F.sum(signed).over(w))


def fairness(df: DataFrame, group: str, predicted: str, actual: str) -> DataFrame:
    """Gap of positive rates, and of true-positive rates, between groups."""
    g = df.groupBy(group).agg(F.avg(predicted).alias("rate"), F.avg(F.when(F.col(actual) == 1, F.col(predicted))).alias("tpr"))
    return g.agg((F.max("rate") - F.min("rate")).alias("parity_gap"), (F.max("tpr") - F.min("tpr")).alias("opportunity_gap"))


def regression_errors(df: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    y, p = F.col(actual), F.col(predicted)
    e = y - p
    smape = F.when(F.abs(y) + F.abs(p) > 0, 2 * F.abs(e) / (F.abs(y) + F.abs(p))).otherwise(0.0)
    g = df.groupBy(*keys).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.avg(F.when(y != 0, F.abs(e / y))).alias("mape"), F.avg(smape).alias("smape"), F.var_pop(y).alias("var"))
    r2 = F.when(F.col("var") > 0, 1 - F.col("mse") / F.col("var")).otherwise(F.when(F.col("mse") == 0, 1.0).otherwise(0.0))
    return g.withColumn("rmse", F.sqrt("mse")).withColumn("r2", r2).drop("var")


def tail_risk(df: DataFrame, keys: list[str], value: str, alpha: float) -> DataFrame:
    """Value at risk (a loss is positive) and the mean of what lies beyond it."""
    q = df.groupBy(*keys).agg(F.percentile(value, F.lit(1 - alpha)).alias("q"))
    t = df.join(q, keys).where(F.col(value) <= F.col("q"))
    return t.groupBy(*keys).agg((-F.first("q")).alias("var"), (-F.avg(value)).alias("es"))


def sharpe_drawdown(df: DataFrame, keys: list[str], order: list[str], ret: str, trials: int = 50, periods: int = 252) -> DataFrame:
    """Mean over sd, the deepest fall of the running sum below its maximum so far, and the deflated ratio: the yearly one
    less the highest that ``trials`` tries without skill are expected to reach, 0 for two returns or fewer."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_c", F.sum(ret).over(w)).withColumn("_top", F.greatest(F.lit(0.0), F.max("_c").over(w)))
    g = d.groupBy(*keys).agg(F.avg(ret).alias("m"), F.stddev_samp(ret).alias("sd"), F.max(F.col("_top") - F.col("_c")).alias("drawdown"), F.count(ret).alias("n"))
    g = g.withColumn("sharpe", F.when(F.col("sd") > 0, F.col("m") / F.col("sd")).otherwise(0.0)).drop("m", "sd")
    root = math.sqrt(2 * math.log(trials))
    luck = root - (math.log(math.log(trials)) + math.log(4 * math.pi)) / (2 * root)
    return g.withColumn("deflated", F.when(F.col("n") > 2, (F.abs(F.col("sharpe")) * math.sqrt(periods) - luck) * F.sqrt((F.col("n") - 1) / (F.col("n") - 2))).otherwise(0.0))


def kelly_size(edge: Column, variance: Column, shrink: Column, cap: float) -> Column:
    return F.greatest(F.lit(-cap), F.least(F.lit(cap), F.coalesce(edge / F.nullif(variance, F.lit(0.0)), F.lit(0.0)) * shrink))


def portfolio_risk(df: DataFrame, portfolio: str, exposure: str, volatility: str, z: float = 1.6448536269514722, stress: float = 3.0) -> DataFrame:
    """Weighted exposure, normal value at risk, stressed loss, instruments over a fifth of gross."""
    w = Window.partitionBy(portfolio)
    d = df.withColumn("_gross", F.sum(F.abs(exposure)).over(w))
    share = F.abs(F.col(exposure)) / F.nullif(F.col("_gross"), F.lit(0.0))
    g = d.groupBy(portfolio).agg(F.sum(F.abs(F.col(exposure)) * F.col(volatility)).alias("risk"), F.count_if(share > 0.2).alias("concentrated"), F.sum(exposure).alias("net"))
    return g.withColumn("var", F.col("risk") * z).withColumn("stress", F.col("risk") * stress)


def signal_ensemble(df: DataFrame, keys: list[str], value: str, mean: str, sd: str, weight: str, bound: float = 1.0) -> DataFrame:
    z = F.when(F.col(sd) > 0, (F.col(value) - F.col(mean)) / F.col(sd)).otherwise(0.0)
    g = df.groupBy(*keys).agg(F.coalesce(F.sum(z * F.col(weight)) / F.nullif(F.sum(F.abs(weight)), F.lit(0.0)), F.lit(0.0)).alias("raw"))
    return g.withColumn("strength", F.greatest(F.lit(-bound), F.least(F.lit(bound), F.col("raw"))))


def divergence_vote(df: DataFrame, keys: list[str], direction: str, confidence: str, strength: str, min_support: int, min_consensus: float, order: list[str] | None = None) -> DataFrame:
    """The side that has enough signals and share of confidence; tanh of mean strength times share.

    With an ``order`` of rows sums are added up in it, so equal votes are told apart by the same last digits wherever the
    rows lie, and as one thread of the SQL does; without it, a share that reaches its bound but for the last digits counts.
    """
    side = lambda s: F.col(direction) == s
    parts = {"all": F.col(confidence)} | {f"{c}_{s}": F.when(side(s), F.col(v)) for s in ("bull", "bear") for c, v in (("c", confidence), ("t", strength))}
    if order:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumns({f"_{c}": F.sum(x).over(w) for c, x in parts.items()})
        sums = [F.max_by(f"_{c}", F.struct(*order)).alias(c) for c in parts]
    else:
        sums = [F.sum(x).alias(c) for c, x in parts.items()]
    counts = [F.count(F.when(side(s), F.col(v))).alias(f"{c}_{s}") for s in ("bull", "bear") for c, v in (("n", direction), ("k", strength))]
    g = df.groupBy(*keys).agg(*sums, *counts)
    for s in ("bull", "bear"):
        share = F.coalesce(F.col(f"c_{s}") / F.nullif(F.col("all"), F.lit(0.0)), F.lit(0.0))
        reached = (share if order else F.round(share, 12)) >= min_consensus  # a sum's last digit hangs on the order of its parts
        mean = F.col(f"t_{s}") / F.nullif(F.col(f"k_{s}"), F.lit(0))
        g = g.withColumn(f"v_{s}", F.when((F.col(f"n_{s}") >= min_support) & reached, mean * share))
    won = F.when(F.col("v_bull").isNull() & F.col("v_bear").isNull(), "none").when(F.col("v_bear").isNull() | (F.col("v_bull") >= F.col("v_bear")), "bull").otherwise("bear")
    g = g.withColumn("side", won)
    score = F.when(F.col("side") == "bull", F.tanh("v_bull")).when(F.col("side") == "bear", -F.tanh("v_bear")).otherwise(0.0)
    return g.select(*keys, "side", score.alias("score"))


def combine_vectors(df: DataFrame, keys: list[str], vector: str, weight: str) -> DataFrame:
    """Weighted mean of vectors, position by position: (keys, pos, value)."""
    d = df.select(*keys, weight, F.posexplode(vector).alias("pos", "x"))
    return d.groupBy(*keys, "pos").agg((F.sum(F.col("x") * F.col(weight)) / F.nullif(F.sum(F.abs(weight)), F.lit(0.0))).alias("value"))


def phase_statistics(df: DataFrame, session: str, phase: str, order: list[str], latency: str, correct: str) -> DataFrame:
    """Accuracy, mean, median, coefficient of variation and jitter for each phase of a session, and for the session."""
    w = Window.partitionBy(session, phase).orderBy(*order)
    d = df.withColumn("_j", F.abs(F.col(latency) - F.lag(latency).over(w)))
    g = d.rollup(session, phase).agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("int")).alias("accuracy"), F.avg(latency).alias("mean"), F.percentile(latency, F.lit(0.5)).alias("median"), (F.stddev_samp(latency) / F.avg(latency)).alias("cv"), F.avg("_j").alias("jitter"))
    return g.where(F.col(session).isNotNull())


def summary(df: DataFrame, value: str, target: float = 1.0, width: float = 0.15) -> DataFrame:
    return df.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg((F.abs(F.col(value) - target) <= width).cast("int")).alias("near"))


def multiverse(df: DataFrame, factors: list[str], effect: str, low: str) -> DataFrame:
    """Median, 5th and 95th percentile and shares of positive cells, for the whole grid and each value of each factor."""
    q = F.percentile(effect, F.array(F.lit(0.5), F.lit(0.05), F.lit(0.95)))
    sets = df.select(F.explode(F.array(F.struct(F.lit("all").alias("factor"), F.lit("").alias("level")), *[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])).alias("g"), effect, low)
    g = sets.groupBy("g.factor", "g.level").agg(F.count("*").alias("cells"), q.alias("q"), F.avg((F.col(effect) > 0).cast("int")).alias("positive"), F.avg((F.col(low) > 1).cast("int")).alias("above_one"))
    return g.select("factor", "level", "cells", F.col("q")[0].alias("median"), F.col("q")[1].alias("p05"), F.col("q")[2].alias("p95"), "positive", "above_one")


def feature_statistics(df: DataFrame, features: list[str]) -> DataFrame:
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("x")).select("x.*")
    return long.groupBy("feature").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))


def quadratic_kappa(df: DataFrame, a: str, b: str, low: int, high: int) -> DataFrame:
    """1 minus observed over expected squared disagreement; both from the moments of the ratings, in one pass."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    g = df.where(F.col(a).between(low, high) & F.col(b).between(low, high)).agg(F.avg((x - y) * (x - y)).alias("o"), F.avg(x * x).alias("xx"), F.avg(y * y).alias("yy"), F.avg(x).alias("x"), F.avg(y).alias("y"), F.count("*").alias("n"))
    e = F.col("xx") + F.col("yy") - 2 * F.col("x") * F.col("y")
    return g.select("n", F.when(e > 0, 1 - F.col("o") / e).otherwise(1.0).alias("kappa"))


def corroborated(df: DataFrame, keys: list[str], ts: str, seconds: int, channel: str, fires: Column, least: int) -> DataFrame:
    g = df.where(fires).groupBy(*keys, bucket(ts, seconds).alias("bucket")).agg(F.count_distinct(channel).alias("channels"))
    return g.withColumn("verdict", F.when(F.col("channels") >= least, "real").otherwise("quarantine"))


def accounts(fills: DataFrame, key: str, symbol: str, order: list[str], price: str, signed: Column, fee: Column) -> DataFrame:
    """Cash, fees, net and gross exposure and equity of each key from net quantity times last price."""
    by = fills.groupBy(key, symbol).agg(F.sum(signed).alias("net"), F.max_by(price, F.struct(*order)).alias("last"), F.sum(-signed * F.col(price)).alias("cash"), F.sum(fee).alias("fees"))
    g = by.groupBy(key).agg((F.sum("cash") - F.sum("fees")).alias("cash"), F.sum("fees").alias("fees"), F.sum(F.col("net") * F.col("last")).alias("net"), F.sum(F.abs(F.col("net") * F.col("last"))).alias("gross"))
    return g.withColumn("equity", F.col("cash") + F.col("net"))


#: Fixed weights of evidence tiers.
TIER_WEIGHTS = {"measured": 1.0, "derived": 0.6, "reported": 0.2}


def evidence_precision(df: DataFrame, claim: str, tier: str, reliability: str) -> DataFrame:
    w = F.coalesce(*[F.when(F.col(tier) == t, F.lit(v)) for t, v in TIER_WEIGHTS.items()], F.lit(0.0))
    counts = [F.count_if(F.col(tier) == t).alias(f"n_{t}") for t in TIER_WEIGHTS]
    return df.groupBy(claim).agg(F.avg(w * F.col(reliability)).alias("precision"), *counts)


def fitted_line(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def causal_gate(edges: DataFrame, target: str, strength: str, passed: Column, threshold: float, kappa: float) -> DataFrame:
    g = edges.groupBy(target).agg(F.coalesce(F.sum(F.when(passed & (F.col(strength) >= threshold), F.col(strength))), F.lit(0.0)).alias("drive"))
    return g.withColumn("gate", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - kappa * F.col("drive"))))


def gaming_signals(evidence: DataFrame, claim: str, item: str, author: str, reviewer: str, source: str) -> DataFrame:
    """For each claim: share of evidence that other claims use too, share of rows whose author also reviews, share without source."""
    uses = evidence.groupBy(item).agg(F.count_distinct(claim).alias("claims"))
    return evidence.join(uses, item).groupBy(claim).agg(F.avg((F.col("claims") > 1).cast("int")).alias("reuse"), F.avg((F.col(author) == F.col(reviewer)).cast("int")).alias("overlap"), F.avg(F.col(source).isNull().cast("int")).alias("gap"))
