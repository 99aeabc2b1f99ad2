"""Circular block bootstrap of a slope: autocorrelation time, block length, replicates from cumulative sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lags import join_null_safe, lag_products, prefix_sums


def autocorrelation_times(df: DataFrame, keys: list[str], order: list[str], cols: list[str], start: int = 32) -> DataFrame:
    """(keys, n, tau of each column): 1 + 2 sum of the autocorrelations before the first two in a row that are not positive.

    Lags go up to half of a series; they are taken ``start`` at a time, doubled until no series needs more.
    """
    means = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"_m{c}") for c in cols])
    centred = join_null_safe(df, means, keys).select(*keys, *order, "n", *[(F.col(c) - F.col(f"_m{c}")).cast("double").alias(c) for c in cols])
    longest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    most = start
    while True:
        sums = lag_products(centred, keys, order, cols, most)
        table = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lag", *cols))).alias("s"))  # most + 1 structs
        table = join_null_safe(table, means.select(*keys, "n"), keys)
        out = table.select(*keys, "n", *[time_of(c, most).alias(f"_t{c}") for c in cols])
        undecided = F.lit(False)
        for c in cols:
            undecided |= F.col(f"_t{c}").isNull()
        if most >= longest or not out.where(undecided).limit(1).count():
            return out.select(*keys, "n", *[F.col(f"_t{c}").alias(f"tau_{c}") for c in cols])
        most *= 2


def time_of(col: str, most: int) -> Column:
    """The time from the array ``s`` of lag sums; null where it needs more lags than there are."""
    last = F.least(F.floor(F.col("n") * 0.5), F.col("n") - 2)  # lags below this one are used
    zero = F.element_at("s", 1)[col]
    rho = F.transform("s", lambda x: F.when(x["lag"] < last, x[col] / zero).otherwise(0.0))
    flat = zero / F.col("n") < 1e-12
    # the first lag from 1 on with rho and the next one not positive; beyond the last lag rho counts as 0
    at = F.filter(F.sequence(F.lit(1), F.size("s") - 1), lambda k: (F.element_at(rho, k + 1) <= 0) & (F.coalesce(F.try_element_at(rho, k + 2), F.lit(0.0)) <= 0) & ((k + 1 <= most) | (k + 1 >= last)))
    stop = F.coalesce(F.try_element_at(at, F.lit(1)), F.when(last <= most, last))
    total = 1 + 2 * F.aggregate(F.slice(rho, 2, F.greatest(F.lit(0), (stop - 1).cast("int"))), F.lit(0.0), lambda a, x: a + x)
    return F.when(flat | (F.col("n") < 4), 1.0).when(stop.isNotNull(), F.greatest(F.lit(1.0), total))


def hashed_below(n: Column, *parts: Column) -> Column:
    """A number below ``n`` from the md5 of the parts, joined by colons."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 15), 16, 10).cast("long"), n)


def block_bootstrap(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, multiple: float = 2.0, least: int = 8, rounds: int = 200, alpha: float = 0.05, seed: int = 42, non_overlapping: Column | None = None) -> DataFrame:
    """(keys, n, slope, low, high, n_eff, tau, block): least-squares slope of y on x and its circular block bootstrap interval.

    A block is ``multiple`` autocorrelation times long (the longest of x, y and the residuals), ``least`` rows at least.
    Block starts are hashes of series, round and block; a block goes on at the series' begin.  A replicate needs sums over
    its blocks only, and those are differences of cumulative sums at the blocks' ends: two or three lookups a block, no
    row is copied.  Pairs with a null or non-finite entry are left out; ``non_overlapping`` bounds the effective number.
    """
    ok = F.lit(True)
    for c in (x, y):
        ok &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    rows = df.where(ok).select(*keys, *order, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    line = rows.groupBy(*keys).agg(F.avg("_x").alias("_mx"), F.avg("_y").alias("_my"), F.coalesce(F.regr_slope("_y", "_x"), F.lit(0.0)).alias("slope"))
    c = join_null_safe(rows, line, keys).select(*keys, *order, (F.col("_x") - F.col("_mx")).alias("cx"), (F.col("_y") - F.col("_my")).alias("cy"), "slope")
    c = c.withColumn("ce", F.col("cy") - F.col("slope") * F.col("cx"))
    tau = autocorrelation_times(c.select(*keys, *order, "cx", "cy", "ce"), keys, order, ["cx", "cy", "ce"])
    tau = tau.select(*keys, "n", F.greatest("tau_cx", "tau_cy", "tau_ce").alias("tau"))
    plan = join_null_safe(tau, line.select(*keys, "slope"), keys).withColumn("block", F.greatest(F.ceil(F.col("tau") * multiple), F.lit(least)).cast("long"))
    sums = prefix_sums(c.select(*keys, *order, "cx", "cy"), keys, order, {"sx": F.col("cx"), "sy": F.col("cy"), "sxx": F.col("cx") * F.col("cx"), "sxy": F.col("cx") * F.col("cy")})
    blocks = plan.withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / F.col("block")) - 1)))
    blocks = blocks.withColumn("_begin", hashed_below(F.col("n"), F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys], F.col("_round"), F.col("_nth")))
    blocks = blocks.withColumn("_end", F.col("_begin") + F.least("block", F.col("n") - F.col("_nth") * F.col("block")))
    over = F.col("_end") > F.col("n")
    at = lambda place, sign: F.struct(place.cast("long").alias("_at"), F.lit(sign).alias("_sign"))
    ends = F.array(at(F.col("_begin") - 1, -1.0), at(F.when(over, F.col("n")).otherwise(F.col("_end")) - 1, 1.0), F.when(over, at(F.col("_end") - F.col("n") - 1, 1.0)))
    looked = blocks.select(*keys, "_round", F.explode(F.array_compact(ends)).alias("_e")).select(*keys, "_round", "_e._at", "_e._sign").where("_at >= 0")
    got = join_null_safe(looked, sums.select(*keys, "_at", "sx", "sy", "sxx", "sxy"), [*keys, "_at"])
    each = got.groupBy(*keys, "_round").agg(*[F.sum(F.col("_sign") * F.col(s)).alias(s) for s in ("sx", "sy", "sxx", "sxy")])
    each = join_null_safe(each, plan.select(*keys, "n"), keys)
    below = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    each = each.withColumn("b", F.when(below > 1e-12 * F.col("sxx"), (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / below))
    q = each.groupBy(*keys).agg(F.percentile("b", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    out = join_null_safe(plan, q, keys)
    n_eff = F.greatest(F.floor(F.col("n") / F.col("tau")), F.lit(1))
    if non_overlapping is not None:
        n_eff = F.least(n_eff, F.greatest(non_overlapping, F.lit(1)))
    return out.select(*keys, "n", "slope", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), n_eff.cast("long").alias("n_eff"), "tau", "block")


