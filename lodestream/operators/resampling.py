"""Tests and intervals for any statistic that is an aggregate: one-sample t, p-values, permutations, bootstraps."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestream.functions.special import normal_two_sided, t_two_sided
from lodestream.sources.files import with_checkpoints

from .lags import join_null_safe
from .search import uniform
from .stats import poisson_weight, two_samples

#: value, whether the row is of the first group, weight -> an aggregate
Statistic = Callable[[Column, Column, Column], Column]


def weighted_mean(value: Column, w: Column) -> Column:
    return F.sum(w * value) / F.nullif(F.sum(w), F.lit(0.0))


def mean_difference(value: Column, first: Column, w: Column) -> Column:
    return weighted_mean(value, F.when(first, w).otherwise(0.0)) - weighted_mean(value, F.when(first, 0.0).otherwise(w))


def standardised_difference(value: Column, first: Column, w: Column) -> Column:
    """Difference of means over the pooled standard deviation."""
    parts = []
    for own in (F.when(first, w).otherwise(0.0), F.when(first, 0.0).otherwise(w)):
        n, s, q = F.sum(own), F.sum(own * value), F.sum(own * value * value)
        parts.append((n, s / F.nullif(n, F.lit(0.0)), q - s * s / F.nullif(n, F.lit(0.0))))
    (na, ma, qa), (nb, mb, qb) = parts
    return (ma - mb) / F.nullif(F.sqrt(F.greatest(F.lit(0.0), (qa + qb) / F.nullif(na + nb - 2, F.lit(0.0)))), F.lit(0.0))


def _with_p(df: DataFrame, statistic: str, dof: str | None, name: str) -> DataFrame:
    """``df`` (a row a group) with a two-sided p-value of a column."""

    def add(frames):
        for t in frames:
            x = t[statistic].astype(float).to_numpy()
            p = normal_two_sided(x) if dof is None else t_two_sided(x, t[dof].astype(float).to_numpy())
            t[name] = pd.Series(np.where(np.isnan(p), None, p), index=t.index, dtype="Float64")
            yield t

    return df.mapInPandas(add, StructType([*df.schema]).add(name, "double"))


def one_sample_t(df: DataFrame, keys: list[str], value: str, mu: float) -> DataFrame:
    """(keys, n, mean, t, dof, p) of the hypothesis that the mean is ``mu``; t and p are null for fewer than two values or
    none that differ."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("_v"))
    t = F.when((F.col("n") > 1) & (F.col("_v") > 0), (F.col("mean") - mu) / F.sqrt(F.col("_v") / F.col("n")))
    return _with_p(g.select(*keys, "n", "mean", t.alias("t"), (F.col("n") - 1).cast("double").alias("dof")), "t", "dof", "p")


def two_sample_p(df: DataFrame, keys: list[str], group: Column, value: str) -> DataFrame:
    """(keys, t, dof, p_t, u, z, p_u): Welch's t with its p-value, and the rank sum's by the normal approximation with
    correction for ties and continuity.  Keys with fewer than two rows a group are left out."""
    good = df.where(F.col(value).isNotNull() & group.isNotNull())
    enough = good.groupBy(*keys).agg(F.count_if(group).alias("_na"), F.count_if(~group).alias("_nb")).where("_na > 1 AND _nb > 1")
    df = join_null_safe(good, enough, keys).drop("_na", "_nb")
    base = two_samples(df, keys, group, value).select(*keys, "na", "nb", "t", "dof", "u")
    ties = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_k")).groupBy(*keys).agg(F.sum(F.col("_k") * F.col("_k") * F.col("_k") - F.col("_k")).alias("_ties"))
    d = join_null_safe(base, ties, keys)
    n, m = F.col("na") + F.col("nb"), F.col("na") * F.col("nb")
    sd = F.sqrt(m / 12 * (n + 1 - F.col("_ties") / (n * (n - 1))))
    off = F.col("u") - m / 2
    d = d.withColumn("z", F.signum(off) * F.greatest(F.lit(0.0), F.abs(off) - 0.5) / F.nullif(sd, F.lit(0.0)))
    d = _with_p(_with_p(d.drop("_ties"), "t", "dof", "p_t"), "z", None, "p_u")
    return d.select(*keys, "t", "dof", "p_t", "u", "z", "p_u")


def permutation_test(df: DataFrame, keys: list[str], row: str, group: str, value: str, statistic: Statistic = mean_difference, rounds: int = 99, seed: int = 42, digits: int = 3) -> DataFrame:
    """(keys, statistic, extreme, p): how often a statistic of permuted groups is as far from 0 as the observed one.

    In a round the rows of a key, in the order of the md5 of seed, round and row, are the first group as long as that has
    members.  Rows are counted by the first ``digits`` digits of it, and only those that share them with the last member
    are ordered, one in 4,096: no round's rows move, and a key is no task.  ``p`` is (extreme + 1) / (rounds + 1).  Rows
    with a null group or value are left out; keys with fewer than two rows a group have none.
    """
    d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(*keys, F.col(row).alias("_row"), F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    size = d.groupBy(*keys).agg(F.count_if("_g").alias("_na"), F.count_if(~F.col("_g")).alias("_nb")).where("_na > 1 AND _nb > 1")
    one = F.lit(1.0)
    seen = join_null_safe(d, size, keys).groupBy(*keys).agg(statistic(F.col("_v"), F.col("_g"), one).alias("statistic"))
    with_checkpoints(df.sparkSession)
    hashed = F.md5(F.concat_ws(":", F.lit(seed), "_round", "_row"))
    bin_ = F.explode(F.array(F.substring(hashed, 1, digits)))  # what a generator has made is not computed anew for each condition on it
    of = d.withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_bin", bin_)
    of = of.groupBy(*keys, "_round", "_bin").agg(F.count("*").alias("_n"))
    up = Window.partitionBy(*keys, "_round").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)  # a row a bin
    of = join_null_safe(of, size, keys).withColumn("_left", F.col("_na") - (F.sum("_n").over(up) - F.col("_n"))).where("_left > 0 AND _left <= _n")
    edge = of.groupBy(*keys).agg(F.collect_list(F.struct("_round", F.col("_bin").alias("_edge"), "_left")).alias("_e")).checkpoint()
    each = join_null_safe(d, edge, keys).select(*keys, "_row", "_v", F.inline("_e")).withColumn("_bin", bin_)
    sure = each.where("_bin <> _edge").select(*keys, "_round", "_v", (F.col("_bin") < F.col("_edge")).alias("_g"))
    nth = F.row_number().over(Window.partitionBy(*keys, "_round").orderBy("_h", "_row"))
    close = each.where("_bin = _edge").withColumn("_h", hashed).select(*keys, "_round", "_v", (nth <= F.col("_left")).alias("_g"))
    stars = sure.union(close).groupBy(*keys, "_round").agg(statistic(F.col("_v"), F.col("_g"), one).alias("_s"))
    out = join_null_safe(stars, seen, keys).groupBy(*keys).agg(F.first("statistic").alias("statistic"), F.count_if(F.abs("_s") >= F.abs("statistic")).alias("extreme"))
    return out.withColumn("p", (F.col("extreme") + 1) / (rounds + 1))


def bootstrap_interval(df: DataFrame, keys: list[str], row: str, group: str, value: str, statistic: Statistic = standardised_difference, rounds: int = 200, confidence: float = 0.95, seed: int = 7) -> DataFrame:
    """(keys, point, low, high) of any statistic of two groups by a Poisson bootstrap: a row's weight in a round is a hash of
    row and round, so no row moves and sums combine before the shuffle.  Rounds without a value are not counted; with more
    than half of them there is no interval."""
    d = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(rounds))))
    d = d.withColumn("_u", uniform(seed, row, "_b")).withColumn("_w", F.when(F.col("_b") == 0, 1.0).otherwise(poisson_weight("_u").cast("double")))
    s = d.groupBy(*keys, "_b").agg(statistic(F.col(value).cast("double"), F.col(group), F.col("_w")).alias("_s"))
    at = s.groupBy(*keys).agg(F.max(F.when(F.col("_b") == 0, F.col("_s"))).alias("point"), F.array_sort(F.collect_list(F.when(F.col("_b") > 0, F.col("_s")))).alias("_r"))
    n, tail = F.size("_r"), (1 - confidence) / 2
    low, high = F.floor(n * F.lit(tail)).cast("int") + 1, F.ceil(n * F.lit(1 - tail)).cast("int")
    return at.where(n >= rounds / 2).select(*keys, "point", F.element_at("_r", low).alias("low"), F.element_at("_r", high).alias("high"))
