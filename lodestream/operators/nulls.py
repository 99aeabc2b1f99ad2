"""Null series: autoregressions by Yule and Walker, and permutations that keep the autocorrelation."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from .lags import join_null_safe, lag_products, placed


def lag_sums(df: DataFrame, keys: list[str], order: list[str], value: str, most: int) -> DataFrame:
    """(keys, n, mean, sums): sums of the products of the centred series with itself at lags 0 to ``most``.

    A null or non-finite value is left out before lags are taken.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(*keys, *order, v.alias("_v"))
    mean = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"))
    c = join_null_safe(rows, mean, keys).select(*keys, *order, (F.col("_v") - F.col("mean")).alias("_v"))
    sums = lag_products(c, keys, order, ["_v"], most).select(*keys, "lag", F.col("_v").alias("s"))
    sums = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("lag", "s"))), lambda x: x["s"]).alias("sums"))  # most + 1 numbers
    return join_null_safe(mean, sums, keys)


def levinson(r: np.ndarray, order: int) -> tuple[np.ndarray, float]:
    """Coefficients and innovation variance of an autoregression from autocovariances r[0..order]."""
    phi, left = np.zeros(0), float(r[0])
    for k in range(1, order + 1):
        if left <= 0:
            return np.append(phi, np.zeros(order - len(phi))), left
        new = (r[k] - phi @ r[k - 1 : 0 : -1]) / left
        phi = np.append(phi - new * phi[::-1], new)
        left *= 1 - new * new
    return phi, left


def stationary(phi: np.ndarray) -> bool:
    """Whether all roots of 1 - sum phi_k z^k lie outside the unit circle."""
    roots = np.roots(np.append(-phi[::-1], 1.0))
    return bool(np.all(np.abs(roots) > 1 + 1e-6))


def yule_walker(df: DataFrame, keys: list[str], order: list[str], value: str, p: int = 8) -> DataFrame:
    """(keys, n, mean, used, phi, sigma2, converged): an autoregression of up to ``p`` terms on unbiased autocovariances.

    The order falls until the fit is stationary; a series for which even one term is not gets none, the variance about its
    mean, and is marked.  Series of fewer than 8 p values have no fit.
    """
    names = [f.name for f in df.select(*keys).schema]
    kind = StructType([*df.select(*keys).schema]).add("n", "long").add("mean", "double").add("used", "integer").add("phi", ArrayType(DoubleType())).add("sigma2", "double").add("converged", "boolean")

    def solve(frames):
        for t in frames:
            out = []
            for n, sums in zip(t["n"], t["sums"], strict=True):
                if n < 8 * p:
                    out.append((None, None, None, False))
                    continue
                r = np.asarray(sums, float)[: p + 1] / (n - np.arange(p + 1))
                for used in range(p, 0, -1):
                    phi, left = levinson(r, used)
                    if r[0] > 0 and stationary(phi):
                        break
                else:
                    used, phi, left = 0, np.zeros(0), float(r[0]) + 1e-12
                out.append((used, phi.tolist(), left if left > 0 else float(r[0]) * 1e-3, used > 0))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pd.DataFrame({**{k: t[k] for k in names}, "n": t["n"], "mean": t["mean"], "used": pd.array(cols[0], "Int32"), "phi": pd.Series(list(cols[1]), index=t.index, dtype=object), "sigma2": pd.array(cols[2], "Float64"), "converged": list(cols[3])})

    return lag_sums(df, keys, order, value, p).mapInPandas(solve, kind)


def normals(seed: int, series: int, first: int, n: int) -> np.ndarray:
    """Standard normal draws that hang on seed, series and place alone."""
    t = np.arange(first, first + n, dtype=np.int64).astype(np.uint64)
    base = np.uint64((seed * 0x9E3779B97F4A7C15 + series) & (2**64 - 1))

    def uniform(salt: int) -> np.ndarray:
        h = (t + np.uint64(salt)) * np.uint64(0xD1342543DE82EF95) ^ base
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53

    return np.sqrt(-2 * np.log(1 - uniform(1))) * np.cos(2 * np.pi * uniform(0x5851F42D4C957F2D))


def impulse(phi: np.ndarray, most: int = 20_000) -> np.ndarray:
    """Weights of past innovations, until they stay under 1e-12 of the first."""
    out, p = [1.0], len(phi)
    while len(out) < most and (len(out) <= p or max(map(abs, out[-p:])) > 1e-12) and p:
        past = out[-p:][::-1]
        out.append(float(np.dot(phi[: len(past)], past)))
    return np.array(out)


def ar_surrogate(df: DataFrame, keys: list[str], order: list[str], value: str, p: int = 8, seed: int = 42, size: int = 50_000) -> DataFrame:
    """(keys, _at, value): a Gaussian realisation of the fitted autoregression for every place of a series, about its mean.

    The value at a place is a weighted sum of the draws before it, which hang on their places, so every slice of a series
    is made by itself.
    """
    v = F.col(value).cast("double")
    rows = placed(df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(*keys, *order), keys, order).select(*keys, "_at")
    fit = yule_walker(df, keys, order, value, p).where("phi IS NOT NULL")
    spans = rows.groupBy(*keys, F.floor(F.col("_at") / size).alias("_part")).agg(F.min("_at").alias("_from"), F.count("*").alias("_count"))
    spans = join_null_safe(spans, fit.select(*keys, "phi", "sigma2", "mean"), keys).withColumn("_id", F.xxhash64(*keys))
    kind = StructType([*df.select(*keys).schema]).add("_at", "long").add(value, "double")

    def make(batches):
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(b.schema.get_field_index(c))[i].as_py() for c in ("phi", "sigma2", "mean", "_from", "_count", "_id")}
                w = impulse(np.array(row["phi"]))
                e = normals(seed, row["_id"], row["_from"] - len(w) + 1, row["_count"] + len(w) - 1)
                y = np.convolve(e, w)[len(w) - 1 : len(w) - 1 + row["_count"]] * np.sqrt(row["sigma2"]) + row["mean"]
                own = [b.column(b.schema.get_field_index(k)).take(pa.array([i] * row["_count"])) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.arange(row["_from"], row["_from"] + row["_count"])), pa.array(y)], [*keys, "_at", value])

    y = spans.mapInArrow(make, kind)
    # the realisation's own mean gives way to the series'
    shift = y.groupBy(*keys).agg(F.avg(value).alias("_own"))
    shift = join_null_safe(shift, fit.select(*keys, "mean"), keys)
    return join_null_safe(y, shift, keys).select(*keys, "_at", (F.col(value) - F.col("_own") + F.col("mean")).alias(value))


def swap_towards(y: np.ndarray, target: np.ndarray, scale: float, proposals: int, patience: int, rng: np.random.Generator) -> np.ndarray:
    """Swap values of ``y`` while the mean square gap of its lag products to ``target`` (both over ``scale``) falls."""
    n, lags = len(y), np.arange(1, len(target) + 1)
    sums = np.array([float(y[: n - k] @ y[k:]) if k < n else 0.0 for k in lags])
    error, idle = float(((sums / scale - target) ** 2).sum()), 0

    def touching(i: int, j: int) -> np.ndarray:
        """Products that i or j take part in, each once."""
        before, after = i - lags, i + lags
        out = np.where(before >= 0, y[i] * y[before % n], 0.0) + np.where(after < n, y[i] * y[after % n], 0.0)
        before, after = j - lags, j + lags
        out += np.where((before >= 0) & (before != i), y[j] * y[before % n], 0.0) + np.where((after < n) & (after != i), y[j] * y[after % n], 0.0)
        return out

    picks = rng.integers(0, n, size=(proposals, 2))
    for i, j in picks.tolist():
        idle += 1
        if idle > patience:
            break
        if i == j or y[i] == y[j]:
            continue
        old = touching(i, j)
        y[i], y[j] = y[j], y[i]
        new_sums = sums - old + touching(i, j)
        new = float(((new_sums / scale - target) ** 2).sum())
        if new < error:
            sums, error, idle = new_sums, new, 0
        else:
            y[i], y[j] = y[j], y[i]
    return y


def matched_permutation(df: DataFrame, keys: list[str], order: list[str], value: str, lags: int = 10, size: int = 4096, proposals: int = 20_000, patience: int = 2000, seed: int = 42) -> DataFrame:
    """(keys, _at, value): a permutation of each series whose autocorrelation at lags 1 to ``lags`` nears the series' own.

    All values are dealt anew over the whole series in the order of a hash, so what there is stays exactly.  Then each
    stretch of ``size`` places swaps values within itself while its lag products near the series' share; stretches are
    tasks of their own, so long series are no group.
    """
    sums = lag_sums(df, keys, order, value, lags)
    target = sums.where("element_at(sums, 1) > 0").select(*keys, "mean", (F.element_at("sums", 1) / F.col("n")).alias("_var"), F.transform(F.slice("sums", 2, lags), lambda s: s / F.element_at("sums", 1)).alias("_rho"))
    v = F.col(value).cast("double")
    rows = placed(df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(*keys, *order, v.alias("_v")), keys, order)
    dealt = placed(rows.select(*keys, F.md5(F.concat_ws(":", F.lit(seed), "_at")).alias("_h"), F.col("_at").alias("_old"), "_v"), keys, ["_h", "_old"]).select(*keys, "_at", "_v")
    dealt = dealt.withColumn("_part", F.floor(F.col("_at") / size))
    parts = dealt.select(*keys, "_part").distinct()
    goal = join_null_safe(parts, target, keys)
    goal = goal.select(*[F.col(c).alias(c) for c in goal.columns])
    kind = StructType([*df.select(*keys).schema]).add("_at", "long").add(value, "double")

    def work(key, t: pa.Table, g: pa.Table) -> pa.Table:
        at = t.column("_at").to_numpy()
        o = np.argsort(at, kind="stable")
        y = t.column("_v").to_numpy()[o].astype(float)
        if g.num_rows:
            mean, var, rho = g.column("mean")[0].as_py(), g.column("_var")[0].as_py(), np.array(g.column("_rho")[0].as_py())
            rng = np.random.default_rng([seed, int(at.min())])
            y = swap_towards(y - mean, rho, var * len(y), proposals, patience, rng) + mean
        return pa.table([*(t.column(k) for k in keys), pa.array(at[o]), pa.array(y)], kind.names)

    return dealt.groupBy(*keys, "_part").cogroup(goal.groupBy(*keys, "_part")).applyInArrow(work, kind)
