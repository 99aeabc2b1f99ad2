"""Does one series help to foretell another: regressions on several lags, the lag chosen by BIC, permutations for p."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from .lags import join_null_safe, lagged, placed, product_sums


def lag_models(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, most: int) -> DataFrame:
    """(keys, n, core, edge): what all models with up to ``most`` lags need of a series of finite pairs.

    ``core`` sums the products of (y, y1, x1, y2, x2, ...) over the rows that have all lags; ``edge`` holds the vectors of
    the at most ``most`` - 1 rows before them that have some, nulls where there is none.
    """
    rows = lagged(df.select(*keys, *order, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")), keys, order, ["_x", "_y"], most)
    vector = F.flatten(F.transform("_lags", lambda v, i: F.when(i == 0, F.array(v["_y"])).otherwise(F.array(v["_y"], v["_x"]))))
    rows = rows.select(*keys, "_at", vector.alias("_z"))
    core = product_sums(rows.where(F.col("_at") >= most), keys, "_z", 2 * most + 1)
    some = rows.where(F.col("_at") < most).groupBy(*keys).agg(F.count("*").alias("_few"), F.array_sort(F.collect_list(F.when(F.col("_at") > 0, F.struct("_at", "_z")))).alias("edge"))
    on = F.lit(True)
    c = core.select(*[F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)], F.col("n").alias("_n"), "gram")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_c{i}"))
    # a series of no more than ``most`` rows has no core
    out = some.join(c, on, "left")
    return out.select(*keys, (F.col("_few") + F.coalesce("_n", F.lit(0))).alias("n"), F.coalesce("gram", F.array().cast("array<double>")).alias("core"), F.transform("edge", lambda e: e["_z"]).alias("edge"))


def model_sums(core: np.ndarray, edge: list, lag: int, most: int) -> np.ndarray:
    """Products of (y, y1, x1, ..) with ``lag`` lags over all rows that have as many."""
    k, width = 2 * lag + 1, 2 * most + 1
    g = core.reshape(width, width)[:k, :k].copy() if len(core) else np.zeros((k, k))
    for e in edge[lag - 1 :]:
        z = np.array(e[:k], dtype=float)
        g += np.outer(z, z)
    return g


def residual(g: np.ndarray, cols: list[int]) -> float:
    """Sum of squares that the columns leave of column 0, by least squares."""
    a, b = g[np.ix_(cols, cols)], g[cols, 0]
    return max(0.0, float(g[0, 0] - b @ np.linalg.lstsq(a, b, rcond=None)[0]))


def f_value(g: np.ndarray, lag: int, n: int) -> float | None:
    whole, own = residual(g, list(range(1, 2 * lag + 1))), residual(g, list(range(1, 2 * lag + 1, 2)))
    if n - 2 * lag <= 0 or whole < 1e-15:
        return None
    return ((own - whole) / lag) / (whole / (n - 2 * lag))


def multilag(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, most: int = 10, rounds: int = 0, seed: int = 42) -> DataFrame:
    """(keys, lag, f, bic, fs, n, p): whether x helps to foretell y beyond y's own past.

    The model y ~ y1..yL + x1..xL (no constant) is fitted for every L up to ``most`` (below a third of the rows); the L of
    the smallest n ln(rss / n) + 2 L ln n is tested against the model without x; ``bic`` and ``fs`` have the values of every L.  ``p`` compares with ``rounds``
    permutations of x, in the order of a hash of place and round; it is null without rounds.  Pairs with a null or
    non-finite entry are left out first; with fewer than ``most`` + 5 pairs all but n is null.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    good = df.where(finite(x) & finite(y))
    models = lag_models(good, keys, order, x, y, most)
    names = [f.name for f in df.select(*keys).schema]
    fitted = StructType([*df.select(*keys).schema]).add("lag", "integer").add("f", "double").add("bic", ArrayType(DoubleType())).add("fs", ArrayType(DoubleType())).add("n", "long")

    def choose(frames):
        for t in frames:
            out = []
            for n, core, edge in zip(t["n"], t["core"], t["edge"], strict=True):
                bic: list[float | None] = []
                fs: list[float | None] = []
                for lag in range(1, min(most + 1, n // 3)) if n >= most + 5 else []:
                    rows, k = n - lag, 2 * lag
                    if rows <= k + 2:
                        bic.append(None)
                        fs.append(None)
                        continue
                    sums = model_sums(np.asarray(core), list(edge), lag, most)
                    rss = residual(sums, list(range(1, k + 1)))
                    fs.append(f_value(sums, lag, rows))
                    bic.append(float(rows * np.log(rss / rows) + k * np.log(rows)) if rss > 0 else float("inf"))
                known = [(b, i) for i, b in enumerate(bic) if b is not None]
                if not known:
                    out.append((None, None, None, None, n))
                    continue
                lag = min(known)[1] + 1
                out.append((lag, fs[lag - 1], bic, fs, n - lag))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pd.DataFrame({**{k: t[k] for k in names}, "lag": pd.array(cols[0], "Int32"), "f": pd.array(cols[1], "Float64"), "bic": pd.Series(list(cols[2]), index=t.index, dtype=object), "fs": pd.Series(list(cols[3]), index=t.index, dtype=object), "n": pd.array(cols[4], "Int64")})

    own = models.mapInPandas(choose, fitted)
    if not rounds:
        return own.withColumn("p", F.lit(None).cast("double"))
    at = placed(good.select(*keys, *order, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")), keys, order).drop("_pos")
    # every round deals the x values anew; y stays
    each = at.withColumn("_round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    dealt = each.select(*keys, "_round", F.md5(F.concat_ws(":", F.lit(seed), "_round", "_at")).alias("_h"), F.col("_at").alias("_from"), "_x")
    dealt = placed(dealt, [*keys, "_round"], ["_h", "_from"]).select(*keys, "_round", "_at", "_x")
    shuffled = join_null_safe(each.select(*keys, "_round", "_at", "_y"), dealt, [*keys, "_round", "_at"])
    perm = lag_models(shuffled, [*keys, "_round"], ["_at"], "_x", "_y", most)
    lag_of = own.select(*keys, F.col("lag").alias("_lag"), F.col("f").alias("_f"))
    perm = join_null_safe(perm, lag_of, keys).where("_lag IS NOT NULL")
    tried = StructType([*df.select(*keys).schema]).add("_ge", "integer")

    def compare(frames):
        for t in frames:
            hit = []
            for n, core, edge, lag, f in zip(t["n"], t["core"], t["edge"], t["_lag"], t["_f"], strict=True):
                g = f_value(model_sums(np.asarray(core), list(edge), lag, most), lag, n - lag)
                hit.append(int(g is not None and f == f and g >= f))
            yield pd.DataFrame({**{k: t[k] for k in names}, "_ge": pd.array(hit, "Int32")})

    p = perm.mapInPandas(compare, tried).groupBy(*keys).agg(((F.sum("_ge") + 1) / (rounds + 1)).alias("p"))
    on = F.lit(True)
    q = p.select(*[F.col(k).alias(f"_q{i}") for i, k in enumerate(keys)], "p")
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_q{i}"))
    return own.join(q, on, "left").select(*keys, "lag", "f", "bic", "fs", "n", "p")


def cause_graph(panel: DataFrame, name: str, ts: str, value: str, most: int, rounds: int, alpha: float) -> DataFrame:
    """(src, dst, lag, f, p) of the ordered pairs of series for which src helps to foretell dst with p below ``alpha``.

    Series meet on equal times; there are as many pairs as the square of the names.
    """
    a = panel.select(F.col(name).alias("src"), F.col(ts).alias("_t"), F.col(value).alias("_x"))
    b = panel.select(F.col(name).alias("dst"), F.col(ts).alias("_t"), F.col(value).alias("_y"))
    both = a.join(b, "_t").where("src <> dst")
    found = multilag(both, ["src", "dst"], ["_t"], "_x", "_y", most, rounds)
    return found.where(F.col("p") < alpha).select("src", "dst", "lag", "f", "p")
